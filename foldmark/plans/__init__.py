"""The registered queries and their comparison SQL."""

from . import checks, cohort, evaluation, reporting  # noqa: F401  each registers its queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
