"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def order_key(seed: str, *keys: Column | str) -> Column:
    """A seeded order that any engine can reproduce: 48 bits of md5 of seed and keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))), 1, 12), 16, 10).cast("long")


def number_text(x: Column | str, digits: int = 12) -> Column:
    """Canonical text of a number: its decimal value to so many significant digits, without zeros at the end; null and NaN as the empty text.

    Numbers of one decimal value to these digits have one text, whatever wrote and read them.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    text = F.format_string(f"%.{digits - 1}e", x)
    mantissa = F.regexp_replace(F.regexp_replace(F.split(text, "e")[0], "0+$", ""), r"\.$", "")
    power = F.split(text, "e")[1].cast("int")
    shown = F.concat(mantissa, F.when(power != 0, F.concat(F.lit("e"), power.cast("string"))).otherwise(""))
    return F.when(x.isNull() | F.isnan(x), "").when(x == 0, "0").when(F.abs(x) == float("inf"), x.cast("string")).otherwise(shown)


def category(x: Column | str, values: dict[str, str]) -> Column:
    """Tokens (trimmed, lower case), the known ones mapped, null kept."""
    x = F.col(x) if isinstance(x, str) else x
    token = F.lower(F.trim(x))
    out = token
    for known, value in values.items():
        out = F.when(token == known, F.lit(value)).otherwise(out)
    return F.when(x.isNotNull(), out)


# Tokens of the two-valued category.
SEX_TOKENS = {"f": "female", "female": "female", "0": "female", "0.0": "female", "m": "male", "male": "male", "1": "male", "1.0": "male"}


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def body_mass_index(bmi: Column, weight: Column, height: Column) -> Column:
    """The given value, else weight over squared height in metres."""
    return F.coalesce(bmi, safe_ratio(weight, F.pow(height / 100, F.lit(2))))


def padded_id(x: Column, width: int) -> Column:
    """Digits padded with zeros to a width; longer ids are not cut."""
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, "0"))


def plain_token(x: Column) -> Column:
    """A token as text without a trailing ".0"; null is empty."""
    return F.coalesce(F.regexp_replace(F.trim(x.cast("string")), r"\.0+$", ""), F.lit(""))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def number_pair(x: Column, first: bool) -> Column:
    """One side of "120/80"; null where the text is no such pair."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*$"
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1 if first else 2)).try_cast("double")


def reasons(**tests: Column) -> Column:
    """The names of the tests that hold, joined by ";"."""
    return F.concat_ws(";", *(F.when(t, F.lit(n)) for n, t in tests.items()))


def first_of(df, names: list[str], kind: str = "string") -> Column:
    """The first of several alias columns that the frame has, else null."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None)).cast(kind)


def weighted_mean(x: Column, w: Column) -> Column:
    return safe_ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))

