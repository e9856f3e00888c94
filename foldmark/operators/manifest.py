"""Manifests: canonical columns, filters and selection of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import SEX_TOKENS, body_mass_index, category

#: Columns that a manifest may lack, with the types in which they are added.
OPTIONAL = {"measurement_id": "string", "waveform_format": "string", "age": "double", "sex": "string", "bmi": "double", "height_cm": "double", "weight_kg": "double", "waveform_sha256": "string", "valid_for_analysis": "string"}
NUMERIC = ("sample_rate_hz", "n_samples", "sbp", "dbp", "age", "bmi", "height_cm", "weight_kg")


def canonical_manifest(rows: DataFrame) -> DataFrame:
    """Adds missing columns as null, coerces numbers (bad text becomes null), and fills the defaults; other columns pass through.

    measurement_id defaults to subject_id, the format to the path's suffix or "text" where it has none, bmi to weight over squared height, validity to true.
    """
    out = rows.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in rows.columns})
    out = out.withColumns({c: F.col(c).cast("string").try_cast("double") for c in NUMERIC if c in out.columns})
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in NUMERIC if c in out.columns})
    name = F.substring_index("waveform_path", "/", -1)
    found = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    suffix = F.when(F.col("waveform_path").isNotNull(), F.when(found == "", "text").otherwise(found))
    return out.withColumns({
        "measurement_id": F.coalesce(F.col("measurement_id").cast("string"), F.col("subject_id").cast("string")),
        "waveform_format": F.coalesce("waveform_format", suffix),
        "bmi": body_mass_index(F.col("bmi"), F.col("weight_kg"), F.col("height_cm")),
        "sex": category(F.col("sex").cast("string"), SEX_TOKENS),
        "valid_for_analysis": truth(F.coalesce(F.col("valid_for_analysis").cast("string"), F.lit("true"))),
    })


def truth(x: Column) -> Column:
    """Whether a flag, boolean or text, says true."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))) == "true", F.lit(False))


def valid_rows(manifest: DataFrame) -> DataFrame:
    return manifest.where(truth(F.col("valid_for_analysis")))


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows in an order that tells all rows apart; `most` is 1 or more."""
    if most < 1:
        raise ValueError(f"first_rows: {most} rows asked, 1 or more wanted")
    return rows.orderBy(*order).limit(most)


def raw_field_only(path: str, field: str) -> Column:
    """Whether the last part of a path is the raw field."""
    return F.substring_index(F.col(path), "/", -1) == field


def available_fields(rows: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """(keys, fields): labels of the columns that have any value, joined by "/", or "none"."""
    seen = rows.groupBy(*keys).agg(*(F.count(c).alias(f"_{c}") for c in fields))
    label = F.concat_ws("/", *(F.when(F.col(f"_{c}") > 0, F.lit(n)) for c, n in fields.items()))
    return seen.select(*keys, F.when(label == "", "none").otherwise(label).alias("fields"))


def checked_left_join(left: DataFrame, right: DataFrame, key: str, one_to_one: bool = False) -> DataFrame:
    """left with right's columns by key; raises where right (or, one to one, left) repeats a key."""
    for side, df in (("right", right), ("left", left)) if one_to_one else (("right", right),):
        if not df.groupBy(key).count().where(F.col("count") > 1).isEmpty():
            raise ValueError(f"checked_left_join: {side} repeats {key}")
    return left.join(right, key, "left")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only a or only b has."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return left.join(right, key, "full_outer").where("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "left_only").otherwise("right_only").alias("side"))


def lookup(rows: DataFrame, dimension: DataFrame, on: list[str], value: str, default: str) -> DataFrame:
    """A label from a dimension (a registry's rows), the default where it has none."""
    return rows.join(dimension.select(*on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def measurement_key(shared_label: Column) -> Column:
    """The measurement that a row counts for: its subject where the cohort's rows share one label, else its measurement id."""
    return F.when(shared_label, F.col("subject_id").cast("string")).otherwise(F.coalesce(F.col("measurement_id").cast("string"), F.col("subject_id").cast("string")))
