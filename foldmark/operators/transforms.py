"""Feature transforms fitted on a pool of rows: imputation, indicators, weighted z-scores, one-hot categories; parameters are rows, not objects."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import weighted_mean
from .scoring import lower_weighted_median


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _gap(x: Column) -> Column:
    return (x.isNull() | F.isnan(x)).cast("double")


def long_values(rows: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """(keep, feature, value): one row for each of the columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return rows.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def fit_numeric(rows: DataFrame, pool: list[str], columns: list[str], weight: str, scale_indicators: bool = True, whole_table: bool = False) -> DataFrame:
    """(pool, feature, median, mean, scale, has_gap, gap_mean, gap_scale): train-only parameters of each pool and feature.

    Values that are not finite are filled with the lower weighted median before mean and population deviation are taken; nulls and NaN are gaps, which an
    indicator tells (infinities are filled only). A deviation up to the precision of a double counts as 1. A feature without a finite value is filled with 0.
    whole_table: a feature has an indicator in every pool if it has a gap in any.
    """
    values = long_values(rows, [*pool, weight], columns)
    medians = lower_weighted_median(values.where(_finite(F.col("value"))), [*pool, "feature"], "value", weight)
    x, w = F.coalesce(F.when(_finite(F.col("value")), F.col("value")), F.col("median"), F.lit(0.0)), F.col(weight)
    # differences to the median: a feature of one value has deviation 0 exactly, whatever its level
    filled = values.join(medians, [*pool, "feature"], "left").withColumn("d", x - F.coalesce("median", F.lit(0.0))).withColumn("g", _gap(F.col("value")))
    out = filled.groupBy(*pool, "feature").agg(F.max("median").alias("median"), weighted_mean(F.col("d"), w).alias("_d"), weighted_mean(F.col("d") * F.col("d"), w).alias("_d2"), weighted_mean(F.col("g"), w).alias("gap_mean"), F.max("g").alias("_gap"))
    deviation = lambda v: F.when(F.sqrt(F.greatest(F.lit(0.0), v)) > sys.float_info.epsilon, F.sqrt(F.greatest(F.lit(0.0), v))).otherwise(1.0)
    out = out.withColumn("mean", F.coalesce("median", F.lit(0.0)) + F.col("_d")).withColumn("scale", deviation(F.col("_d2") - F.col("_d") * F.col("_d"))).withColumn("gap_scale", deviation(F.col("gap_mean") * (1 - F.col("gap_mean"))))
    if whole_table:
        out = out.drop("_gap").join(out.groupBy("feature").agg(F.max("_gap").alias("_gap")), "feature")
    if not scale_indicators:
        out = out.withColumn("gap_mean", F.lit(0.0)).withColumn("gap_scale", F.lit(1.0))
    return out.withColumn("has_gap", F.col("_gap") > 0).select(*pool, "feature", "median", "mean", "scale", "has_gap", "gap_mean", "gap_scale")


def apply_numeric(rows: DataFrame, params: DataFrame, pool: list[str], key: list[str], columns: list[str]) -> DataFrame:
    """(pool, key, feature, value, indicator): z-scored values; the indicator is null for features without gaps in the fit."""
    values = long_values(rows, [*pool, *key], columns).join(params, [*pool, "feature"])
    z = (F.coalesce(F.when(_finite(F.col("value")), F.col("value")), F.col("median"), F.lit(0.0)) - F.col("mean")) / F.col("scale")
    gap = F.when(F.col("has_gap"), (_gap(F.col("value")) - F.col("gap_mean")) / F.col("gap_scale"))
    return values.select(*pool, *key, "feature", z.alias("value"), gap.alias("indicator"))


def one_hot(x: Column, known: tuple[str, ...] = ("female", "male")) -> Column:
    """Indicators of the known values and of anything else, as an array of doubles."""
    other = ~F.coalesce(x.isin(*known), F.lit(False))
    return F.array(*(F.coalesce(x == k, F.lit(False)).cast("double") for k in known), other.cast("double"))


def fit_target(rows: DataFrame, pool: list[str], target: str, weight: str) -> DataFrame:
    """(pool, decoder_mean, decoder_sd): weighted mean and population deviation; a deviation of 1e-8 or less is null, so nothing decodes with it."""
    w, y = F.col(weight), F.col(target)
    out = rows.groupBy(*pool).agg(weighted_mean(y, w).alias("decoder_mean"), weighted_mean(y * y, w).alias("_y2"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_y2") - F.col("decoder_mean") * F.col("decoder_mean")))
    return out.select(*pool, "decoder_mean", F.when(sd > 1e-8, sd).alias("decoder_sd"))


def decoded(output: Column, mean: Column, sd: Column) -> Column:
    return output * sd + mean


def fit_vectors(rows: DataFrame, pool: list[str], vector: str, weight: str, floor: float = 1e-6) -> DataFrame:
    """(pool, means array, scales array, n_floored): weighted mean and deviation of each dimension, deviations below the floor set to it."""
    values = rows.select(*pool, weight, F.posexplode(vector).alias("dim", "x"))
    w, x = F.col(weight), F.col("x").cast("double")
    dims = values.groupBy(*pool, "dim").agg(weighted_mean(x, w).alias("mean"), weighted_mean(x * x, w).alias("_x2"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_x2") - F.col("mean") * F.col("mean")))
    packed = dims.groupBy(*pool).agg(F.sort_array(F.collect_list(F.struct("dim", "mean", F.greatest(sd, F.lit(floor)).alias("scale")))).alias("_d"), F.count_if(sd < floor).alias("n_floored"))
    return packed.select(*pool, F.col("_d.mean").alias("means"), F.col("_d.scale").alias("scales"), "n_floored")


def standardised(vector: Column, means: Column, scales: Column) -> Column:
    return F.zip_with(F.zip_with(vector, means, lambda a, b: a - b), scales, lambda a, b: a / b)
