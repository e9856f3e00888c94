"""Scoring in which every subject counts equally, however many rows it has.

Predictions are rows (keys..., subject_id, measurement_id, seed, y_true, y_pred). A scoring unit is the mean of a measurement's rows;
metrics are means over subjects of each subject's mean moments, so two partially aggregated groupBys and no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..sources.shared import written
from .scans import running

#: A subject's means, and the variances and covariance of its units about them.
MEANS, SPREADS = ("abs_error", "square_error", "error", "y", "p"), ("var_y", "var_p", "cov")
MOMENTS = (*MEANS, *SPREADS)
#: A variance below this part of the squared level is what rounding leaves of a constant.
NOISE = 1e-24


def scoring_units(predictions: DataFrame, keys: list[str], segment: str | None = None) -> DataFrame:
    """One row for each of the keys, subject and measurement: mean truth, mean prediction, number of rows (of different segments, where their column is given)."""
    n = F.count("*") if segment is None else F.count_distinct(segment)
    return predictions.groupBy(*keys, "subject_id", "measurement_id").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"), n.alias("n_segments"))


def across_seeds(units: DataFrame, keys: list[str]) -> DataFrame:
    """Units averaged over seeds, a diagnostic: largest number of rows, number of seeds, and the label of the mode."""
    out = units.groupBy(*keys, "subject_id", "measurement_id").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"), F.max("n_segments").alias("n_segments"), F.countDistinct("seed").alias("n_seeds"))
    return out.withColumn("aggregation_mode", F.when(F.col("n_seeds") > 1, "mean_over_seeds").otherwise("single_seed"))


def with_subject_mean(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The rows with the mean of a value over their subject's rows."""
    return rows.join(rows.groupBy(*keys, "subject_id").agg(F.avg(value).alias(out)), [*keys, "subject_id"])


def subject_moments(units: DataFrame, keys: list[str]) -> DataFrame:
    """Means of each subject's units, their variances and covariance about them, and the number of units."""
    e, y, p = F.col("y_pred") - F.col("y_true"), F.col("y_true"), F.col("y_pred")
    means = [F.avg(v).alias(n) for v, n in zip((F.abs(e), e * e, e, y, p), MEANS, strict=True)]
    spreads = [F.var_pop(y).alias("var_y"), F.var_pop(p).alias("var_p"), F.covar_pop(y, p).alias("cov")]
    return units.groupBy(*keys, "subject_id").agg(*means, *spreads, F.count("*").alias("n_units"))


def metric_columns() -> dict:
    """The metrics as expressions of the moments over subjects; null where undefined."""
    m = {n: F.col(n) for n in MOMENTS}
    some_y, some_p = (F.when(m[f"var_{x}"] > NOISE * m[x] * m[x], m[f"var_{x}"]) for x in ("y", "p"))
    slope = m["cov"] / some_p
    return {
        "mae": m["abs_error"], "rmse": F.sqrt(m["square_error"]), "bias": m["error"], "error_std": F.sqrt(F.greatest(F.lit(0.0), m["square_error"] - m["error"] * m["error"])),
        "r2": 1 - m["square_error"] / some_y, "correlation": m["cov"] / F.sqrt(some_y * some_p), "calibration_slope": slope, "calibration_intercept": m["y"] - slope * m["p"],
    }


METRICS = ("mae", "rmse", "bias", "error_std", "r2", "correlation", "calibration_slope", "calibration_intercept")


def metrics_of_moments(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of each of the keys from subjects' moments, each subject counting once.

    A variance over all is the mean of the subjects' own plus that of their means, neither a difference of large squares.
    """
    between = {"var_y": F.var_pop("y"), "var_p": F.var_pop("p"), "cov": F.covar_pop("y", "p")}
    parts = [F.avg(n).alias(n) for n in MEANS] + [(F.avg(n) + between[n]).alias(n) for n in SPREADS]
    means = moments.groupBy(*keys).agg(*parts, F.count("*").alias("n_subjects"), F.sum("n_units").alias("n_measurements"))
    return means.select(*keys, "n_subjects", "n_measurements", *(c.alias(n) for n, c in metric_columns().items()))


def balanced_metrics(units: DataFrame, keys: list[str]) -> DataFrame:
    """The eight subject-balanced metrics for each of the keys."""
    return metrics_of_moments(subject_moments(units, keys), keys)


def seed_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Means of seeds' metrics and their sample standard deviation (0 for one seed)."""
    return metrics.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in METRICS), *(F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_seed_sd") for m in METRICS), F.max("n_subjects").alias("n_subjects"), F.max("n_measurements").alias("n_measurements"), F.count("*").alias("n_seeds"))


def ranked(metrics: DataFrame, keys: list[str], by: str = "mae") -> DataFrame:
    """With `rank` within the keys; ties share the smallest."""
    return metrics.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(by)))


def macro_mae(predictions: DataFrame, keys: list[str], policy: str = "subject") -> DataFrame:
    """MAE of measurement means averaged over subjects ("subject") or measurements ("measurement"), or of rows ("row")."""
    if policy == "row":
        return predictions.groupBy(*keys).agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    units = scoring_units(predictions, keys).withColumn("gap", F.abs(F.col("y_pred") - F.col("y_true")))
    if policy == "measurement":
        return units.groupBy(*keys).agg(F.avg("gap").alias("mae"))
    return units.groupBy(*keys, "subject_id").agg(F.avg("gap").alias("gap")).groupBy(*keys).agg(F.avg("gap").alias("mae"))


def between_within(units: DataFrame, keys: list[str]) -> DataFrame:
    """Overall error, error of subjects' means and of deviations from them, with the spread of true and predicted deviations; means over all subjects.

    A subject with one unit deviates by 0. `within_ratio` is null where no truth deviates.
    """
    subject = units.groupBy(*keys, "subject_id").agg(F.avg("y_true").alias("my"), F.avg("y_pred").alias("mp"), F.count("*").alias("n"))
    dev = units.join(subject, [*keys, "subject_id"]).withColumn("dy", F.col("y_true") - F.col("my")).withColumn("dp", F.col("y_pred") - F.col("mp"))
    per = dev.groupBy(*keys, "subject_id").agg(
        F.first("my").alias("my"), F.first("mp").alias("mp"), F.first("n").alias("n"),
        F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"), F.avg(F.abs(F.col("dp") - F.col("dy"))).alias("gap"),
        F.sqrt(F.avg(F.col("dy") ** 2)).alias("sy"), F.sqrt(F.avg(F.col("dp") ** 2)).alias("sp"),
    )
    out = per.groupBy(*keys).agg(
        F.count("*").alias("n_subjects"), F.sum("n").alias("n_measurements"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.avg("mae").alias("overall_mae"), F.avg(F.abs(F.col("mp") - F.col("my"))).alias("between_mae"), F.avg("gap").alias("within_mae"),
        F.avg("sy").alias("true_within_sd"), F.avg("sp").alias("pred_within_sd"),
    )
    return out.withColumn("within_ratio", F.col("pred_within_sd") / F.when(F.col("true_within_sd") > 0, F.col("true_within_sd")))


def lower_weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, median): the smallest value at which the cumulative weight reaches half.

    Values are merged first, so the running weights see different values only; heavy groups run in many tasks. The merged values are written once, for totals
    and running weights read them several times.
    """
    merged = written(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w")), "weights")
    half = merged.groupBy(*keys).agg(((0.5 - 1e-12) * F.sum("_w")).alias("_half"))
    cum = running(merged, keys, [value], F.col("_w"), "_before")
    cum = cum.join(half, keys) if keys else cum.crossJoin(F.broadcast(half))  # one row
    return cum.where(F.col("_before") + F.col("_w") >= F.col("_half")).groupBy(*keys).agg(F.min(value).alias("median"))


def balanced_weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with `subject_weight`, 1 / rows of the subject, and `measurement_weight`, 1 / (rows of the measurement x measurements of the subject) scaled to mean 1."""
    measured = rows.groupBy(*keys, "subject_id", "measurement_id").agg(F.count("*").alias("_rows"))
    subject = measured.groupBy(*keys, "subject_id").agg(F.count("*").alias("_measurements"), F.sum("_rows").alias("_subject_rows"))
    # a measurement's rows weigh 1 / its subject's measurements together, so all weights add up to the number of subjects
    total = subject.groupBy(*keys).agg((F.sum("_subject_rows") / F.count("*")).alias("_scale"))
    out = rows.join(measured, [*keys, "subject_id", "measurement_id"]).join(subject, [*keys, "subject_id"])
    out = out.join(total, keys) if keys else out.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("subject_weight", 1 / F.col("_subject_rows")).withColumn("measurement_weight", F.col("_scale") / (F.col("_rows") * F.col("_measurements"))).drop("_rows", "_measurements", "_subject_rows", "_scale")
