"""Paired contrasts between methods on the same units."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .bootstrap import mean_intervals

UNIT = ("subject_id", "measurement_id")


def unit_pairs(units: DataFrame, specs: DataFrame, keys: list[str], by_seed: bool = False) -> DataFrame:
    """(contrast, keys, unit, candidate_pred, reference_pred, y_true, other_true): each unit that either side of a contrast has, one shuffle for all contrasts.

    specs: (contrast, candidate, reference), a row for each contrast; units: keys, method, seed if by_seed, subject, measurement, y_true, y_pred.
    """
    on = [*keys, *UNIT, *(["seed"] if by_seed else [])]
    few = F.broadcast(specs)  # a row for each contrast that the caller names
    sides = units.join(few, (units["method"] == few["candidate"]) | (units["method"] == few["reference"]))
    mine, other = F.col("method") == F.col("candidate"), F.col("method") == F.col("reference")
    pick = lambda side, x, name: F.max(F.when(side, F.col(x))).alias(name)  # noqa: E731  a unit is one row of a method
    return sides.groupBy("contrast", *on).agg(pick(mine, "y_pred", "candidate_pred"), pick(other, "y_pred", "reference_pred"), pick(mine, "y_true", "y_true"), pick(other, "y_true", "other_true"))


def _faults(pairs: DataFrame, tolerance: float) -> DataFrame:
    lost = F.when(F.col("candidate_pred").isNull(), "candidate").when(F.col("reference_pred").isNull(), "reference")
    differs = F.abs(F.col("y_true") - F.col("other_true")) > tolerance
    return pairs.withColumn("fault", F.coalesce(lost, F.when(differs, "truth"))).where("fault is not null")


def paired_units(units: DataFrame, specs: DataFrame, keys: list[str], by_seed: bool = False, strict: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """Candidate and reference predictions of the same units.

    strict: raises where a unit is missing on one side or the two sides' truths differ; else such units are left out (see unmatched_units).
    """
    pairs = unit_pairs(units, specs, keys, by_seed)
    faults = _faults(pairs, tolerance)
    if strict:
        bad = faults.limit(3).collect()
        if bad:
            raise ValueError("contrasts pair the same units only: " + "; ".join(f"{r['contrast']} {r['subject_id']}/{r['measurement_id']}: {r['fault']}" for r in bad))
        return pairs.drop("other_true")
    return pairs.where((F.col("candidate_pred").isNotNull() & F.col("reference_pred").isNotNull()) & (F.abs(F.col("y_true") - F.col("other_true")) <= tolerance)).drop("other_true")


def unmatched_units(units: DataFrame, specs: DataFrame, keys: list[str], by_seed: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """(contrast, keys, unit, missing): units that one side of a contrast lacks ("candidate" or "reference"), or whose truths differ ("truth")."""
    on = [*keys, *UNIT, *(["seed"] if by_seed else [])]
    return _faults(unit_pairs(units, specs, keys, by_seed), tolerance).select("contrast", *on, F.col("fault").alias("missing"))


def subject_deltas(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each subject's mean of |candidate error| - |reference error|."""
    delta = F.abs(F.col("candidate_pred") - F.col("y_true")) - F.abs(F.col("reference_pred") - F.col("y_true"))
    return pairs.groupBy(*keys, "subject_id").agg(F.avg(delta).alias("delta"), F.count("*").alias("n_units"))


def contrast_table(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_subjects, n_measurements, delta): the mean over subjects."""
    return subject_deltas(pairs, keys).groupBy(*keys).agg(F.count("*").alias("n_subjects"), F.sum("n_units").alias("n_measurements"), F.avg("delta").alias("delta"))


def contrasts_with_intervals(pairs: DataFrame, group: list[str], keys: list[str], replicates: int, seed: str = "contrast") -> DataFrame:
    """The contrast table with a subject-bootstrap interval and the share of replicates in which the candidate is better."""
    deltas = subject_deltas(pairs, keys)
    return contrast_table(pairs, keys).join(mean_intervals(deltas, group, keys, replicates, seed=seed), keys).withColumnRenamed("p_below_zero", "p_candidate_better")


def seed_contrasts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over seeds of the seeds' deltas and their sample standard deviation (0 for one seed)."""
    return contrast_table(pairs, [*keys, "seed"]).groupBy(*keys).agg(F.avg("delta").alias("delta"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("delta_seed_sd"), F.count("*").alias("n_seeds"), F.max("n_subjects").alias("n_subjects"))


def over_seeds(units: DataFrame, methods: list[str], keys: list[str]) -> DataFrame:
    """Units by seed in which the named methods, which have no seed of their own, are repeated for every seed that the keys' other methods have."""
    fixed = F.col("method").isin(*methods)
    seeds = units.where(~fixed).select(*keys, "seed").distinct()
    return units.where(~fixed).unionByName(units.where(fixed).drop("seed").join(F.broadcast(seeds), keys).select(*units.columns))  # a row for each of the keys and seeds


def seed_contrasts_with_intervals(pairs: DataFrame, group: list[str], keys: list[str], replicates: int, seed: str = "seed-contrast") -> DataFrame:
    """The seed contrasts with an interval: every seed's delta is taken from the same draw of subjects, and a replicate's value is their mean.

    Subjects must have the same seeds, which the mean of their deltas over seeds then stands for.
    """
    per_seed = subject_deltas(pairs, [*keys, "seed"])
    uneven = per_seed.groupBy(*keys, "subject_id").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least <> most").limit(1).collect()
    if uneven:
        raise ValueError(f"seed contrasts need every subject in every seed: {[uneven[0][k] for k in keys]}")
    mean = per_seed.groupBy(*keys, "subject_id").agg(F.avg("delta").alias("delta"))
    return seed_contrasts(pairs, keys).join(mean_intervals(mean, group, keys, replicates, seed=seed), keys).withColumnRenamed("p_below_zero", "p_candidate_better")


def model_against_constants(units: DataFrame, keys: list[str], replicates: int, seed: str = "constants") -> DataFrame:
    """(keys, constant, n_subjects, n_measurements, model_mae, constant_mae, delta, ci_low, ci_high, p_candidate_better).

    units: keys, fold, subject, measurement, y_true, y_pred of one method; the constants of a fold are the subject-balanced mean and the lower weighted
    median of the truths in the other folds. A fold alone in its keys has no constant and is left out. Units, constants and subjects' deltas are each made once.
    """
    units = written(units.select(*keys, "fold", "subject_id", "measurement_id", "y_true", "y_pred"), "units")
    fits = written(fold_constants(units.drop("y_pred"), keys), "constants")  # a row for each fold
    kinds = F.explode(F.create_map(F.lit("mean_constant"), F.col("mean_constant"), F.lit("median_constant"), F.col("median_constant"))).alias("constant", "reference_pred")
    pairs = units.join(fits.select(*keys, "fold", kinds), [*keys, "fold"]).where("reference_pred is not null").withColumnRenamed("y_pred", "candidate_pred")
    model, plain = F.abs(F.col("candidate_pred") - F.col("y_true")), F.abs(F.col("reference_pred") - F.col("y_true"))
    each = written(pairs.groupBy(*keys, "constant", "subject_id").agg(F.avg(model - plain).alias("delta"), F.count("*").alias("n_units"), F.avg(model).alias("model"), F.avg(plain).alias("plain")), "deltas")
    table = each.groupBy(*keys, "constant").agg(F.count("*").alias("n_subjects"), F.sum("n_units").alias("n_measurements"), F.avg("delta").alias("delta"), F.avg("model").alias("model_mae"), F.avg("plain").alias("constant_mae"))
    return table.join(mean_intervals(each, keys, [*keys, "constant"], replicates, seed=seed), [*keys, "constant"]).withColumnRenamed("p_below_zero", "p_candidate_better")


def incremental_effects(metrics: DataFrame, keys: list[str], suffix: str = "_plus") -> DataFrame:
    """For each method that ends in the suffix its metrics minus those of the method without it; methods without a base are left out."""
    add = metrics.where(F.col("method").endswith(suffix)).withColumn("base", F.expr(f"substring(method, 1, length(method) - {len(suffix)})"))
    base = metrics.select(*keys, F.col("method").alias("base"), F.col("mae").alias("base_mae"), F.col("rmse").alias("base_rmse"))
    return add.join(base, [*keys, "base"]).select(*keys, "base", F.col("mae").alias("with_mae"), "base_mae", (F.col("mae") - F.col("base_mae")).alias("delta_mae"), (F.col("rmse") - F.col("base_rmse")).alias("delta_rmse"))


def condition_effects(metrics: DataFrame, effects: DataFrame, keys: list[str], fields: str = "demographic_fields", without: str = "none") -> DataFrame:
    """(keys, fields, effect, candidate, reference, delta_mae, delta_rmse): what a condition changes against its reference condition, of equal keys.

    metrics: keys (cohort, model, target, policies ...), condition, the column of the fields, mae, rmse. effects: (effect, candidate, reference), a row for each.
    The reference is the one whose fields are `without`; candidates without such a reference are left out, see missing_entries().
    """
    few = F.broadcast(effects)  # a row for each effect that the caller names
    mine = metrics.join(few, metrics["condition"] == few["candidate"]).select(*keys, fields, "effect", "candidate", "reference", "mae", "rmse")
    base = metrics.where(F.col(fields) == without).select(*keys, F.col("condition").alias("reference"), F.col("mae").alias("_mae"), F.col("rmse").alias("_rmse"))
    return mine.join(base, [*keys, "reference"]).select(*keys, fields, "effect", "candidate", "reference", (F.col("mae") - F.col("_mae")).alias("delta_mae"), (F.col("rmse") - F.col("_rmse")).alias("delta_rmse"))


def missing_entries(rows: DataFrame, keys: dict[str, list], extra: bool = True) -> DataFrame:
    """(keys, fault): combinations of the keys' expected values that the rows lack ("missing"), have several times ("repeated") or, if extra, have unexpectedly
    ("unexpected"). The expected matrix is the product of short lists that the caller names.
    """
    spark, names = rows.sparkSession, list(keys)
    combined = list(itertools.product(*keys.values()))
    expected = spark.createDataFrame(combined, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names))
    have = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"h.{k}")) for k in names]
    both = expected.withColumn("_wanted", F.lit(True)).alias("x").join(have.alias("h"), on, "full")
    fault = F.when(F.col("_n").isNull(), "missing").when(F.col("_wanted").isNull(), F.lit("unexpected") if extra else F.lit(None)).when(F.col("_n") > 1, "repeated")
    return both.select(*(F.coalesce(F.col(f"x.{k}"), F.col(f"h.{k}")).alias(k) for k in names), fault.alias("fault")).where("fault is not null")


def complete_contrasts(units: DataFrame, specs: DataFrame, group: list[str], expected: dict[str, list], replicates: int, seed: str = "matrix") -> DataFrame:
    """The matrix of seed-aware contrasts with intervals for every combination of the expected values of the group's columns and of `contrast`.

    units: group, method, seed, subject, measurement, y_true, y_pred. Raises where the matrix is incomplete or has more than is expected.
    """
    pairs = paired_units(units, specs, group, by_seed=True)
    made = seed_contrasts_with_intervals(pairs, group, [*group, "contrast"], replicates, seed)
    faults = missing_entries(pairs.select(*group, "contrast").distinct(), expected).limit(5).collect()
    if faults:
        raise ValueError("the contrast matrix is not the expected one: " + "; ".join(f"{[r[k] for k in expected]} {r['fault']}" for r in faults))
    return made


def complementarity(contrasts: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """One row for each of the keys with the lift of either part (minus the contrast's delta) and whether the combination beats both."""
    wide = contrasts.groupBy(*keys).pivot("contrast", list(names)).agg(F.first("delta"))
    first, second = (-F.col(f"`{n}`") for n in names)
    return wide.select(*keys, first.alias("first_lift"), second.alias("second_lift"), ((first > 0) & (second > 0)).alias("better_than_both"))


def fold_constants(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fold, mean_constant, median_constant): subject-balanced mean and lower weighted median of the truth in all other folds."""
    weights = units.groupBy(*keys, "subject_id").agg(F.count("*").alias("_n"))
    rows = units.join(weights, [*keys, "subject_id"]).withColumn("w", 1 / F.col("_n"))
    sums = rows.groupBy(*keys, "fold").agg(F.sum(F.col("y_true") * F.col("w")).alias("sy"), F.sum("w").alias("sw"))
    whole = sums.groupBy(*keys).agg(F.sum("sy").alias("ty"), F.sum("sw").alias("tw"))
    means = sums.join(whole, keys).select(*keys, "fold", ((F.col("ty") - F.col("sy")) / F.when(F.col("tw") - F.col("sw") > 1e-9, F.col("tw") - F.col("sw"))).alias("mean_constant"))
    # the median needs the other folds' values: equal values are merged before they are sent to the other folds
    from .scoring import lower_weighted_median

    merged = written(rows.groupBy(*keys, "fold", "y_true").agg(F.sum("w").alias("w")), "weights")
    held = sums.select(*keys, F.col("fold").alias("held"))
    fits = merged.join(held, keys).where("fold <> held").select(*keys, F.col("held").alias("fold"), "y_true", "w")
    medians = lower_weighted_median(fits, [*keys, "fold"], "y_true", "w").withColumnRenamed("median", "median_constant")
    return means.join(medians, [*keys, "fold"], "left")
