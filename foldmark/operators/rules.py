"""Validation: each rule gives rows (rule, key, detail) for what breaks it; strict() raises instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

_EMPTY = "rule string, key string, detail string"


def broken(rows: DataFrame, rule: str, test: Column, key: Column, detail: Column | None = None) -> DataFrame:
    """Rows for which the test holds."""
    return rows.where(test).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def checked(rows: DataFrame, key: Column, tests: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """Rows for which tests hold, all tests in one pass: {rule: test} or {rule: (test, detail)}."""
    found = []
    for rule, test in tests.items():
        test, detail = test if isinstance(test, tuple) else (test, F.lit(None))
        found.append(F.when(test, F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))))
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("_v")).select("_v.rule", "_v.key", "_v.detail")


def spelt(keys: list[str]) -> Column:
    return F.concat_ws("|", *(F.col(k).cast("string") for k in keys))


def repeated(rows: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return broken(many, rule, F.col("n") > 1, F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), F.col("n"))


def missing_columns(rows: DataFrame, required: list[str]) -> DataFrame:
    lost = [("missing_column", c, None) for c in required if c not in rows.columns]
    return rows.sparkSession.createDataFrame(lost, _EMPTY)


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def strict(found: DataFrame) -> None:
    """Raises with some of the violations where there are any."""
    some = found.limit(5).collect()
    if some:
        raise ValueError("violations: " + "; ".join(f"{x['rule']}[{x['key']}] {x['detail'] or ''}".strip() for x in some))


def finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def manifest_violations(rows: DataFrame, key: str = "segment_id", require_covariates: bool = False) -> DataFrame:
    """Each row's rules, the empty table, and repeated keys; with require_covariates age and sex must be known."""
    null = lambda *names: reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names))
    tests = {
        "segment_present": (null(key), F.col("subject_id")), "subject_present": null("subject_id"), "path_present": null("waveform_path"),
        "numbers_present": null("sbp", "dbp", "sample_rate_hz", "n_samples"), "category_known": (F.col("sex").isNotNull() & ~F.col("sex").isin("female", "male"), F.col("sex")),
        "rate_positive": F.col("sample_rate_hz") <= 0, "two_samples": F.col("n_samples") < 2, "targets_ordered": F.col("sbp") <= F.col("dbp"),
    }
    if require_covariates:
        tests["covariates_present"] = null("age", "sex")
    empty = rows.agg(F.count("*").alias("n"))
    return together(checked(rows, F.col(key), tests), repeated(rows.where(F.col(key).isNotNull()), "segment_unique", [key]), broken(empty, "rows_present", F.col("n") == 0, F.lit("table")))


def split_violations(splits: DataFrame, subjects: DataFrame, folds: int, fingerprint: str | None = None) -> DataFrame:
    """Every subject once in each fold and a test subject of exactly one; all roles in each fold."""
    per_fold = splits.groupBy("subject_id", "fold").agg(F.count("*").alias("n"))
    tests = splits.groupBy("subject_id").agg(F.count_if(F.col("role") == "test").alias("tests"), F.countDistinct("fold").alias("folds"))
    roles = splits.groupBy("fold").agg(F.countDistinct("role").alias("roles"))
    known = subjects.select("subject_id").distinct()
    found = [
        broken(per_fold, "once_in_fold", F.col("n") > 1, F.concat_ws("|", "subject_id", "fold")),
        checked(tests, F.col("subject_id"), {"every_fold": (F.col("folds") != folds, F.col("folds")), "one_test_fold": (F.col("tests") != 1, F.col("tests"))}),
        broken(roles, "all_roles", F.col("roles") != 3, F.col("fold"), F.col("roles")),
        broken(splits, "fold_known", ~F.col("fold").between(0, folds - 1), F.col("fold")),
        broken(known.join(tests, "subject_id", "left_anti"), "subject_split", F.lit(True), F.col("subject_id")),
        broken(tests.join(known, "subject_id", "left_anti"), "subject_known", F.lit(True), F.col("subject_id")),
    ]
    if fingerprint is not None:
        found.append(broken(splits, "fingerprint", ~F.col("dataset_fingerprint").eqNullSafe(fingerprint), F.col("subject_id")))
    return together(*found)


def prediction_violations(rows: DataFrame, conditions: list[str], rtol: float = 1e-6, atol: float = 1e-3) -> DataFrame:
    """rows: segment_id, condition, output_scale, estimator_output, decoder_mean, decoder_sd, y_true, y_pred."""
    k, decoded = F.col("segment_id"), F.col("estimator_output") * F.col("decoder_sd") + F.col("decoder_mean")
    identity = F.col("output_scale") == "identity"
    return checked(rows, k, {
        "finite": ~(finite("y_true") & finite("y_pred")), "condition_known": (~F.col("condition").isin(*conditions), F.col("condition")),
        "identity_decoder": identity & ((F.col("decoder_mean") != 0) | (F.col("decoder_sd") != 1)), "reproduced": F.abs(decoded - F.col("y_pred")) > atol + rtol * F.abs("y_pred"),
    })


def subjects_apart(*parts: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Subjects that more than one of the parts has: violations of the rule that the parts' subjects are disjoint."""
    named = reduce(DataFrame.unionByName, (p.select(F.col(subject).cast("string").alias("subject")).distinct().withColumn("part", F.lit(k)) for k, p in enumerate(parts)))
    shared = named.groupBy("subject").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("part")).alias("parts"))
    return broken(shared, "subjects_apart", F.col("n") > 1, F.col("subject"), F.concat_ws(",", F.col("parts").cast("array<string>")))


def one_value(rows: DataFrame, expected: dict[str, str], key: list[str]) -> DataFrame:
    """Rows whose column is not the one value that all must have, such as a version or a policy."""
    return checked(rows, spelt(key), {f"{c}_is_{v}": (~F.col(c).cast("string").eqNullSafe(F.lit(v)), F.col(c)) for c, v in expected.items()})


def whole_folds(rows: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """Keys whose rows don't have all folds from 0 on, or have others or a fold that is no whole number."""
    fold = F.col("fold").cast("double")
    odd = F.count_if(fold.isNull() | (fold != F.floor(fold)) | (fold < 0) | (fold >= folds))
    seen = rows.groupBy(*keys).agg(F.count_distinct(fold).alias("n"), odd.alias("odd"))
    return checked(seen, spelt(keys), {"folds_whole": (F.col("odd") > 0, F.col("odd")), "folds_complete": (F.col("n") != folds, F.col("n"))})


def seeds_per_method(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose method doesn't have the seeds that `expected` (method, seeds array) names for it; null for methods without seeds."""
    seen = rows.groupBy(*keys, "method").agg(F.array_sort(F.collect_set("seed")).alias("have"))
    joined = seen.join(F.broadcast(expected.select("method", F.array_sort(F.coalesce("seeds", F.array().cast(seen.schema["have"].dataType))).alias("want"))), "method")  # a row for each method
    return broken(joined, "seeds_expected", F.col("have") != F.col("want"), spelt([*keys, "method"]), F.concat_ws(",", F.col("have").cast("array<string>")))


def matrix_violations(units: DataFrame, expected: DataFrame, keys: list[str], reference: str) -> DataFrame:
    """Expected (cohort, method) without rows, duplicates, and methods whose units or truths differ from the reference method's."""
    have = units.select(*expected.columns).distinct()
    base = units.where(F.col("method") == reference).select(*keys, F.col("y_true").alias("_y"))
    methods = have.select("cohort", "method").where(F.col("method") != reference).distinct()
    wanted = base.join(methods, "cohort")
    others = units.where(F.col("method") != reference).select(*keys, "method", "y_true")
    both = wanted.join(others, [*keys, "method"], "full_outer")
    key = F.concat_ws("|", "method", *keys)
    return together(
        broken(expected.join(have, expected.columns, "left_anti"), "combination_present", F.lit(True), F.concat_ws("|", *expected.columns)),
        repeated(units, "row_unique", ["method", *keys]),
        checked(both, key, {"same_rows": F.col("_y").isNull() | F.col("y_true").isNull(), "same_truth": F.abs(F.col("_y") - F.col("y_true")) > 1e-10}),
    )


def unit_violations(units: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicates, values that are not finite, subjects in two folds, truths that differ between methods, counts that are not positive.

    Only the methods are counted as different values: with a second such column Spark makes every row three and shuffles them again.
    """
    per = units.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.countDistinct("method").alias("methods"), (F.max("y_true") - F.min("y_true")).alias("range"), (F.min("n_segments") < F.max("n_segments")).alias("uneven"),
        F.count_if(~(finite("y_true") & finite("y_pred"))).alias("odd"), F.count_if(F.col("n_segments") <= 0).alias("empty"),
    )
    folds = units.groupBy("cohort", "subject_id").agg(F.countDistinct("fold").alias("folds"))
    return together(
        checked(per, spelt(keys), {
            "unit_unique": (F.col("rows") > F.col("methods"), F.col("rows")), "finite": (F.col("odd") > 0, F.col("odd")), "one_truth": F.col("range") > 1e-10,
            "equal_counts": F.col("uneven"), "counts_positive": (F.col("empty") > 0, F.col("empty")),
        }),
        broken(folds, "one_fold", F.col("folds") > 1, F.col("subject_id"), F.col("folds")),
    )


def seed_pairing_violations(units: DataFrame, keys: list[str]) -> DataFrame:
    """Units of a method that some of its seeds lack, or whose truth differs between seeds.

    Units are compared with their method's number of seeds where they were grouped: dealt out by cohort and method they would be a task for each of these.
    """
    seeds = written(units.groupBy("cohort", "method").agg(F.countDistinct("seed").alias("seeds")), "seeds")
    few = F.broadcast(seeds)  # a row for each cohort and method
    per = units.groupBy("method", *keys).agg(F.countDistinct("seed").alias("have"), (F.max("y_true") - F.min("y_true")).alias("range")).join(few, ["cohort", "method"])
    key = F.concat_ws("|", "method", *keys)
    return checked(per, key, {"seed_missing": (F.col("have") < F.col("seeds"), F.col("have")), "seed_truth": F.col("range") > 1e-10})


def output_violations(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return together(repeated(rows, "key_unique", keys), checked(rows, spelt(keys), {f"finite_{v}": ~finite(v) for v in values}))


def array_violations(rows: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """Arrays that are null, of another length, or hold what is not finite."""
    x = F.col(column)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return together(checked(rows, F.col(key), {"array_present": x.isNull(), "array_length": (F.size(x) != size, F.size(x)), "array_finite": odd}), repeated(rows, "array_key_unique", [key]))


def condition_violations(rows: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Combinations that the allowed ones lack."""
    return broken(rows.select(*on).distinct().join(F.broadcast(allowed.select(*on).distinct()), on, "left_anti"), "combination_allowed", F.lit(True), F.concat_ws("|", *on))  # a few named combinations


def exactly_one(rows: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """Expected keys with no row or several."""
    counted = expected.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return broken(counted, "exactly_one", F.col("n") != 1, F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), F.col("n"))


def session_violations(rows: DataFrame, length: int, place: int, key: str = "record_id") -> DataFrame:
    """rows: key, subject_id, session_id, session_position, onset. One subject a session, positions from 1 to length and each once, onsets at their place, ids of the agreed form."""
    owners = rows.groupBy("session_id").agg(F.countDistinct("subject_id").alias("n"))
    k = F.col(key)
    return together(
        broken(owners, "one_subject", F.col("n") > 1, F.col("session_id"), F.col("n")),
        checked(rows, k, {
            "position_in_session": (~F.col("session_position").between(1, length), F.col("session_position")), "onset_place": (F.col("onset") & (F.col("session_position") != place), F.col("session_position")),
            "session_id_form": (~F.col("session_id").rlike(r"-session-\d{2,}$"), F.col("session_id")),
        }),
        repeated(rows, "position_once", ["session_id", "session_position"]),
    )


def record_violations(rows: DataFrame, subject: str, expected: int, uniform: list[str]) -> DataFrame:
    """Subjects without the expected number of records, and columns that should have one value for all and don't."""
    counts = rows.groupBy(subject).agg(F.count("*").alias("n"))
    kinds = rows.agg(*(F.countDistinct(c).alias(c) for c in uniform))
    return together(broken(counts, "record_count", F.col("n") != expected, F.col(subject), F.col("n")), *(broken(kinds, f"uniform_{c}", F.col(c) > 1, F.lit(c), F.col(c)) for c in uniform))


def label_violations(units: DataFrame) -> DataFrame:
    """Units whose aggregation label doesn't say how many seeds they average."""
    want = F.when(F.col("n_seeds") > 1, "mean_over_seeds").otherwise("single_seed")
    return broken(units, "aggregation_label", ~F.col("aggregation_mode").eqNullSafe(want), F.concat_ws("|", "subject_id", "measurement_id"), F.col("aggregation_mode"))
