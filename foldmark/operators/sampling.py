"""Sampling of subjects and rows, splits into folds, quantile bins; all by seeded md5 orders, so independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import order_key
from .scans import exact_quantiles, numbered_from


def quantile_edges(rows: DataFrame, keys: list[str], columns: list[str], bins: int) -> DataFrame:
    """(keys, edges_<column>): the different interior quantiles; no buffer holds a group's values. Empty where a group has no value."""
    shares, out = [k / bins for k in range(1, bins)], rows.select(*keys).distinct()
    for c in columns:
        edges = exact_quantiles(rows, keys, c, shares, "_edges").select(*keys, F.array_distinct("_edges").alias(f"edges_{c}"))
        out = out.join(edges, keys, "left").withColumn(f"edges_{c}", F.coalesce(f"edges_{c}", F.array().cast("array<double>")))
    return out


def bin_of(value: Column, edges: Column, missing: int | None = -1) -> Column:
    """How many edges lie strictly below the value; a missing value is in the bin `missing`."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(F.size(F.filter(edges, lambda e: e < value)))


def subject_table(rows: DataFrame, keys: list[str], values: list[str], first: str, by: str) -> DataFrame:
    """One row for each subject: the category of its first row in the order of `by`, medians of values, number of rows."""
    return rows.groupBy(*keys, "subject_id").agg(F.min_by(first, by).alias(first), *(F.percentile(v, F.lit(0.5)).alias(v) for v in values), F.count("*").alias("n_rows"))


def allocation(subjects: DataFrame, stratum: str, limit: int) -> DataFrame:
    """(stratum, n, quota): how many of each stratum's subjects a sample of `limit` takes; all where there are no more.

    The floor of its share each, at least 1 where the strata allow that. What is then too much goes one by one from the stratum whose quota is furthest above
    its share and over 1, what is missing to the one furthest below; of equal ones the first by name. As each step moves a stratum by one place in that
    order, the steps are the first rows of all possible ones in the order: a window over at most `limit` rows, no loop.
    """
    sizes = subjects.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("<NA>")).alias("stratum")).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("_all"), F.count("*").alias("_strata"))
    ideal = F.col("n") * (F.lit(float(limit)) / F.col("_all"))
    shares = sizes.crossJoin(F.broadcast(whole)).withColumn("_ideal", ideal)  # one row
    floor = F.floor("_ideal").cast("long")
    first = shares.withColumn("_first", F.when(F.col("_all") <= limit, F.col("n")).when((floor == 0) & (F.col("_strata") <= limit), 1).otherwise(floor))
    moves = first.crossJoin(F.broadcast(first.agg((F.sum("_first") - F.least(F.max("_all"), F.lit(limit))).alias("_over"))))
    down = moves.where("_over > 0 and _first > 1").withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_first") - 2, F.col("_over") - 1)))).withColumn("_rank", F.col("_ideal") - F.col("_first") + F.col("_step"))
    up = moves.where("_over < 0 and _first < n").withColumn("_step", F.lit(0).cast("long")).withColumn("_rank", F.col("_first") - F.col("_ideal"))
    taken = down.unionByName(up).withColumn("_place", F.row_number().over(Window.orderBy("_rank", "stratum"))).where("_place <= abs(_over)")
    change = taken.groupBy("stratum").agg(F.sum(-F.signum("_over")).cast("long").alias("_change"))
    return moves.join(change, "stratum", "left").select("stratum", "n", (F.col("_first") + F.coalesce("_change", F.lit(0).cast("long"))).alias("quota"))


def stratified_sample(subjects: DataFrame, stratum: str, limit: int, seed: str, eligible: Column | None = None) -> DataFrame:
    """`limit` of the eligible subjects, strata in proportion (see allocation), chosen inside a stratum by the seeded order.

    Raises where a subject is there twice, and where fewer than `limit` are eligible.
    """
    rows = subjects if eligible is None else subjects.where(eligible)
    n, different = rows.agg(F.count("*"), F.count_distinct("subject_id")).first()
    if n != different:
        raise ValueError(f"stratified_sample: {n - different} of {n} rows repeat a subject")
    if n < limit:
        raise ValueError(f"stratified_sample: {limit} subjects are asked for, {n} are eligible")
    label = F.coalesce(F.col(stratum).cast("string"), F.lit("<NA>"))
    keyed = rows.withColumn("_label", label).withColumn("_key", order_key(seed, "subject_id"))
    placed = numbered_from(keyed, ["_label"], ["_key", "subject_id"], "_place")
    quotas = allocation(rows, stratum, limit).select(F.col("stratum").alias("_label"), "quota")
    return placed.join(quotas, "_label").where("_place < quota").drop("_place", "_label", "_key", "quota")


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k of each group's n rows in the order, at places floor(i (n - 1) / (k - 1)); all where n <= k, the first where k is 1."""
    own = Window.partitionBy(*keys)
    placed = rows.withColumn("_place", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(own))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(max(k - 1, 1))).cast("int"))
    return placed.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_place"))).drop("_place", "_n")


def capped(rows: DataFrame, keys: list[str], row_key: list[str], most: int, seed: str, epoch: int = 0) -> DataFrame:
    """At most `most` rows of each group, another choice for each epoch."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order_key(f"{seed}|{epoch}", *row_key), *row_key))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def round_robin_capped(rows: DataFrame, subject: list[str], measurement: str, row_key: list[str], most: int, seed: str) -> DataFrame:
    """At most `most` rows of each subject, taken in turns from its measurements."""
    turn = F.row_number().over(Window.partitionBy(*subject, measurement).orderBy(order_key(seed, *row_key), *row_key))
    place = F.row_number().over(Window.partitionBy(*subject).orderBy("_turn", F.col(measurement).cast("string"), *row_key))
    return rows.withColumn("_turn", turn).withColumn("_place", place).where(F.col("_place") <= most).drop("_turn", "_place")


def usable_label(subjects: DataFrame, labels: list[str], least: int) -> str | None:
    """The first of the labels, from full to short, whose smallest class has `least` subjects; None where none has."""
    for label in labels:
        low = subjects.groupBy(label).count().agg(F.min("count")).first()[0]
        if low is not None and low >= least:
            return label
    return None


def numbered(rows: DataFrame, stratum: str | None, key: Column, out: str) -> DataFrame:
    """Rows numbered from 1 in the order (stratum, key): within a stratum by a window, plus where the stratum starts, so no window holds all rows."""
    label = F.col(stratum).cast("string") if stratum else F.lit("")
    placed = rows.withColumn("_label", F.coalesce(label, F.lit("<NA>"))).withColumn("_rn", F.row_number().over(Window.partitionBy("_label").orderBy(key, "subject_id")))
    sizes = placed.groupBy("_label").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_label", "_start")  # a row for each stratum
    return placed.join(starts, "_label").withColumn(out, F.col("_rn") + F.col("_start")).drop("_label", "_rn", "_start")


def split_manifest(subjects: DataFrame, outer: str | None, inner: str | None, folds: int, seed: int, share: tuple[int, int] = (1, 5), fingerprint: str = "") -> DataFrame:
    """(subject_id, fold, role, split_seed, outer_method, validation_method, dataset_fingerprint): every subject once in each fold.

    Test folds go round the subjects in the order (stratum, md5). In each fold the rest is numbered likewise with the fold's own
    seed, and a row is for validation where the ceiling of its share of the places rises.
    """
    up, down = share
    tested = numbered(subjects, outer, order_key(str(seed), "subject_id"), "_place").withColumn("test_fold", F.pmod(F.col("_place") - 1, F.lit(folds)).cast("int"))
    each = tested.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rest = each.where("fold <> test_fold")
    label = F.coalesce(F.col(inner).cast("string"), F.lit("<NA>")) if inner else F.lit("")
    rest = rest.withColumn("_label", label).withColumn("_rn", F.row_number().over(Window.partitionBy("fold", "_label").orderBy(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed) + F.col("fold"), F.col("subject_id").cast("string"))), 1, 12), 16, 10).cast("long"), "subject_id")))
    starts = rest.groupBy("fold", "_label").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy("fold").orderBy("_label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.col("_rn") + F.col("_start")
    above = lambda x: F.floor((x * up + down - 1) / down)
    chosen = rest.join(starts, ["fold", "_label"]).select("subject_id", "fold", F.when(above(place) > above(place - 1), "validation").otherwise("train").alias("role"))
    both = chosen.unionByName(each.where("fold = test_fold").select("subject_id", "fold", F.lit("test").alias("role")))
    return both.select("*", F.lit(seed).alias("split_seed"), F.lit(outer or "none").alias("outer_method"), F.lit(inner or "none").alias("validation_method"), F.lit(fingerprint).alias("dataset_fingerprint"))


def benchmark_splits(subjects: DataFrame, labels: list[str], folds: int = 5, seed: int = 0, share: tuple[int, int] = (1, 5), fingerprint: str = "") -> DataFrame:
    """split_manifest() with the strata that the subjects allow: of the labels, from full to short, the first whose smallest class has a subject for each
    fold, and within the folds the first whose smallest class of every fold's rest has two; without any the subjects are not stratified.
    """
    if folds < 2:
        raise ValueError("benchmark_splits: two folds or more")
    if subjects.limit(folds).count() < folds:
        raise ValueError(f"benchmark_splits: fewer subjects than {folds} folds")
    outer = usable_label(subjects, labels, folds)
    placed = numbered(subjects, outer, order_key(str(seed), "subject_id"), "_place").withColumn("_test", F.pmod(F.col("_place") - 1, F.lit(folds)))
    inner = None
    for label in labels:
        counts = placed.groupBy(label, "_test").agg(F.count("*").alias("n"))
        classes = counts.groupBy(label).agg(F.sum("n").alias("all"))
        rest = counts.join(classes, label).select(F.when((F.col("all") > F.col("n")), F.col("all") - F.col("n")).alias("left")).agg(F.min("left")).first()[0]
        most = classes.agg(F.min("all")).first()[0]
        if most is not None and most >= 2 and (rest is None or rest >= 2):
            inner = label
            break
    return split_manifest(subjects, outer, inner, folds, seed, share, fingerprint)


def refreshed(splits: DataFrame, fingerprint: str) -> DataFrame:
    """The same assignments under another dataset identity."""
    return splits.withColumn("dataset_fingerprint", F.lit(fingerprint))


def group_folds(rows: DataFrame, pool: list[str], group: str, folds: int) -> DataFrame:
    """(pool, group, n_rows, inner_fold): groups by size, largest first, dealt to min(folds, groups) folds forth and back."""
    sizes = rows.groupBy(*pool, group).agg(F.count("*").alias("n_rows")).withColumn("_less", -F.col("n_rows"))
    placed = numbered_from(sizes, pool, ["_less", group], "_p").join(sizes.groupBy(*pool).agg(F.least(F.lit(folds), F.count("*")).cast("int").alias("_k")), pool)
    turn, step = F.floor(F.col("_p") / F.col("_k")).cast("int"), F.pmod(F.col("_p"), F.col("_k"))
    return placed.withColumn("inner_fold", F.when(turn % 2 == 0, step).otherwise(F.col("_k") - 1 - step).cast("int")).drop("_p", "_k", "_less")


def rows_for_role(rows: DataFrame, splits: DataFrame, fold: int, role: str) -> DataFrame:
    return rows.join(splits.where((F.col("fold") == fold) & (F.col("role") == role)).select("subject_id"), "subject_id", "left_semi")
