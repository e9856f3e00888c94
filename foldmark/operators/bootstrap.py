"""Subject bootstrap from per-subject moments, by sums that each task keeps for all replicates.

A replicate weighs every subject by how often it is drawn: a Poisson(1) number, which is what drawing with replacement gives a subject where there
are many. The numbers come from one md5 stream for each subject, seeded with the group and the subject, four of 32 bits from a digest; so the draws are
the same for every method of the group (which pairing needs) and in every engine, and they need no numbering of subjects and no join.

A subject's rows of all keys meet in one row. A task draws each subject once for all replicates and adds (replicates x subjects) times (subjects x values)
to a matrix for each key, so no row is multiplied; what is shuffled is a row of sums for each task, key and replicate, however many subjects there are.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..sources.shared import written
from .scans import numbered_from
from .scoring import METRICS, MOMENTS, metric_columns, metrics_of_moments, seed_summary, subject_moments

#: Subjects that are drawn at a time, and bytes of sums that a task keeps before it passes them on.
STEP, KEPT_BYTES = 64, 1 << 27

# The probabilities that a Poisson(1) number is at most 0, 1, 2 ...; the last is 1 to 32 bits.
_AT_MOST = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(16))
LIMITS = tuple(int(p * 2**32) for p in _AT_MOST if p * 2**32 < 2**32 - 1)
DRAWS = 4  # of a digest


def indexed(subjects: DataFrame, group: list[str]) -> DataFrame:
    """(group, subject_id, idx, n): subjects numbered from 0 by id as text within the group."""
    people = subjects.select(*group, "subject_id").distinct().withColumn("_text", F.col("subject_id").cast("string"))
    placed = numbered_from(people, group, ["_text"], "idx").drop("_text").withColumn("idx", F.col("idx").cast("int"))
    return placed.join(people.groupBy(*group).agg(F.count("*").alias("n")), group) if group else placed.crossJoin(F.broadcast(people.agg(F.count("*").alias("n"))))  # one row


def times_drawn(streams: list[str], replicates: int) -> np.ndarray:
    """How often each replicate draws the subjects with these streams: an array of (subjects, replicates)."""
    blocks = [b"|%d" % k for k in range(-(-replicates // DRAWS))]
    limits = np.array(LIMITS, np.int64)
    out = np.empty((len(streams), replicates))
    for row, stream in zip(out, streams, strict=True):
        start = hashlib.md5(stream.encode(), usedforsecurity=False)
        digests = []
        for block in blocks:
            digest = start.copy()
            digest.update(block)
            digests.append(digest.digest())
        row[:] = np.searchsorted(limits, np.frombuffer(b"".join(digests), ">u4")[:replicates].astype(np.int64), "right")
    return out


class _Sums:
    """A task's sums by key: for each replicate the times drawn and the sums of the values."""

    def __init__(self, replicates: int, values: int):
        self.shape, self.by_key = (replicates, values + 1), {}

    def add(self, times: np.ndarray, people: list[list[dict]], key_names: list[str], shared: list[tuple]) -> None:
        of_key: dict[tuple, tuple[list[int], list[list[float]]]] = {}
        for k, rows in enumerate(people):
            for row in rows:
                places, values = of_key.setdefault((*shared[k], *(row[n] for n in key_names)), ([], []))
                places.append(k)
                values.append([1.0, *row["values"]])
        for key, (places, values) in of_key.items():
            if key not in self.by_key:
                self.by_key[key] = np.zeros(self.shape)
            self.by_key[key] += times[places].T @ np.array(values)

    def bytes(self) -> int:
        return len(self.by_key) * self.shape[0] * self.shape[1] * 8


def replicate_sums(rows: DataFrame, group: list[str], keys: list[str], values: list[str], replicates: int, seed: str = "boot") -> DataFrame:
    """(keys, replicate, times, values...): sums over the drawn subjects, each value times how often its subject is drawn.

    rows: one for each subject of each of the keys, which contain the group. Rows with a null among the values are left out. A replicate that draws no
    subject of a key has no row.
    """
    own = [k for k in keys if k not in group]
    known = reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in values))
    stream = F.concat_ws("|", F.lit(seed), *(F.col(g).cast("string") for g in group), F.col("subject_id").cast("string"))
    packed = rows.where(known).select(stream.alias("_stream"), *group, F.struct(*own, F.array(*(F.col(v).cast("double") for v in values)).alias("values")).alias("_row"))
    # the draws are the work, not the bytes: as many tasks as the session's shuffles have, whatever the rows' size is
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    people = packed.repartition(tasks, "_stream").groupBy("_stream", *group).agg(F.collect_list("_row").alias("_rows"))  # a row for each of a subject's keys
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    order = [*group, *own]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in order), "replicate int", "times double", *(f"`{v}` double" for v in values)])

    def run(batches):
        sums, types = _Sums(replicates, len(values)), None

        def passed_on():
            for key, x in sums.by_key.items():
                drawn = np.flatnonzero(x[:, 0])
                columns = [pa.array([k] * len(drawn), t) for k, t in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(drawn, pa.int32()), *(pa.array(c) for c in x[drawn].T.copy())], [*order, "replicate", "times", *values])
            sums.by_key.clear()

        for batch in batches:
            inner = batch.schema.field("_rows").type.value_type
            types = [*(batch.schema.field(g).type for g in group), *(inner.field(k).type for k in own)]
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                shared = list(zip(*(part.column(g).to_pylist() for g in group), strict=True)) if group else [()] * part.num_rows
                sums.add(times_drawn(part.column("_stream").to_pylist(), replicates), part.column("_rows").to_pylist(), own, shared)
                if sums.bytes() > KEPT_BYTES:
                    yield from passed_on()
        yield from passed_on()

    return people.mapInArrow(run, schema).groupBy(*keys, "replicate").agg(*(F.sum(c).alias(c) for c in ("times", *values)))


def replicate_metrics(moments: DataFrame, group: list[str], keys: list[str], replicates: int, seed: str = "boot") -> DataFrame:
    """Metrics of every replicate for each of the keys (which contain the group).

    The moments are read twice, so a table of them should be given.
    """
    # about the keys' own level, so that no large squares are subtracted
    # a row for each of the keys, for which tasks keep sums: joined by them, moments would be dealt out to as few tasks as there are keys
    level = F.broadcast(moments.groupBy(*keys).agg(F.avg("y").alias("_cy"), F.avg("p").alias("_cp")))
    y, p = F.col("y") - F.col("_cy"), F.col("p") - F.col("_cp")
    squares = {"var_y": F.col("var_y") + y * y, "var_p": F.col("var_p") + p * p, "cov": F.col("cov") + y * p, "y": y, "p": p}
    about = moments.join(level, keys).withColumns(squares)
    sums = replicate_sums(about, group, keys, list(MOMENTS), replicates, seed)
    means = sums.select(*keys, "replicate", *(safe_ratio(F.col(m), F.col("times")).alias(m) for m in MOMENTS)).join(level, keys)
    y, p = F.col("y"), F.col("p")
    means = means.withColumns({"var_y": F.col("var_y") - y * y, "var_p": F.col("var_p") - p * p, "cov": F.col("cov") - y * p, "y": y + F.col("_cy"), "p": p + F.col("_cp")})
    return means.select(*keys, "replicate", *(c.alias(n) for n, c in metric_columns().items()))


def interval(x: Column | str, level: float = 0.95, low: bool = True) -> Column:
    """A percentile bound of the values that are not null."""
    tail = (1 - level) / 2
    return F.percentile(F.col(x) if isinstance(x, str) else x, F.lit(tail if low else 1 - tail))


def metric_intervals(moments: DataFrame, group: list[str], keys: list[str], replicates: int, seed: str = "boot", level: float = 0.95, metrics: tuple = METRICS) -> DataFrame:
    """(keys, metric_ci_low, metric_ci_high ...) of the metrics."""
    many = replicate_metrics(moments, group, keys, replicates, seed)
    return many.groupBy(*keys).agg(*(interval(m, level, low).alias(f"{m}_ci_{'low' if low else 'high'}") for m in metrics for low in (True, False)))


def seed_mean_intervals(moments: DataFrame, group: list[str], keys: list[str], replicates: int, seed: str = "boot", level: float = 0.95, metrics: tuple = METRICS) -> DataFrame:
    """Intervals of the mean over seeds of each seed's metric, the same draw for every seed; a replicate in which a seed's metric is undefined is left out."""
    many = replicate_metrics(moments, group, [*keys, "seed"], replicates, seed)
    whole = many.groupBy(*keys, "replicate").agg(*(F.when(F.count(m) == F.count("*"), F.avg(m)).alias(m) for m in metrics))
    return whole.groupBy(*keys).agg(*(interval(m, level, low).alias(f"{m}_ci_{'low' if low else 'high'}") for m in metrics for low in (True, False)))


def benchmark_summary(units: DataFrame, group: list[str], keys: list[str], replicates: int, seed: str = "summary", level: float = 0.95) -> DataFrame:
    """(keys, n_subjects, n_measurements, n_seeds, and for each metric its mean over seeds, _seed_sd, _ci_low, _ci_high) from units by seed, in one call.

    Raises where the seeds of one of the keys have different numbers of subjects or measurements, which averages over seeds can't stand for.
    """
    moments = written(subject_moments(units, [*keys, "seed"]), "moments")
    metrics = metrics_of_moments(moments, [*keys, "seed"])
    uneven = metrics.groupBy(*keys).agg((F.count_distinct("n_subjects", "n_measurements") > 1).alias("_uneven")).where("_uneven").limit(3).collect()
    if uneven:
        raise ValueError(f"benchmark_summary: seeds of {[[r[k] for k in keys] for r in uneven]} score different units")
    return seed_summary(metrics, keys).join(seed_mean_intervals(moments, group, keys, replicates, seed, level), keys)


def mean_intervals(values: DataFrame, group: list[str], keys: list[str], replicates: int, value: str = "delta", seed: str = "boot", level: float = 0.95) -> DataFrame:
    """(keys, ci_low, ci_high, p_below_zero) of the mean over subjects of a value."""
    means = replicate_sums(values, group, keys, [value], replicates, seed).select(*keys, safe_ratio(F.col(value), F.col("times")).alias("mean"))
    return means.groupBy(*keys).agg(interval("mean", level).alias("ci_low"), interval("mean", level, False).alias("ci_high"), F.avg((F.col("mean") < 0).cast("double")).alias("p_below_zero"))


__all__ = ["METRICS", "MOMENTS", "benchmark_summary", "indexed", "times_drawn", "interval", "mean_intervals", "metric_intervals", "replicate_metrics", "replicate_sums", "seed_mean_intervals"]
