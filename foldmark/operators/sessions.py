"""Ordered records: sessions, nearest neighbours in order, and stopping rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import padded_id
from .scans import carried, running


def onsets(rows: DataFrame, keys: list[str], order: str, token: Column) -> DataFrame:
    """With `onset`: the token holds here and did not at the record before."""
    marked = carried(rows.withColumn("_now", F.coalesce(token, F.lit(False))), keys, [order], F.col("_now"), "_was")
    return marked.withColumn("onset", F.col("_now") & ~F.coalesce(F.col("_was"), F.lit(False))).drop("_now", "_was")


def session_starts(marked: DataFrame, keys: list[str], order: str, length: int, place: int) -> DataFrame:
    """(keys, start): where sessions begin, a row for each.

    Onsets are protocol marks: a session begins `place` - 1 records before each, if that isn't before the first record, and at the first record. Several
    such starts are trusted as they are; with one alone a session begins every `length` records. The last session is cut into pieces of `length`.
    """
    bounds = marked.groupBy(*keys).agg(F.min(order).alias("_low"), F.max(order).alias("_high"), F.max(F.when(F.col("onset"), F.col(order) - (place - 1))).alias("_at"))
    last = F.greatest("_low", F.coalesce("_at", "_low"))
    pieces = bounds.select(*keys, F.explode(F.sequence(last, F.greatest(last, F.col("_high")), F.lit(length))).alias("start"))
    low = bounds.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_low")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    marks = marked.where("onset").select(*keys, (F.col(order) - (place - 1)).alias("start")).join(low, same).where(F.col("start") >= F.col("_low")).select(*keys, "start")
    return marks.unionByName(pieces).unionByName(bounds.select(*keys, F.col("_low").alias("start"))).distinct()


def derived_sessions(marked: DataFrame, keys: list[str], order: str, length: int, place: int) -> DataFrame:
    """The records with session_index (from 1), session_position (from 1) and session_id.

    Starts and records are put into one order, in which each record takes the last start and the number of starts: no record meets all starts of its key.
    """
    starts = session_starts(marked, keys, order, length, place).select(*keys, F.col("start").alias(order)).withColumn("_start", F.lit(True))
    both = marked.withColumn("_start", F.lit(False)).unionByName(starts, allowMissingColumns=True).withColumn("_second", (~F.col("_start")).cast("int"))
    counted = running(both, keys, [order, "_second"], F.col("_start").cast("int"), "session_index")
    placed = carried(counted, keys, [order, "_second"], F.when(F.col("_start"), F.col(order)), "_from").where(~F.col("_start"))
    out = placed.withColumn("session_index", F.col("session_index").cast("int")).withColumn("session_position", (F.col(order) - F.col("_from") + 1).cast("int")).drop("_start", "_second", "_from")
    return out.withColumn("session_id", F.concat_ws("-session-", F.concat_ws("-", *(F.col(k).cast("string") for k in keys)), padded_id(F.col("session_index").cast("string"), 2)))


def session_errors(sessions: DataFrame, keys: list[str], length: int, place: int) -> DataFrame:
    """(keys, reason): keys whose records can't be derived sessions: one is longer than `length`, or an onset is not at its `place`."""
    long = F.max(F.col("session_position")) > length
    moved = F.bool_or(F.col("onset") & (F.col("session_position") != place))
    return sessions.groupBy(*keys).agg(F.when(long, "session_too_long").when(moved, "onset_out_of_place").alias("reason")).where("reason is not null")


def checked_sessions(sessions: DataFrame, keys: list[str], length: int, place: int) -> DataFrame:
    """The sessions, where session_errors() finds nothing; else it raises."""
    bad = session_errors(sessions, keys, length, place).limit(3).collect()
    if bad:
        raise ValueError("sessions can't be derived: " + "; ".join(f"{[r[k] for k in keys]} {r['reason']}" for r in bad))
    return sessions


def nearest(rows: DataFrame, keys: list[str], order: list[str], here: Column, mark: Column, value: str) -> DataFrame:
    """Rows where `here` holds, with the value of the nearest earlier and later row where `mark` holds."""
    marked = F.when(mark, F.col(value))
    found = carried(rows, keys, order, marked, "previous_value")
    return carried(found, keys, order, marked, "next_value", later=True).where(here)


def selected_epochs(history: DataFrame, run: list[str], epoch: str, score: str, patience: int) -> DataFrame:
    """(run, best_epoch, best_score, stopped_epoch): the best epoch before training stops, `patience` epochs after the last strict improvement."""
    own = Window.partitionBy(*run).orderBy(epoch)
    marked = history.withColumn("_least", F.min(score).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("_last", F.max(F.when(F.col("_least").isNull() | (F.col(score) < F.col("_least")), F.col(epoch))).over(own))
    stops = marked.withColumn("_stop", F.min(F.when(F.col(epoch) - F.col("_last") >= patience, F.col(epoch))).over(Window.partitionBy(*run)))
    seen = stops.where(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    return seen.groupBy(*run).agg(F.min_by(epoch, F.struct(score, epoch)).alias("best_epoch"), F.min(score).alias("best_score"), F.max(epoch).alias("stopped_epoch"))


def selected_rate(epochs: DataFrame, keys: list[str], rate: str) -> DataFrame:
    """For each of the keys the learning rate with the smallest best score (the smaller rate of equal ones) and its epoch, for reuse by other seeds."""
    return epochs.groupBy(*keys).agg(F.min_by(F.struct(rate, "best_epoch", "best_score"), F.struct("best_score", rate)).alias("_s")).select(*keys, f"_s.{rate}", "_s.best_epoch", "_s.best_score")
