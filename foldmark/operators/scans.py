"""Running totals, nearest values and exact quantiles inside groups of any size, each over many tasks.

A window over one group runs in one task. Here a heavy group is cut into ranges of its order first: its bounds come from a sample of the ordering
values, each range has its own window, and what stands before a range is the sum of the ranges before it (a scan of two levels). Quantiles need no
order at all: ranges of values are counted, the range that holds a rank is refined until it is small or one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: A group with more rows than this, and with more than one of RANGES rows of the frame, is cut; so there are 2 * RANGES ranges at most.
ROWS, RANGES = 1 << 20, 1000
#: Sampled ordering values for each range.
SAMPLED = 24


def _same(keys: list[str]) -> Column:
    return F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))


def ranges(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """The rows with `_range`: 0 in groups of up to `most` rows, else the number of the range of the order that the row is in.

    Rows with equal ordering values are in one range. What reaches the driver is the heavy groups' keys and SAMPLED ordering values for each range.
    """
    spark, group, at = rows.sparkSession, _same(keys), F.struct(*(F.col(c) for c in order))
    sizes = rows.groupBy(group.alias("_g")).agg(F.count("*").alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    least = max(ROWS if most is None else most, (total or 0) // RANGES)
    if (largest or 0) <= least:
        return rows.withColumn("_range", F.lit(0))
    heavy = sizes.where(F.col("_n") > least)
    names = heavy.collect()  # RANGES at most
    held = spark.createDataFrame(names, heavy.schema)
    slots = 1 << 20
    taken = F.pmod(F.xxhash64(*order), F.lit(slots)) < F.lit(slots * SAMPLED / least)
    sample = rows.select(group.alias("_g"), at.alias("_at")).where(taken).join(F.broadcast(held), "_g").groupBy("_g").agg(F.sort_array(F.collect_set("_at")).alias("_s"), F.first("_n").alias("_n")).collect()
    bounds = []
    for r in sample:
        parts = -(-r["_n"] // least)
        bounds.append((r["_g"], [r["_s"][i * len(r["_s"]) // parts] for i in range(1, parts) if len(r["_s"]) >= parts]))
    made = spark.createDataFrame(bounds, f"_g {heavy.schema['_g'].dataType.simpleString()}, _bounds array<{rows.select(at.alias('x')).schema['x'].dataType.simpleString()}>")
    # two steps of the bounds' square root: which block of bounds, which bound in it
    step = 32
    blocks = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size("_bounds") - 1) / step).cast("int")), lambda i: F.get("_bounds", i * step)), lambda b: b <= at))
    inside = F.size(F.filter(F.slice("_bounds", F.greatest(blocks - 1, F.lit(0)) * step + 1, F.lit(step)), lambda b: b <= at))
    place = F.when(F.size("_bounds") > 0, F.greatest(blocks - 1, F.lit(0)) * step + inside)
    found = rows.join(F.broadcast(made), group == F.col("_g"), "left")
    return found.withColumn("_range", F.coalesce(place, F.lit(0)).cast("int")).drop("_g", "_bounds")


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, most: int | None = None) -> DataFrame:
    """The rows with `out`: the sum of the value over the rows before, in the order within the keys (ascending, nulls first; it should have no ties)."""
    cut = ranges(rows, keys, order, most).withColumn("_value", value)
    sums = cut.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), before.alias("_earlier")).where("_earlier is not null")  # ranges of heavy groups: 2 * RANGES at most
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_r"))
    inside = F.sum("_value").over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.withColumn("_inside", inside).join(F.broadcast(offsets), on, "left")
    zero = F.lit(0)
    return placed.withColumn(out, F.coalesce("_inside", zero) + F.coalesce("_earlier", zero)).drop("_range", "_value", "_inside", "_earlier", "_r", *(f"_k_{k}" for k in keys))


def numbered_from(rows: DataFrame, keys: list[str], order: list[str], out: str, most: int | None = None) -> DataFrame:
    """The rows numbered from 0 in the order within the keys."""
    return running(rows, keys, order, F.lit(1), out, most)


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, later: bool = False, here: bool = False, most: int | None = None) -> DataFrame:
    """The rows with `out`: the value of the nearest row before (or after: later) in the order within the keys that has one; here: the row's own counts.

    Heavy groups are cut into ranges; what a range has last (or first) is carried over those after (before) it, so no task holds a group.
    """
    cut = ranges(rows, keys, order, most).withColumn("_value", value)
    place, pick = F.struct(*(F.col(c) for c in order)), F.min_by if later else F.max_by
    ends = cut.where(F.col("_value").isNotNull()).groupBy(*keys, "_range").agg(pick("_value", place).alias("_end"))
    # a row for each range, so that ranges without a value take it over too
    every = cut.select(*keys, "_range").distinct().join(ends.withColumnRenamed("_range", "_r0").select(*(F.col(k).alias(f"_e_{k}") for k in keys), "_r0", "_end"), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys], F.col("_range") == F.col("_r0")), "left")
    over = Window.partitionBy(*keys).orderBy(F.desc("_range") if later else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = every.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), F.last("_end", ignorenulls=True).over(over).alias("_carried")).where("_carried is not null")  # ranges of heavy groups: 2 * RANGES at most
    own = Window.partitionBy(*keys, "_range").orderBy(*(F.desc(c) if later else F.asc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0 if here else -1)
    near = F.last("_value", ignorenulls=True).over(own)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_r"))
    found = cut.withColumn("_near", near).join(F.broadcast(offsets), on, "left")
    return found.withColumn(out, F.coalesce("_near", "_carried")).drop("_range", "_value", "_near", "_carried", "_r", *(f"_k_{k}" for k in keys))


#: A range of this many rows is sorted instead of counted again; ranges that one count makes of a range.
SORTED, PARTS = 1 << 16, 1 << 10
#: Refinements at most; each leaves a range's rows in PARTS parts of its width, so a few do. What is larger then is sorted in one task.
ROUNDS = 12


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], out: str = "quantiles", small: int = SORTED) -> DataFrame:
    """(keys, out array<double>): the interpolated quantiles of each group's values, as percentile() gives them, in the order of the shares.

    Nulls and values that are not finite are left out; a group without a value has no row. No buffer holds a group's values: ranges of values are counted.
    """
    x = F.col(value).cast("double")
    known = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(*keys, (x + F.lit(0.0)).alias("_x"))
    found = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)))).alias("_p")
    at = F.col("_p.s") * (F.col("_n") - 1)
    wanted = found.select("*", places).select(*keys, "_n", "_low", "_high", F.col("_p.i").alias("_i"), at.alias("_at"))
    ends = F.explode(F.array(*(F.struct(F.lit(e).alias("e"), f("_at").cast("long").alias("rank")) for e, f in ((0, F.floor), (1, F.ceil))))).alias("_e")
    # a rank is sought in [low, high], before which `_before` of the group's values lie
    columns = ["_i", "_at", "_low", "_high", "_before", "_size", "_rank"]
    targets = wanted.select(*keys, "_i", "_at", "_low", "_high", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_size"), ends).select(*keys, *columns[:-1], F.col("_e.rank").alias("_rank"))
    same = lambda frame: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(frame[f"_k_{k}"]) for k in keys], F.lit(True))
    renamed = [F.col(k).alias(f"_k_{k}") for k in keys]
    targets = written(targets, "ranks")  # a few rows for each group, whatever the rows are
    for _ in range(ROUNDS):
        large = (F.col("_size") > small) & (F.col("_low") < F.col("_high"))
        if targets.where(large).isEmpty():
            break
        sought = targets.where(large).select(*renamed, "_low", "_high").distinct()
        inside = known.join(sought, same(sought) & F.col("_x").between(F.col("_low"), F.col("_high")))  # ranges of a group don't overlap
        width = F.col("_high") / PARTS - F.col("_low") / PARTS
        part = F.least(F.floor((F.col("_x") / PARTS - F.col("_low") / PARTS) / F.when(width > 0, width) * PARTS), F.lit(PARTS - 1))
        parts = inside.groupBy(*(f"_k_{k}" for k in keys), "_low", F.coalesce(part, F.lit(0)).alias("_part")).agg(F.count("*").alias("_m"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*(f"_k_{k}" for k in keys), "_low").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # PARTS rows
        parts = parts.withColumn("_lower", before).withColumnRenamed("_low", "_of")
        hit = same(parts) & (F.col("_low") == F.col("_of")) & (F.col("_rank") >= F.col("_before") + F.col("_lower")) & (F.col("_rank") < F.col("_before") + F.col("_lower") + F.col("_m"))
        finer = targets.where(large).join(parts, hit).select(*keys, "_i", "_at", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_before") + F.col("_lower")).alias("_before"), F.col("_m").alias("_size"), "_rank")
        targets = written(targets.where(~large).select(*keys, *columns).unionByName(finer), "ranks")
    # what is left of each range is small: its different values are counted and sorted
    sought = targets.where("_low < _high").select(*renamed, "_low", "_high").distinct()
    names = [f"_k_{k}" for k in keys]
    values = known.join(sought, same(sought) & F.col("_x").between(F.col("_low"), F.col("_high"))).groupBy(*names, "_low", "_x").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*names, "_low").orderBy("_x"))
    values = values.withColumn("_upto", upto).withColumnRenamed("_low", "_of")
    hit = same(values) & (F.col("_low") == F.col("_of")) & (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_m")) & (F.col("_rank") < F.col("_before") + F.col("_upto"))
    found = targets.where("_low = _high").select(*keys, "_i", "_at", "_rank", F.col("_low").alias("_v"))
    found = found.unionByName(targets.where("_low < _high").join(values, hit).select(*keys, "_i", "_at", "_rank", F.col("_x").alias("_v")))
    lower, upper, at = F.min_by("_v", "_rank"), F.max_by("_v", "_rank"), F.first("_at")
    between = F.when(lower == upper, lower).otherwise((F.ceil(at) - at) * lower + (at - F.floor(at)) * upper)
    each = found.groupBy(*keys, "_i").agg(between.alias("_q"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_q"))).alias("_all")).select(*keys, F.col("_all._q").alias(out))


__all__ = ["carried", "exact_quantiles", "numbered_from", "ranges", "running"]
