"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the sources, by code point with null last, take the weights in turn and share TOTAL words in that proportion; a target
stops at MOST times the source's own words and the excess goes to the others by weight until none is above (water filling, solved in
closed form over the sources sorted by where they are full).

Draw: a source's documents are permuted by a keyed hash of id and text and cut into blocks of equal hash ranges, about BLOCK_ROWS documents or
1/MOST_BLOCKS of the source each. It is taken as many whole times as fit its target; the rest takes the blocks in order up to the one
in which it is reached; that one is cut into blocks again by further bits of the hash, and in the one of these in which it is reached documents
are taken in order as long as they fit. So a source's words miss its target by less than its smallest left-over document of that block.

Shards: a source's block quota (repeats counted) is split among the output shards by recursive halving; at each node the left half
draws from the sources' blocks without replacement, so each source's quotas add up exactly. A shard then takes disjoint runs of each
source's permuted blocks, and `position` is a keyed order for the shuffle within a shard. mixed() puts the copies in this order.

Sources may be as many as the documents: their numbers and the water level come from scans over ranges, their quotas are split in groups of
GROUP_SOURCES (first among the groups, then among the sources of each, which is the same distribution), and rows meet their source by a
broadcast of up to BROADCAST_SOURCES of them, else by a join that deals large sources to many tasks. What reaches the driver is a row for each such group.

Edge cases: a null text has no words; documents without words are mixed like others but take nothing; a null source is a source of its
own, the last; one source alone has its own size as target; repeated rows and doc_ids are rows of their own, and equal rows are next to each
other in the order; an empty table gives an empty result; extra columns are not read by draw() and are kept by mixed(), but for columns named
shard and position, which are set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scans
from . import common

WEIGHTS, MOST = (5, 2, 1), 3
BLOCK_ROWS, MOST_BLOCKS, SHARDS = 1024, 4096, 64
#: Sources whose table is broadcast (some hundred bytes each), and sources whose quotas one task splits.
BROADCAST_SOURCES, GROUP_SOURCES = 10_000, 4096
#: Blocks of all sources together, as long as there are no more sources than that; the draw of quotas needs fewer than 10**9.
ALL_BLOCKS = 200_000_000
WORD = r"[^\x20\x09-\x0D]+"
_BITS = 48


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(seed: str, *keys: Column) -> Column:
    """48 bits of md5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))), 1, _BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, n, source_size and others; read several times) with `place` in the sources' order from 0, `weight` and `target`."""
    named = sizes.withColumn("_absent", F.col("source").isNull())
    placed = scans.numbered_from(named, [], ["_absent", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    rated = common.written(placed.withColumn("weight", weight).withColumn("_cap", F.lit(most) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight")), "weights")
    total, all_weight = rated.agg(F.sum("source_size"), F.sum("weight")).first()
    # the level at which the sources before one are full and it is the first that isn't
    order = ["_ratio", "_absent", "source"]
    filled = scans.running(scans.running(rated, [], order, F.col("_cap"), "_full_words"), [], order, F.col("weight"), "_full_weight")
    level = (F.lit(total) - F.col("_full_words")) / (F.lit(all_weight) - F.col("_full_weight"))
    first = filled.select(*order, level.alias("level")).where("level < _ratio").agg(F.min(F.struct(*order, "level"))["level"]).first()[0]
    cap = F.col("_cap").cast("double")
    target = cap if first is None else F.least(cap, F.lit(float(first)) * F.col("weight"))
    return rated.withColumn("target", target).drop("_absent", "_cap", "_ratio")


def split_quotas(blocks: np.ndarray, shards: int, seed: int, given: np.ndarray | None = None, key: int = 0) -> np.ndarray:
    """(shards, sources): how many of each source's blocks each shard gets; columns add up to blocks, rows to `given` where that is given."""
    if shards == 1:
        return blocks[None, :]
    left, total = shards // 2, int(blocks.sum())
    sent = total * left // shards if given is None else int(given[:left].sum())
    draw = np.random.default_rng((seed, shards, total, key)).multivariate_hypergeometric(blocks, sent, method="marginals") if total else blocks
    halves = (None, None) if given is None else (given[:left], given[left:])
    return np.concatenate((split_quotas(draw, left, 2 * seed + 1, halves[0], key), split_quotas(blocks - draw, shards - left, 2 * seed + 2, halves[1], key)))


def _quotas(drawn: DataFrame, shards: int) -> DataFrame:
    """(source_id, n_blocks, stride, quotas) from (source_id, counts): the upper ends of each source's runs of permuted blocks, one for each shard."""
    group = F.floor(F.col("source_id") / GROUP_SOURCES)
    groups = drawn.groupBy(group.alias("group")).agg(F.sum("counts").alias("counts")).orderBy("group").collect()  # a row for each GROUP_SOURCES sources
    shares = split_quotas(np.array([g["counts"] for g in groups], np.int64), shards, 0)
    handed = drawn.sparkSession.createDataFrame([(g["group"], [int(x) for x in shares[:, k]]) for k, g in enumerate(groups)], "group long, shares array<long>")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_id")
        ends = np.cumsum(split_quotas(rows["counts"].to_numpy(np.int64), shards, 0, np.asarray(rows["shares"].iloc[0], np.int64), 1 + int(rows["group"].iloc[0])), axis=0)
        n = np.maximum(1, rows["counts"].to_numpy(np.int64))
        return pd.DataFrame({"source_id": rows["source_id"].to_numpy(), "n_blocks": n, "stride": [_stride(int(x)) for x in n], "quotas": list(ends.T)})

    return drawn.withColumn("group", group).join(handed, "group").groupBy("group").applyInPandas(split, "source_id long, n_blocks long, stride long, quotas array<long>")


def _stride(n: int) -> int:
    """A number prime to n, for the permutation r -> stride * r mod n."""
    k = int(n * 0.6180339887) | 1
    while np.gcd(k, max(n, 1)) != 1:
        k += 2
    return k


def _fill(batches):
    """Rows in the order of source and hash: of each source those documents more that fit the words that are left, one after another."""
    now, left = None, 0.0
    for batch in batches:
        extra = []
        for source, size, words in zip(*(batch.column(c).to_pylist() for c in ("source_id", "size", "left_words")), strict=True):
            if source != now:
                now, left = source, words
            extra.append(int(size <= left))
            left -= size * extra[-1]
        copies = pc.add(batch.column("copies"), pa.array(extra, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _DRAWN[:-1]), copies], _DRAWN)


_DRAWN = ["row", "doc_id", "h", "size", "source_id", "block", "copies"]


def _parted(bits: Column, blocks: Column, width: int) -> Column:
    """The block of a number of `width` bits, where blocks are equal ranges."""
    return (bits * blocks / F.lit(1 << width)).cast("int")


def _reached(rows: DataFrame, block: str) -> DataFrame:
    """(source_id, block, left_words, n): for each source the first of its blocks in which more than `rest` words are passed, what is left there, and its rows."""
    sums = rows.groupBy("source_id", block).agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.count("*").alias("n"))
    passed = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source_id").orderBy(block))).where("upto > rest")  # MOST_BLOCKS rows a source
    first = passed.groupBy("source_id").agg(F.min(F.struct(block, (F.col("rest") - F.col("upto") + F.col("words")).alias("left_words"), "n")).alias("at"))
    return first.select("source_id", "at.*")


def draw(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, row: str | None = None) -> DataFrame:
    """(row, doc_id, h, source_id, size, source_size, target, copies, taken, shards array<int>, one for each copy), a row for each document.

    docs: doc_id, source, text and, where the caller wants to join back, a long column named by `row`.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sized = common.written(docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), size_of(F.col("text")).alias("size"), hashed(seed, F.col("doc_id"), F.xxhash64("text")).alias("h")), "sized")
    sizes = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")).withColumn("source", F.when(F.col("key") != "", F.expr("substring(key, 2)")))
    sizes = common.written(sizes, "sizes")
    n_sources = sizes.count()
    if not n_sources:
        return docs.sparkSession.createDataFrame([], "row long, doc_id long, h long, source_id long, size long, source_size long, target double, copies int, taken long, shards array<int>")
    size, target = F.col("source_size"), F.col("target")
    whole = F.coalesce(F.when(size > 0, F.least(F.lit(most), F.floor(target / size))), F.lit(0)).cast("int")
    blocks = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.floor(F.col("n") / BLOCK_ROWS), F.lit(ALL_BLOCKS // n_sources))).cast("int")
    plan = targets(sizes, weights, most).select("key", F.col("place").cast("long").alias("source_id"), "source_size", "target", whole.alias("whole"), blocks.alias("blocks"))
    plan = common.written(plan.withColumn("rest", F.greatest(F.lit(0.0), target - F.col("whole") * size)), "sources")

    def of_source(rows: DataFrame, more: DataFrame, on: str = "source_id") -> DataFrame:
        return rows.join(F.broadcast(more), on) if n_sources <= BROADCAST_SOURCES else common.joined_unevenly(rows, more, on)

    bits = _BITS // 2  # the first half of the hash chooses the block, the second the part of a block
    placed = of_source(sized, plan.select("key", "source_id", "whole", "rest", "blocks"), "key").select("row", "doc_id", "size", "h", "source_id", "whole", "rest", _parted(F.shiftright("h", bits), F.col("blocks"), bits).alias("block"))
    if n_sources > BROADCAST_SOURCES:
        placed = common.written(placed, "placed")
    reached, wanted = _reached(placed, "block").withColumnRenamed("n", "n_edge"), F.col("rest") > 0
    edges = plan.join(reached, "source_id", "left").select(
        "source_id",
        F.when(wanted, F.coalesce("block", "blocks")).otherwise(-1).alias("edge"),
        F.when(wanted, F.coalesce("left_words", F.lit(0.0))).otherwise(0.0).alias("left_words"),
        F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.floor(F.col("n_edge") / BLOCK_ROWS))).cast("int").alias("parts"),
        # blocks drawn: whole rounds, and the blocks of the rest up to the one in which it is reached
        (F.col("whole").cast("long") * F.col("blocks") + F.coalesce(F.when(wanted, F.col("block") + 1), F.lit(0))).alias("counts"),
    )
    edges = common.written(edges, "edges")
    inside = of_source(placed.drop("rest"), edges.where("edge >= 0").select("source_id", "edge", "parts", F.col("left_words").alias("rest"))).where("block = edge")
    inside = inside.withColumn("part", _parted(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), F.col("parts"), bits))
    inside = common.written(inside.select("row", "doc_id", "size", "h", "source_id", "block", "whole", "rest", "part"), "edge-blocks")
    last = _reached(inside, "part").select("source_id", F.col("part").alias("last"), F.col("left_words").alias("last_words"))
    drawn = plan.join(edges.select("source_id", "edge", "counts"), "source_id").join(last, "source_id", "left").join(_quotas(edges.select("source_id", "counts"), shards), "source_id")
    tail = ["source_size", "target", "blocks", "n_blocks", "stride", "quotas"]
    drawn = common.written(drawn.select("source_id", "whole", "edge", F.coalesce("last", F.lit(MOST_BLOCKS)).alias("last"), F.coalesce("last_words", F.lit(0.0)).alias("left_words"), *tail), "drawn")
    names = ["row", "doc_id", "h", "size", "source_id", "block"]
    outside = of_source(placed.select(*names), drawn.select("source_id", "whole", "edge", *tail)).where("block <> edge").select(*names, (F.col("whole") + (F.col("block") < F.col("edge")).cast("int")).alias("copies"), *tail)
    within = of_source(inside.select(*names, "whole", "part"), drawn.select("source_id", "last", "left_words", *tail))
    plain = within.where("part <> last").select(*names, (F.col("whole") + (F.col("part") < F.col("last")).cast("int")).alias("copies"), *tail)
    partly = within.where("part = last").select(*names, F.col("whole").alias("copies"), "left_words")
    # a part of a block of each source, which streams through its task
    filled = partly.repartition("source_id").sortWithinPartitions("source_id", "h", "doc_id", "size").mapInArrow(_fill, "row long, doc_id long, h long, size long, source_id long, block int, copies int")
    chosen = outside.unionByName(plain).unionByName(of_source(filled, drawn.select("source_id", *tail)))
    place = lambda k: F.pmod((k * F.col("blocks") + F.col("block")) * F.col("stride"), F.col("n_blocks"))
    taken = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    shard = F.transform(taken, lambda k: F.least(F.size(F.filter(F.col("quotas"), lambda q: q <= place(k))), F.lit(shards - 1)))
    return chosen.select("row", "doc_id", "h", "source_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), shard.alias("shards"))


def mixed(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, its columns as given, with `shard` and `position`, in the order of these two.

    Written as a table, the files follow the shards, and rows within a shard are shuffled: by a hash of id, text, source, number among the rows equal in
    these, and copy, so however the table is partitioned the mix is the same (but for which of such rows stands where).
    """
    docs = docs.drop("shard", "position")
    row, own, copy, place = common.unused([*docs.columns, "shard", "position"], "row", "own", "copy", "place")
    numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression="zstd")
    drawn = common.written(draw(numbered, seed, row=row, **options).where("copies > 0").select("row", "doc_id", "h", "source_id", "shards", (-F.col("copies")).alias("fewer")), "copies")
    equal = scans.numbered_from(drawn, ["doc_id", "h", "source_id"], ["fewer", "row"], "n")
    copies = equal.select("doc_id", "h", "source_id", "n", F.col("row").alias(own), F.posexplode("shards").alias(copy, "shard"))
    copies = copies.select(own, "shard", hashed(seed + "|shuffle", F.col("doc_id"), F.col("h"), F.col("source_id"), F.col("n"), F.col(copy)).alias(place))
    joined = numbered.join(copies, numbered[row] == copies[own])
    return joined.select(*docs.columns, "shard", F.col(place).alias("position")).orderBy("shard", "position")
