"""Approximate nearest neighbours by cosine: adaptive dimension scan within probed lists.

Vectors are scaled to length one, so the largest cosine is the smallest distance, and turned by a random rotation, so that any block of
their columns is a fair sample of the distance. Equal vectors are one row of the index with their smallest ids. The index parts the
vectors into lists around centres fitted on a bounded sample. A query goes to the lists of its nearest centres, as many as
the sample shows to be needed; within a list the rotated columns are
scanned block by block, and after each block a candidate is given up when its partial distance, scaled to all dimensions, is so far
beyond the query's present k-th distance that a hypothesis test at EPSILON rejects that it could be nearer. Those left at the last
block are measured exactly, in double precision, on the original vectors. The present k-th distance starts from the list's first
candidates and falls as blocks of candidates are scanned.

A list of more than CHUNK_ROWS vectors is dealt to several tasks by hash; each sends its best, and the best of all are kept. A task holds
one chunk and reads the queries that probe it batch by batch, however many they are. Queries with one vector are asked once, and each then leaves
out its own id. Queries whose probed lists gave fewer than k rows go to all other lists in a second pass.

Edge cases: vectors that are null, zero, or hold a null or a component that is not finite take no part, neither as query nor as
candidate, and neither do vectors of another length than the most common one, nor rows with a null id; if ids repeat, each row is a candidate, a query's own id
is none, and of query rows with one id the smallest vector is asked; fewer than k candidates are all returned; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, MOST_LISTS, BLOCKS = 20_000, 4096, 4
#: Share of the sample's nearest neighbours that must lie in probed lists, and the sample's rows that are asked for it.
FOUND, ASKED = 0.97, 512
CHUNK_ROWS = 4096
#: Candidates of a list that are measured in full, so that there is a k-th distance to test the next ones against; each further block is twice as long.
FIRST = 16
#: How many standard errors a partial distance must lie beyond the k-th distance.
EPSILON = 2.1


def rotation(size: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def centres(points: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means on the unit sphere over a bounded sample."""
    chosen = points[np.random.default_rng(seed).permutation(len(points))[:lists]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(points[k : k + 4096] @ chosen.T, axis=1) for k in range(0, len(points), 4096)])
        count = np.bincount(near, minlength=len(chosen))
        sums = np.stack([np.bincount(near, weights=points[:, j], minlength=len(chosen)) for j in range(points.shape[1])], axis=1)
        full = count > 0
        sums[full] /= np.maximum(np.linalg.norm(sums[full], axis=1, keepdims=True), 1e-30)
        chosen[full] = sums[full]
    return chosen


def fitted_probes(unit: np.ndarray, middle: np.ndarray, k: int, found: float = FOUND) -> int:
    """How many of its nearest lists a query must scan so that the share `found` of its k nearest in the sample lies in them, by brute force over the sample.

    Neighbours in the sample are farther than those among all vectors, so this errs on the side of more lists.
    """
    home = np.concatenate([np.argmax(unit[a : a + 4096] @ middle.T, axis=1) for a in range(0, len(unit), 4096)])
    places = []
    for i in range(0, len(unit), max(1, len(unit) // ASKED)):
        near = unit @ unit[i]
        near[i] = -np.inf
        best = np.argpartition(-near, min(k, len(near) - 1))[:k]
        order = np.empty(len(middle), np.int64)
        order[np.argsort(-(middle @ unit[i]), kind="stable")] = np.arange(len(middle))
        places.append(order[home[best]])
    ranks = np.sort(np.concatenate(places))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(found * len(ranks))))]) + 1


def _stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector array<double>) of the rows that take part."""
    v = F.col(vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    return rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))


def _assigner(middle: np.ndarray, turn: np.ndarray, probes: int):
    def run(batches):
        for rows in batches:
            if not len(rows):
                continue
            unit = _unit(_stacked(rows["vector"]))
            near = unit @ middle.T
            lists = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(rows), 1))
            if probes == 1:
                lists = np.argmax(near, axis=1)[:, None]
            yield rows.assign(rotated=list(unit @ turn), lists=list(lists.astype(np.int32)))

    return run


def _scan(query: np.ndarray, rotated: np.ndarray, originals: np.ndarray, target: np.ndarray, k: int, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one list that are among a query's k nearest, with their cosines; rotated holds unit vectors, blocks of columns side by side."""
    size = rotated.shape[1]
    alive, kth = np.arange(0), np.inf
    best_rows, best = np.zeros(0, np.int64), np.zeros(0)
    begin, step = 0, FIRST
    while begin < len(rotated):
        alive = np.arange(begin, min(begin + step, len(rotated)))
        begin, step = begin + step, min(2 * step, 512)
        partial, done = np.zeros(len(alive)), 0
        for end in cuts:
            partial += ((rotated[alive, done:end] - query[done:end]) ** 2).sum(axis=1)
            done = end
            if end < size and np.isfinite(kth):
                keep = partial * (size / end) <= kth * (1 + EPSILON / np.sqrt(end)) ** 2
                alive, partial = alive[keep], partial[keep]
        if len(alive):
            close = partial <= kth * (1 + 1e-9) + 1e-12
            alive = alive[close]
            exact = (originals[alive] @ target) / (np.sqrt((originals[alive] ** 2).sum(axis=1)) * np.sqrt(target @ target))
            best_rows, best = np.concatenate((best_rows, alive)), np.concatenate((best, exact))
            if len(best) > k:
                # everything that ties with the k-th stays, for the smaller ids decide
                limit = np.partition(best, len(best) - k)[len(best) - k]
                stay = best >= limit
                best_rows, best = best_rows[stay], best[stay]
            if len(best) >= k:
                kth = 2 - 2 * best.min() + 1e-12
    return best_rows, best


def _nearest(entries, k: int) -> list[tuple[int, float]]:
    """(vec_id, score) from (-score, vec_id), nearest first, up to the k + 1st different id, no id more than k times: enough for any query's own id to go."""
    out, times = [], {}
    for negative, i in sorted(entries):
        times[i] = times.get(i, 0) + 1
        if times[i] <= k:
            out.append((i, -negative))
        if len(times) > k:
            break
    return out


def _searcher(k: int, reach: int, size: int):
    """reach: nearest index rows of a chunk that are looked at, k and as many as one id may have."""
    cuts = sorted({max(1, size * b // BLOCKS) for b in range(1, BLOCKS + 1)})

    def run(batches):
        """Rows by (list, chunk), those of the index before the queries: a chunk is held, queries pass."""
        now, parts, chunk = None, [], None
        for rows in batches:
            out = []
            for key, part in rows.groupby(["list", "chunk"], sort=False):
                if key != now:
                    now, parts, chunk = key, [], None
                asking = part["asks"].to_numpy(bool)
                if not asking.all():
                    parts.append(part[~asking])
                if not parts or not asking.any():
                    continue
                if chunk is None:
                    index = pd.concat(parts)
                    index = index.assign(low=[x[0] for x in index["ids"]]).sort_values("low", kind="stable")
                    chunk = _stacked(index["rotated"]), _stacked(index["vector"]), index["ids"].to_numpy()
                rotated, originals, ids = chunk
                queries = part[asking]
                for key, turned, target in zip(queries["query"].to_numpy(), queries["rotated"], queries["vector"], strict=True):
                    near, scores = _scan(np.asarray(turned, np.float64), rotated, originals, np.asarray(target, np.float64), reach, cuts)
                    found = _nearest([(-s, i) for r, s in zip(near.tolist(), scores.tolist(), strict=True) for i in ids[r]], k)
                    out += [(key, i, s) for i, s in found]
            yield pd.DataFrame(out, columns=["query", "vec_id", "score"]).astype({"vec_id": "int64", "score": "float64"})

    return run


def _found(dealt: DataFrame, sent: DataFrame, k: int, reach: int, size: int) -> DataFrame:
    """(query, vec_id, score): the best of each chunk for each query sent to it."""
    names = ["list", "chunk", "asks", "query", "vector", "rotated", "ids"]
    index = dealt.select("list", "chunk", F.lit(False).alias("asks"), F.lit("").alias("query"), "vector", "rotated", "ids").select(*names)
    asking = sent.select("list", "chunk", F.lit(True).alias("asks"), "query", "vector", "rotated", F.lit(None).cast("array<long>").alias("ids")).select(*names)
    both = index.unionByName(asking).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "asks")
    return both.mapInPandas(_searcher(k, reach, size), "query string, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_column: str = "vec_id", vector_column: str = "embedding", probes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors found, ties to the smaller id.

    Both frames have id_column and vector_column; the candidates of a query are all rows but those with its own id.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes["d"]
    rows = rows.where(F.size("vector") == size)
    # equal vectors are one row: the k + 1 smallest ids, none more than k times, are all that can be among a query's k nearest
    pairs = common.written(rows.groupBy("vector", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))), "pairs")
    reach = k + pairs.groupBy("id").count().agg(F.max("count")).first()[0]
    first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("vector", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    least = first.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = least.groupBy("vector").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("id", F.col("times"))))).alias("ids"))
    distinct = common.written(distinct, "vectors")
    n = distinct.count()
    lists = int(min(MOST_LISTS, max(1, round(n**0.5))))
    picked = common.bounded(distinct, sample, F.col("vector")).select("vector").toPandas()
    unit = _unit(_stacked(picked["vector"]))
    middle, turn = centres(unit[np.lexsort(unit.T)], min(lists, len(unit))), rotation(size)
    probes = min(probes or fitted_probes(unit, middle, k), len(middle))
    schema = "vector array<double>, ids array<long>, rotated array<double>, lists array<int>"
    index = distinct.mapInPandas(_assigner(middle, turn, 1), schema).select("vector", "ids", "rotated", F.col("lists")[0].alias("list"))
    index = common.written(index, "index")
    chunks = F.broadcast(index.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks")))  # one row for each list, MOST_LISTS at most
    dealt = index.join(chunks, "list").withColumn("chunk", F.pmod(F.xxhash64("vector"), F.col("chunks")).cast("int")).drop("chunks")
    spelt = F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")  # a double's text is its own
    asking = usable(queries, id_column, vector_column).where(F.size("vector") == size).groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector"))
    asking = common.written(asking.withColumn("query", F.sha2(spelt, 256)), "asking")
    asked = asking.groupBy("query").agg(F.first("vector").alias("vector")).mapInPandas(_assigner(middle, turn, probes), "query string, vector array<double>, rotated array<double>, lists array<int>")
    asked = common.written(asked, "queries")

    def to_chunks(sent: DataFrame) -> DataFrame:
        return sent.join(chunks, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    found = common.written(_found(dealt, to_chunks(asked.select("query", "vector", "rotated", F.explode("lists").alias("list"))), k, reach, size), "found")
    if probes < len(middle):
        full = found.groupBy("query").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") > k)
        short = asked.join(full, "query", "left_anti")
        if not short.isEmpty():
            others = F.array_except(F.sequence(F.lit(0), F.lit(len(middle) - 1)), "lists")
            found = found.unionByName(_found(dealt, to_chunks(short.select("query", "vector", "rotated", F.explode(others).alias("list"))), k, reach, size))
    nearest = [F.desc("score"), "vec_id"]
    each = found.withColumn("n", F.row_number().over(Window.partitionBy("query", "vec_id").orderBy(*nearest))).where(F.col("n") <= k)
    best = each.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*nearest))).where(F.col("n") <= (k + 1) * k)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))  # (k + 1) * k at most
    own = common.joined_unevenly(asking.select("query", "query_id"), lists, "query")
    kept = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(kept).alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")
