"""Periodic runs of words: stretches that repeat with some period at least LEAST times, found by scale-tiled distribution.

A run of period q is a maximal stretch of places whose word equals the word q places later, q longer than that stretch. Periods are taken by
octaves, [A, 2A) for A = 1, 2, 4, ...:

1. A document is exploded into tiles for each octave. Tiles have at least TILE words and 16 A; they overlap by 4 A, so each anchor, a place
   divisible by A, has A words before and 3 A after it in some tile. Octaves with equal tiles share them. A document of one tile is
   solved where it is read; the tiles of longer ones are rows of a table, which any tasks may take.
2. A tile is solved by itself. At an anchor the Z-function of the words after it, and of the words before it read backwards, gives for all periods of the
   octave how far the words go on repeating to both sides. A run has at least 3 A matching places, so at each of its anchors these reach
   A places to one side or the other; anchors where no two blocks of A words are met again in time (hashes of blocks tell) are passed over.
   Fragments of one period that touch are joined; periods that only repeat a shorter one are left out.
3. Fragments of tiles are shuffled by document and period, and joined to intervals where they touch. Of equal intervals the
   smallest period counts.

Edge cases: null, empty and blank texts have no words and no runs; words are compared whole; equal long texts are searched once; rows are
independent, so null and repeated ids and empty tables need no rule; extra columns are not read. Overlapping runs are all reported.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A run has at least LEAST periods and at least SHORTEST words.
LEAST, SHORTEST = 4, 6
#: Words of the smallest tiles.
TILE = 4_096

Runs = np.ndarray  # rows of (start, length, period)


def z_function(words: list[int]) -> list[int]:
    """For each place how many words from there on equal those at the begin."""
    n = len(words)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _pair_hashes(codes: np.ndarray):
    """For A = 1, 2, 4, ... hashes of the two blocks of A words from each place on; equal blocks have equal hashes."""
    hashes, size = common.mix64(codes.astype(np.uint64) + np.uint64(1)), 1
    while len(hashes) > size:
        hashes = common.mix64(hashes[:-size] * np.uint64(common.Rolling.FACTOR) + hashes[size:])
        yield size, hashes
        size *= 2


def _worth(hashes: np.ndarray, size: int) -> np.ndarray:
    """The anchors that runs may have: of two blocks which are met again `size` to 2 * size - 1 words later, the begins and the end.

    The matching places of a run are 3 * size or more, so they hold two whole blocks between anchors.
    """
    n = -(-len(hashes) // size) + 1
    rows = np.zeros(n * size, np.uint64)
    rows[: len(hashes)] = hashes  # zeros after the last blocks meet no block, or the Z-function says so
    rows = rows.reshape(n, size)
    again = np.flatnonzero((rows[1:] == rows[:-1, :1]).any(1))
    return np.unique((again[:, None] + np.arange(3)).ravel()) * size


def _fragments_at(codes: np.ndarray, anchor: int, size: int) -> list[tuple[int, int, int]]:
    """(period, first matching place, end of the matching places) around an anchor, for the octave's periods that reach `size` to some side."""
    low, high = max(0, anchor - size), min(len(codes), anchor + 3 * size)
    after = z_function(codes[anchor:high].tolist())
    back = codes[low:anchor][::-1].tolist()
    around = codes[low : min(len(codes), anchor + 2 * size - 1)][::-1].tolist()
    before = z_function([*back, -1, *around])
    shift = len(back) + 1 + len(around) + low - anchor
    found = []
    for q in range(size, min(2 * size, len(after))):
        right = min(after[q], size)
        left = min(before[shift - q], len(back)) if 0 <= shift - q < len(before) else 0
        if (right == size or left == size) and not any(q % p == 0 and after[p] >= q - p for p in _parts(q)):
            found.append((q, anchor - left, anchor + right))
    return found


_PRIMES_OF: dict[int, list[int]] = {}


def _parts(q: int) -> list[int]:
    """q divided by each of its primes: a block of q words repeats a shorter one where it has one of these periods."""
    if q not in _PRIMES_OF:
        rest, found, p = q, [], 2
        while rest > 1:
            if p * p > rest:
                p = rest
            if rest % p == 0:
                found.append(q // p)
                while rest % p == 0:
                    rest //= p
            p += 1
        _PRIMES_OF[q] = found
    return _PRIMES_OF[q]


def fragments(codes: np.ndarray, lowest: int = 1, highest: int | None = None) -> list[tuple[int, int, int]]:
    """(period, start, end) of the matching places of a sequence for the octaves from `lowest` to `highest`; touching ones are joined."""
    found = []
    for size, hashes in _pair_hashes(codes):
        if size < lowest:
            continue
        if LEAST * size > len(codes) or highest and size > highest:
            break
        for anchor in _worth(hashes, size).tolist():
            found += _fragments_at(codes, anchor, size)
    return joined(found)


def joined(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    done: list[tuple[int, int, int]] = []
    for q, start, end in sorted(found):
        if done and done[-1][0] == q and start <= done[-1][2]:
            done[-1] = (q, done[-1][1], max(end, done[-1][2]))
        else:
            done.append((q, start, end))
    return done


def enough(period: int, start: int, end: int) -> bool:
    return end - start + period >= max(SHORTEST, LEAST * period)


def runs_of(intervals: list[tuple[int, int, int]]) -> Runs:
    """Rows of (start, length, period) by start and period; of equal intervals the smallest period."""
    kept: dict[tuple[int, int], int] = {}
    for q, start, end in sorted(intervals):
        if enough(q, start, end):
            kept.setdefault((start, end - start + q), q)
    return np.array(sorted((start, n, q) for (start, n), q in kept.items()), np.int64).reshape(-1, 3)


def coded(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word of the texts in a row, equal for equal words, and one of its own after each text."""
    flat = list(itertools.chain.from_iterable(texts))
    numbers = dict(zip(dict.fromkeys(flat), itertools.count(), strict=False))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.empty(len(flat) + len(texts), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    between = np.ones(len(codes), bool)
    between[ends] = False
    codes[between] = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    codes[ends] = -2 - np.arange(len(texts))
    return codes


def runs_of_texts(texts: list[list[bytes]]) -> list[Runs]:
    """The runs of short texts; octave by octave over those that are long enough for it, in one sequence."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order], np.int64)
    codes = coded([texts[k] for k in order])
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for size, hashes in _pair_hashes(codes):
        n = int(np.searchsorted(-lengths, -LEAST * size, "right"))
        if not n:
            break
        anchors = _worth(hashes[: max(0, begin[n] - 2 * size + 1)], size).tolist()
        octave = joined([f for anchor in anchors for f in _fragments_at(codes, anchor, size)])
        place = np.searchsorted(begin, [f[1] for f in octave], "right") - 1
        for (q, start, end), k in zip(octave, place.tolist(), strict=True):
            found[order[k]].append((q, start - int(begin[k]), end - int(begin[k])))
    return [runs_of(f) for f in found]


def collapsed(words: list[bytes], runs: Runs) -> bytes:
    """The words joined by one space, without those that some run contains after its first period."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [w for w, gone in zip(words, np.cumsum(edge).tolist(), strict=False) if not gone]
    return b" ".join(words)


def tiles(n: int):
    """(lowest octave, highest octave, first word, end) of the tiles of n words."""
    size = 1
    while LEAST * size <= n:
        lowest = size
        while 16 * 2 * size <= TILE and LEAST * 2 * size <= n:
            size *= 2
        most = max(TILE, 16 * size)
        step = most - 4 * size  # a multiple of every octave's size
        for begin in range(0, max(1, n - 4 * size), step):
            end = min(n, begin + most)
            yield lowest, size, begin, end
        size *= 2


_STRUCT = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "runs array<struct<start:long,length:long,period:long>>"


def _columns(done: list[tuple[Runs, bytes]], whole: bool) -> dict[str, pa.Array]:
    """What is returned of each text: its runs and collapsed text, or digests and the longest run."""
    if whole:
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x, _ in done]
        return {"runs": pa.array(runs, pa.list_(_STRUCT)), "collapsed": pa.array([c.decode() for _, c in done], pa.string())}
    longest = [min(x.tolist(), key=lambda r: (-r[1], r[0], r[2])) if len(x) else (None,) * 3 for x, _ in done]
    columns = {"n_runs": pa.array([len(x) for x, _ in done], pa.int64())}
    columns |= {name: pa.array([r[k] for r in longest], pa.int64()) for k, name in ((0, "start"), (1, "length"), (2, "period"))}
    columns["exponent_milli"] = pa.array([1000 * r[1] // r[2] if r[2] else None for r in longest], pa.int64())
    columns["runs_sha256"] = pa.array([hashlib.sha256(b"".join([b"%d,%d,%d\n" % tuple(r) for r in x.tolist()])).hexdigest() for x, _ in done], pa.string())
    columns["collapsed_sha256"] = pa.array([hashlib.sha256(c).hexdigest() for _, c in done], pa.string())
    return columns


_RESULT = {
    True: f"{_RUNS}, collapsed string",
    False: "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string",
}
_PENDING = "text_key binary, text_packed binary, lowest int, highest int, begin long, n_words long, codes binary"


def _first_pass(whole: bool):
    """Results of texts of one tile; of longer ones a row that waits, and once in a task the text and its tiles."""
    def run(batches):
        squeeze, met = zstandard.ZstdCompressor(), set()
        for batch in batches:
            for part in common.steps(batch):
                ids, texts = part.column("doc_id"), common.texts_of(part)
                split = [common.word_list(t) for t in texts]
                here = [k for k, w in enumerate(split) if len(w) <= TILE]
                found = runs_of_texts([split[k] for k in here])
                ready = _columns([(r, collapsed(split[k], r)) for k, r in zip(here, found, strict=True)], whole)
                yield _batch(ids.take(pa.array(here, pa.int64())), ready, {})
                long = [k for k, w in enumerate(split) if len(w) > TILE]
                keys = [hashlib.sha256(texts[k]).digest() for k in long]
                yield _batch(ids.take(pa.array(long, pa.int64())), {}, {"text_key": pa.array(keys, pa.binary())}, ready)
                for k, key in zip(long, keys, strict=True):
                    if key not in met:
                        met.add(key)
                        rows = [{"text_key": key, "text_packed": squeeze.compress(texts[k]), "n_words": len(split[k])}]
                        codes = coded([split[k]])[:-1].astype(np.int32)
                        rows += [{"text_key": key, "lowest": a, "highest": b, "begin": i, "n_words": len(codes), "codes": squeeze.compress(codes[i:j].tobytes())} for a, b, i, j in tiles(len(codes))]
                        columns = {f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in _PENDING_SCHEMA}
                        yield _batch(pa.nulls(len(rows), pa.int64()), {}, columns, ready)

    return run


_PENDING_SCHEMA = pa.schema([("text_key", pa.binary()), ("text_packed", pa.binary()), ("lowest", pa.int32()), ("highest", pa.int32()), ("begin", pa.int64()), ("n_words", pa.int64()), ("codes", pa.binary())])


def _batch(ids: pa.Array, ready: dict[str, pa.Array], pending: dict[str, pa.Array], like: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """Rows with nulls for what they lack; like: columns of the result, for their types."""
    results = ready or {name: pa.nulls(len(ids), x.type) for name, x in like.items()}
    return pa.RecordBatch.from_pydict({"doc_id": ids, **results, **{f.name: pending.get(f.name, pa.nulls(len(ids), f.type)) for f in _PENDING_SCHEMA}})


def _solved(batches):
    """The fragments of tiles that are long enough or touch an end of what the tile can see, at places of the text."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            codes = np.frombuffer(unpack.decompress(row["codes"]), np.int32).astype(np.int64)
            begin, found = row["begin"], []
            for q, start, end in fragments(codes, row["lowest"], row["highest"]):
                size = 1 << (q.bit_length() - 1)
                # beyond its first and last whole anchors a tile sees less than its neighbours do
                if enough(q, start, end) or begin and start <= 2 * size or begin + len(codes) < row["n_words"] and end >= len(codes) - 4 * size:
                    found.append({"text_key": row["text_key"], "period": q, "start": begin + start, "end": begin + end})
            yield pa.RecordBatch.from_pylist(found, _FRAGMENT)


_FRAGMENT = pa.schema([("text_key", pa.binary()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def stitched(found: DataFrame) -> DataFrame:
    """(text_key, start, length, period) of the runs: fragments of one text and period joined where they touch."""
    ordered = Window.partitionBy("text_key", "period").orderBy("start", "end")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(F.col("start") <= reached, 0).otherwise(1))
    numbered = opened.withColumn("interval", F.sum("opens").over(ordered))
    whole = numbered.groupBy("text_key", "period", "interval").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    whole = whole.withColumn("length", length).where(F.col("length") >= F.greatest(F.lit(SHORTEST), LEAST * F.col("period")))
    return whole.groupBy("text_key", "start", "length").agg(F.min("period").alias("period"))


def _finished(whole: bool):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in common.steps(batch, common.STEP_BYTES // 8, "text_packed"):
                done = []
                for packed, runs in zip(part.column("text_packed").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    rows = np.array(sorted((r["start"], r["length"], r["period"]) for r in runs or ()), np.int64).reshape(-1, 3)
                    done.append((rows, collapsed(common.word_list(unpack.decompress(packed)), rows)))
                yield pa.RecordBatch.from_pydict({"text_key": part.column("text_key"), **_columns(done, whole)})

    return run


def _found(docs: DataFrame, whole: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = _RESULT[whole]
    # small row groups, so that one long text's tiles are read by many tasks
    first = common.written(rows.mapInArrow(_first_pass(whole), f"doc_id long, {result}, {_PENDING}"), "tiles", compression="zstd", **{"parquet.block.size": str(4 << 20)})
    done = first.where("text_key is null").select("doc_id", *(c for c in first.columns[1:] if c not in _PENDING_SCHEMA.names))
    waiting = first.where("text_key is not null and text_packed is null and codes is null").select("doc_id", "text_key")
    # tasks that met copies of one text give equal fragments
    solved = first.where("codes is not null").select("text_key", "lowest", "highest", "begin", "n_words", "codes").mapInArrow(_solved, "text_key binary, period long, start long, end long")
    runs = stitched(solved.dropDuplicates()).groupBy("text_key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))  # fewer than the text's words
    texts = first.where("text_packed is not null").groupBy("text_key").agg(F.first("text_packed").alias("text_packed"))
    results = common.written(texts.join(runs, "text_key", "left").mapInArrow(_finished(whole), f"text_key binary, {result}"), "long-texts", compression="zstd")
    later = common.joined_unevenly(waiting, results, "text_key")
    return done.unionByName(later.select(done.columns))


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>> by start and period, collapsed string) for each document."""
    return _found(docs, True)


def run_digests(docs: DataFrame) -> DataFrame:
    """Digests of the runs and the collapsed text, and the longest run (ties: smallest start, then period; nulls where there is none)."""
    return _found(docs, False)
