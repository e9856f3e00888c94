"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits (the last padded with zeros to 23). Two fingerprints that
differ in two bits or fewer have at least one segment without an error, and at most two errors in each other segment. A segment
is decoded, with each single bit of it flipped in turn, by the perfect [23, 12, 7] Golay code: segments at distance 2 or less
share one of those code words (both decode the vector between them), and there are one or six for each. So a fingerprint's keys
are (which segment, that segment exactly, a code word of the next segment), about sixteen, and linked fingerprints share one.

Equal fingerprints are merged first. A key that few fingerprints hold is joined with itself and its pairs are verified. A key
that many hold would give all pairs of a group, so their fingerprints are linked another exact way: each one sends itself and its 64
one-bit neighbours, and all that meet in one such point are within two bits of each other; linking each to the smallest of its
point keeps every component, with 65 rows for a fingerprint however large the group is.

Components come from alternating large-star and small-star steps on the edge list, each written to the shared folder.

Edge cases: null and empty texts have no words and the fingerprint zero, which is linked like any other; texts of one or two words
have one shingle, the whole sequence; rows with a null doc_id keep their fingerprint and have the component_id null unless they
equal or link to a row with an id; repeated rows come out as often as they came in; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Fingerprints that one key may hold before its pairs are found through one-bit neighbours.
PAIRS_UP_TO = 16
_SEGMENTS = ((41, 23), (18, 23), (0, 18))
#: The Golay code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    left = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        hit = (left >> np.uint32(bit)) & np.uint32(1)
        left ^= hit * np.uint32(_GENERATOR << (bit - 11))
    return left


def _leaders() -> np.ndarray:
    """For each syndrome the one error of weight three or less that has it."""
    bits = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = [np.zeros(1, np.uint32), bits]
    for _ in range(2):
        errors.append(np.unique((errors[-1][:, None] ^ bits[None, :]).ravel()))
    table = np.zeros(2048, np.uint32)
    for group in errors[::-1]:
        table[_syndromes(group)] = group
    return table


_LEADERS = _leaders()


def nearby_codewords(segments: np.ndarray) -> np.ndarray:
    """(n, 24): the code-word numbers, 12 bits each, of 23-bit segments and of their one-bit neighbours."""
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.uint32)
    near = segments.astype(np.uint32)[:, None] ^ flips[None, :]
    return (near ^ _LEADERS[_syndromes(near.ravel())].reshape(near.shape)) >> np.uint32(11)


def golay_keys(fingerprints: np.ndarray) -> list[np.ndarray]:
    """For each fingerprint its distinct keys as signed integers."""
    parts = [((fingerprints >> np.uint64(shift)) & np.uint64((1 << size) - 1)).astype(np.uint32) for shift, size in _SEGMENTS]
    words = [nearby_codewords(x) for x in parts]
    keys = [(np.int64(k) << np.int64(40)) | (parts[k].astype(np.int64)[:, None] << np.int64(12)) | words[(k + 1) % 3].astype(np.int64) for k in range(3)]
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    fresh = np.concatenate((np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]), axis=1)
    return [row[new] for row, new in zip(keys, fresh, strict=True)]


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of lower-cased three-word shingles, repeats included."""
    words = common.word_list(text.lower())
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    line = b" ".join(words)
    starts = np.concatenate(([0], ends[:-1]))
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), (ends[2:] - 1).tolist(), strict=False) if len(words) > 2 else [(0, len(line))]
    values = np.fromiter((hashed(line[a:b], SEED) for a, b in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(values), 65_536):
        block = values[k : k + 65_536].astype(">u8")
        ones += np.unpackbits(block.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(values)).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        found = [fingerprint(x) for part in common.steps(batch) for x in common.texts_of(part)]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.array(found, np.uint64).view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, fp), all long, for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, ", ".join(f"{n} long" for n in ("doc_id", *more, "fp")))


def _keyed(batches):
    for batch in batches:
        keys = golay_keys(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        row = np.repeat(np.arange(len(keys)), sizes)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("fp").take(pa.array(row))], ["key", "fp"])


def _points(batches):
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fp), 4096):
            part = fp[k : k + 4096]
            points = (part[:, None] ^ flips[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(part, 65).view(np.int64))], ["point", "fp"])


def near_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct fingerprints linked such that the components are those of all pairs within two bits.

    distinct: (fp long), each once.
    """
    keyed = common.written(distinct.select("fp").mapInArrow(_keyed, "key long, fp long"), "keys")
    # a key's count and, up to the limit, its fingerprints; crowded keys send their members another way
    sized = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = keyed.join(sized.where(F.col("n") > PAIRS_UP_TO).select("key"), "key", "left_semi").select("fp").distinct()
    few = keyed.join(sized.where(F.col("n") <= PAIRS_UP_TO).select("key"), "key", "left_semi")
    other = few.select("key", F.col("fp").alias("other"))
    cold = few.join(other, "key").where("fp < other and bit_count(fp ^ other) <= 2").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    points = crowded.mapInArrow(_points, "point long, fp long")
    hubs = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    hot = points.join(hubs, "point").where("a < fp").select("a", F.col("fp").alias("b"))
    return cold.unionByName(hot).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges (a, b); alternating large-star and small-star."""
    current = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = common.written(lower.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "edges")
        changed = after.exceptAll(current).isEmpty() and current.exceptAll(after).isEmpty()
        current = after
        if changed:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")


def grouped(docs: DataFrame, *more: str) -> DataFrame:
    """(fp, doc_id, more, root, component_id) for each document: root is its component's smallest fingerprint, more are long columns kept.

    Components are those of fingerprints, whether their rows have ids or not; two of them may have one component_id where a doc_id repeats.
    """
    marked = common.written(fingerprints(docs, *more), "fingerprints")
    nodes = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    reached = components(near_pairs(nodes))
    rooted = nodes.join(reached, nodes["fp"] == reached["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return common.joined_unevenly(marked, rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document; see the module's text."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component (that with the smallest doc_id, its first row if ids repeat); columns as given.

    Rows with a null doc_id stay.
    """
    row, kept = common.unused(docs.columns, "row", "kept")
    numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression="zstd")
    first = grouped(numbered, row).where("doc_id = component_id").groupBy("root").agg(F.min(row).alias(kept))
    one = numbered.join(first, numbered[row] == first[kept], "left_semi")
    return one.unionByName(numbered.where("doc_id is null")).select(*docs.columns)
