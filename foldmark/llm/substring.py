"""Substring deduplication by prefix-partitioned suffix trees over words.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it also starts in a document with a
smaller doc_id. The suffixes are those that start at the windows; what decides is each suffix tree's internal nodes of WINDOW words or more: such
a node with suffixes of two documents is (part of) a maximal repeat, and its smallest doc_id tells which windows go.

The suffixes are partitioned by prefixes of variable length. A suffix's first prefix goes up to the end of its anchor, the gram of GRAM words
with the smallest hash in the window, so it is 12 to 50 words long; all prefixes that end with the same anchor are one group. Equal windows
are in one group, and the neighbouring suffixes of a document mostly too, so a run of them is shipped as one segment of words,
about 1.5 windows long. A group of more than GROUP_SEGMENTS different segments is split by longer prefixes, up to the end of longer anchors, of
LONGER_GRAMS words; at the last, WINDOW words, a prefix is a whole window, a group is one node of the tree and needs no memory.

1. Every document's (key, doc_id) pairs are grouped by key; only keys that two documents hold can matter.
2. Documents that hold one are written to the shared folder with the list of those keys.
3. Their segments are merged where equal (a passage in a third of all documents becomes one row with its smallest and largest doc_id,
   in the map tasks already) and dealt out by key. A task takes the groups in memory-sized lots, numbers the lot's words exactly, and builds the
   suffix array by doubling. Neighbours in it whose common prefix reaches WINDOW words are below one deep internal node.
4. The runs of windows that start in an earlier document go back to the segments' occurrences, and the words they cover go.

Hashes only choose groups: words are compared as bytes, segments by a cryptographic digest.

Edge cases: null and empty texts have no words and keep the empty text; texts shorter than a window are kept whole; rows with a null
doc_id are kept whole and remove nothing (which of them is smaller can't be told); rows that repeat a doc_id are one document for the
comparison, so they remove nothing from each other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 50, 12
#: Different segments of one group that one suffix array takes (about two megabytes); larger groups are split by longer prefixes.
GROUP_SEGMENTS, LONGER_GRAMS = 4_000, (20, 35)
#: Bytes of a lot of groups that one suffix array is built over.
LOT_BYTES = 9_000_000
#: Words of a text that are cut into segments at once.
BLOCK_WORDS = 1 << 18
_POSITION = np.uint64((1 << 28) - 1)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of all n neighbouring values, by doubling."""
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def segments(texts: list[bytes], gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: (text index, first window's first word within the text, number of windows, key)."""
    hashes, begin = common.word_hashes(texts)
    none = np.zeros(0, np.int64)
    if len(hashes) < WINDOW:
        return none, none, none, none.astype(np.uint64)
    blocks = [_segments(hashes[a : a + BLOCK_WORDS + WINDOW - 1], begin, a, gram) for a in range(0, len(hashes) - WINDOW + 1, BLOCK_WORDS)]
    return tuple(np.concatenate(x) for x in zip(*blocks, strict=True))


def _segments(hashes: np.ndarray, begin: np.ndarray, at: int, gram: int) -> tuple[np.ndarray, ...]:
    """segments() of the words from `at` on; begin: the texts' first words."""
    none = np.zeros(0, np.int64)
    grams = common.Rolling(hashes).ranges(np.arange(len(hashes) - gram + 1), np.arange(gram, len(hashes) + 1))
    place = np.arange(len(grams), dtype=np.uint64)
    packed = (grams & ~_POSITION) | (_POSITION - (place & _POSITION))
    least = _least(packed, WINDOW - gram + 1)
    start = np.arange(len(least))
    text = np.searchsorted(begin, start + at, side="right") - 1
    valid = np.flatnonzero(start + at + WINDOW <= begin[text + 1])
    if not len(valid):
        return none, none, none, none.astype(np.uint64)
    chosen, text = least[valid], text[valid]
    fresh = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1] + 1))))
    count = np.diff(np.concatenate((fresh, [len(valid)])))
    first = valid[fresh]
    # the key is the whole gram's hash: its place is known from the packed value
    back = (_POSITION - (chosen[fresh] & _POSITION)).astype(np.int64)
    where = (first & ~np.int64(_POSITION)) | back
    where = np.where(where < first, where + np.int64(_POSITION) + 1, where)
    return text[fresh], first + at - begin[text[fresh]], count, grams[where]


def _prefixes(batches):
    for batch in batches:
        for part in common.steps(batch):
            text, _, _, key = segments(common.texts_of(part))
            ids, texts = (part.column(c).to_numpy(zero_copy_only=False)[text].astype(np.int64) for c in ("doc_id", "text_key"))
            pairs = np.unique(np.stack((key.view(np.int64), ids, texts), axis=1), axis=0) if len(text) else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], ["key", "doc_id", "text_key"])


def _shared_segments(with_text: bool):
    def run(batches):
        for batch in batches:
            for part in common.steps(batch, common.STEP_BYTES // 4):
                texts = common.texts_of(part)
                text, first, count, key = segments(texts)
                lists = part.column("keys")
                shared = lists.flatten().to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(np.isin(key.view(np.int64), shared))
                words, last, content, digest = [], -1, [], []
                for k in keep.tolist():
                    if text[k] != last:
                        last = int(text[k])
                        words = common.word_list(texts[last])
                    a, n = int(first[k]), int(count[k])
                    line = b" ".join(words[a : a + n + WINDOW - 1])
                    digest.append(hashlib.blake2b(line, digest_size=16).digest())
                    if with_text:
                        content.append(line)
                of = pa.array(text[keep])
                columns = {"doc_id": part.column("doc_id").take(of), "digest": pa.array(digest, pa.binary())}
                if with_text:
                    columns |= {"key": pa.array(key[keep].view(np.int64)), "words": pa.array(content, pa.binary())}
                else:
                    columns |= {"row": part.column("row").take(of), "first": pa.array(first[keep].astype(np.int32))}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def word_numbers(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the lines in a row, equal for equal words only, and the number of words of each line."""
    known: dict[bytes, int] = {}
    split = [line.split() for line in lines]
    numbers = [known.setdefault(w, len(known)) for words in split for w in words]
    return np.array(numbers, np.int64), np.fromiter(map(len, split), np.int64, len(split))


def deep_nodes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each start its topmost internal node (or leaf) of WINDOW words or more in the suffix tree of the starts, as a number.

    Every start has WINDOW words after it. The suffix array comes from doubling: ranks of 1, 2, 4 ... words, then the two ranks that make WINDOW.
    """
    rank, depth = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while depth * 2 <= WINDOW:
        top = int(rank.max()) + 1 if len(rank) else 1
        rank = np.unique(rank[: len(rank) - depth] * top + rank[depth:], return_inverse=True)[1].astype(np.int64)
        depth *= 2
    head, tail = rank[starts], rank[starts + WINDOW - depth]
    array = np.lexsort((tail, head))
    # neighbours whose longest common prefix is shorter than a window are below different nodes
    apart = (head[array[1:]] != head[array[:-1]]) | (tail[array[1:]] != tail[array[:-1]])
    node = np.empty(len(starts), np.int64)
    node[array] = np.concatenate(([0], np.cumsum(apart))) if len(array) else array
    return node


def _runs_of_lot(digest: list[bytes], low: np.ndarray, lines: list[bytes], least: np.ndarray, most: np.ndarray):
    """For each segment its runs of windows that start in an earlier document than the segment's last: arrays (segment, low, high, first document)."""
    words, counts = word_numbers(lines)
    sizes = counts - WINDOW + 1
    segment = np.repeat(np.arange(len(lines)), sizes)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of = deep_nodes(words, (np.cumsum(counts) - counts)[segment] + offset)
    first = np.full(int(of.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, of, least[segment])
    found = first[of]
    hit = np.flatnonzero(found < most[segment])
    if not len(hit):
        return None
    s, o, f = segment[hit], offset[hit], found[hit]
    fresh = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (f[1:] != f[:-1]) | (o[1:] != o[:-1] + 1))))
    last = np.concatenate((fresh[1:], [len(hit)])) - 1
    return [digest[k] for k in s[fresh].tolist()], low[s[fresh]] + o[fresh], low[s[fresh]] + o[last], f[fresh]


_SEGMENT = ("key", "digest", "low", "words", "least", "most")
_RUNS = "digest binary, low int, high int, earliest long"


def _trees(batches):
    """Sorted by key, a key's segments follow each other; a lot ends where a key does."""
    def emit(rows):
        _, digest, low, lines, least, most = zip(*rows, strict=True)
        got = _runs_of_lot(list(digest), np.array(low, np.int64), list(lines), np.array(least, np.int64), np.array(most, np.int64))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.binary()), pa.array(got[1].astype(np.int32)), pa.array(got[2].astype(np.int32)), pa.array(got[3])], ["digest", "low", "high", "earliest"])

    rows, total, key = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _SEGMENT), strict=True):
            if row[0] != key and total > LOT_BYTES:
                yield from emit(rows)
                rows, total = [], 0
            key = row[0]
            rows.append(row)
            total += len(row[3])
    if rows:
        yield from emit(rows)


def _recut(gram: int):
    """Segments to shorter ones, of the windows that have one anchor of `gram` words."""
    def run(batches):
        for batch in batches:
            for part in common.steps(batch, column="words"):
                lines = common.texts_of(part, "words")
                of, first, count, key = segments(lines, gram)
                split = [line.split() for line in lines]
                rows = pa.array(of)
                low = part.column("low").to_numpy(zero_copy_only=False)[of] + first
                words = [b" ".join(split[k][a : a + n + WINDOW - 1]) for k, a, n in zip(of.tolist(), first.tolist(), count.tolist(), strict=True)]
                columns = [pa.array(key.view(np.int64)), part.column("digest").take(rows), pa.array(low.astype(np.int32)), pa.array(words, pa.binary()), part.column("least").take(rows), part.column("most").take(rows)]
                yield pa.RecordBatch.from_arrays(columns, _SEGMENT)

    return run


def _windows(batches):
    """Segments to their single windows, with the window's digest as key."""
    for batch in batches:
        for digest, low, line, least, most in zip(*(batch.column(c).to_pylist() for c in _SEGMENT[1:]), strict=True):
            words = line.split()
            n = len(words) - WINDOW + 1
            keys = [hashlib.blake2b(b" ".join(words[i : i + WINDOW]), digest_size=16).digest() for i in range(n)]
            columns = [pa.array(keys, pa.binary()), pa.array([digest] * n, pa.binary()), pa.array(range(low, low + n), pa.int32()), pa.array([least] * n, pa.int64()), pa.array([most] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "low", "least", "most"])


def repeats(affected: DataFrame, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """(row, lo, hi): word ranges of the rows (row, doc_id, text, keys) that windows of an earlier document cover."""
    merged = affected.mapInArrow(_shared_segments(True), "doc_id long, digest binary, key long, words binary").groupBy("key", "digest", "words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    left = common.written(merged.select("key", "digest", F.lit(0).alias("low"), "words", "least", "most"), "segments")
    runs, large = None, None
    for gram in (GRAM, *LONGER_GRAMS):
        if large is not None:
            left = common.written(left.join(large, "key", "left_semi").mapInArrow(_recut(gram), "key long, digest binary, low int, words binary, least long, most long"), "segments")
        large = common.written(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group_segments).select("key"), "large")
        small = left.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_trees, _RUNS)
        runs = small if runs is None else runs.unionByName(small)
        if large.isEmpty():
            break
    else:  # each window of what is still crowded is a group, and a node
        windows = common.written(left.join(large, "key", "left_semi").mapInArrow(_windows, "key binary, digest binary, low int, least long, most long"), "windows")
        nodes = windows.groupBy("key").agg(F.min("least").alias("earliest"))
        runs = runs.unionByName(common.joined_unevenly(windows, nodes, "key").where("earliest < most").select("digest", "low", F.col("low").alias("high"), "earliest"))
    lists = common.written(runs.groupBy("digest").agg(F.collect_list(F.struct("low", "high", "earliest")).alias("runs")), "runs")  # at most the windows of a segment
    seen = common.written(affected.mapInArrow(_shared_segments(False), "doc_id long, digest binary, row long, first int"), "seen")
    found = common.joined_unevenly(seen, lists, "digest").select("doc_id", "row", "first", F.explode("runs").alias("run")).where("run.earliest < doc_id")
    return found.select("row", (F.col("first") + F.col("run.low")).alias("lo"), (F.col("first") + F.col("run.high") + WINDOW).alias("hi"))


def _kept_words(text: bytes, spans) -> tuple[int, list[bytes]]:
    words = common.word_list(text)
    if not spans:
        return len(words), words
    gone = np.zeros(len(words) + 1, np.int64)
    for x in spans:
        gone[x["lo"]] += 1
        gone[x["hi"]] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    return len(words), [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def _kept(batches):
    for batch in (part for whole in batches for part in common.steps(whole)):
        spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
        done = [_kept_words(t, s) for t, s in zip(common.texts_of(batch), spans, strict=True)]
        n, gone = [x for x, _ in done], [x - len(k) for x, k in done]
        lines = [b" ".join(k) for _, k in done]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in lines], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def repeats_removed(docs: DataFrame, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's words that no window of an earlier document covers, joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    keys = common.written(rows.where("doc_id is not null").mapInArrow(_prefixes, "key long, doc_id long, text_key long"), "prefixes")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key")
    # a list for each text, so no longer than the text; texts of equal hash have theirs together, which only adds keys
    lists = common.joined_unevenly(keys, shared, "key").groupBy("text_key").agg(F.collect_set("key").alias("keys"))
    listed = common.joined_unevenly(rows, lists, "text_key", how="left").select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("keys")).alias("keys"))
    marked = common.written(listed.withColumn("row", F.monotonically_increasing_id()), "marked", compression="zstd")
    affected = marked.where("keys is not null")
    spans = repeats(affected, group_segments).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    cut = affected.select("row", "doc_id", "text").join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(_kept, schema)
    return cut.unionByName(marked.where("keys is null").select("doc_id", "text").mapInArrow(_kept, schema))
