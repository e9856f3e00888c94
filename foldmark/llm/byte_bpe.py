"""Byte-level BPE encoding and decoding by overlapping chunks.

1. A text is cut into chunks of STEP characters that overlap by OVERLAP. A text of one chunk is encoded where it is read; the chunks of longer
   texts go into a table, compressed, under the text's digest, so that any tasks may take them.
2. Each chunk is pre-tokenised by itself, from its first character. Kept are the ends of pre-tokens within the overlaps.
3. The pattern only looks ahead, so two pre-tokenisations that share one boundary agree from there on. Where the true one of a chunk and its
   successor's first share a boundary is the stitch: the piece of the chunk ends and the successor's begins there. The first chunk of a text is
   true from its start, each later one from its stitch. Boundaries less than LOOK characters before a cut are not trusted.
4. Pieces are encoded, every pre-token by itself, and put together by the text's digest in order; a task holds one piece at a time.

An overlap in which nothing resynchronises (a run of one kind of characters longer than it) makes all of the text from that chunk on one
piece; so the ids are those of the whole text in any case.

Decoding puts the tokens' raw bytes together.

Edge cases: null and empty texts have no ids and no bytes; strings of special tokens are ordinary text; rows are independent, so null and
repeated ids and empty tables need no rule, and equal long texts are encoded once; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Characters from one chunk's begin to the next one's, and what a chunk has beyond that.
STEP, OVERLAP = 16_384, 512
#: A pre-token of the pattern depends on no more than so many characters after its end (contractions look at two).
LOOK = 4
#: Pre-tokens that a worker remembers, and their greatest length.
STORE, STORE_CHARS = 200_000, 64


class Codec:
    """Ranks and pattern with what the worker remembers; one for each worker process and file."""

    _open: dict[tuple[str, str], "Codec"] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal = [b"%d" % i for i in range(len(self.tokens))]
        self.store: dict[str, tuple[int, bytes, bytes]] = {}

    def ends(self, text: str) -> np.ndarray:
        """The ends of the pre-tokens of a text taken by itself."""
        return np.cumsum(np.fromiter(map(len, self.pattern.findall(text)), np.int64))

    def entry(self, token: str) -> tuple[int, bytes, bytes]:
        ids = self.encoding._encode_single_piece(token)
        return len(ids), b" ".join([self.decimal[i] for i in ids]), self.decoded(ids)

    def decoded(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def encoded(self, pretokens: list[str]) -> tuple[int, bytes, bytes]:
        """(number of ids, ids in decimal joined by spaces, decoded bytes)."""
        store, new = self.store, set(pretokens).difference(self.store)
        for token in new:
            store[token] = self.entry(token)
        got = [store[t] for t in pretokens]
        done = sum([x[0] for x in got]), b" ".join([x[1] for x in got]), b"".join([x[2] for x in got])
        for token in new:
            if len(token) > STORE_CHARS:
                del store[token]
        if len(store) > STORE:
            store.clear()
        return done

    def part(self, text: str, start: int, stop: int | None) -> tuple[int, bytes, bytes]:
        """The piece of a chunk between two of its boundaries."""
        found = self.pattern.findall(text, start)
        if stop is not None:
            ends = start + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            n = int(np.searchsorted(ends, stop, "right"))
            if (int(ends[n - 1]) if n else start) != stop:
                raise ValueError("the pattern looks further ahead than LOOK characters, or behind")
            found = found[:n]
        return self.encoded(found)


def chunks(text: str) -> list[str]:
    """Overlapping chunks; the last one is longer than the overlap, unless it is the only one."""
    return [text[at : at + STEP + OVERLAP] for at in range(0, max(1, len(text) - OVERLAP), STEP)]


_PENDING = "text_key binary, chunk int, packed binary"
_RESULT = {False: "n_tokens long, ids_sha256 string, decoded_sha256 string", True: "n_tokens long, ids array<int>, decoded binary"}


def _columns(done: list[tuple[int, bytes, bytes]], whole: bool) -> dict[str, pa.Array]:
    columns = {"n_tokens": pa.array([x[0] for x in done], pa.int64())}
    if whole:
        ids = pa.array([np.array(x[1].split(), np.int32) for x in done], pa.list_(pa.int32()))
        return columns | {"ids": ids, "decoded": pa.array([x[2] for x in done], pa.binary())}
    return columns | {c: pa.array([hashlib.sha256(x[k]).hexdigest() for x in done], pa.string()) for k, c in ((1, "ids_sha256"), (2, "decoded_sha256"))}


def _first_pass(path: str, pattern: str, whole: bool):
    """Results of texts of one chunk; of longer ones a row that waits for the text's result, and once in a task the chunks."""
    def run(batches):
        codec, squeeze, met = Codec.of(path, pattern), zstandard.ZstdCompressor(), set()
        for batch in batches:
            for part in common.steps(batch):
                rows: list[tuple[int | None, bytes | None, int | None, bytes | None]] = []
                done = []
                for k, data in enumerate(common.texts_of(part)):
                    cut = chunks(data.decode())
                    if len(cut) == 1:
                        rows.append((k, None, None, None))
                        done.append(codec.encoded(codec.pattern.findall(cut[0])))
                        continue
                    key = hashlib.sha256(data).digest()
                    rows.append((k, key, None, None))
                    done.append(None)
                    if key not in met:
                        met.add(key)
                        rows += [(None, key, i, squeeze.compress(c.encode())) for i, c in enumerate(cut)]
                        done += [None] * len(cut)
                ready = _columns([x for x in done if x], whole)
                place = itertools.count()
                take = pa.array([next(place) if x else None for x in done], pa.int64())
                columns = {"doc_id": part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))}
                columns |= {name: x.take(take) for name, x in ready.items()}
                columns |= {name: pa.array([r[k] for r in rows], kind) for k, name, kind in ((1, "text_key", pa.binary()), (2, "chunk", pa.int32()), (3, "packed", pa.binary()))}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _boundaries(path: str, pattern: str):
    """For each chunk its pre-tokens' ends within the overlap before it and the one after it, as places in the text."""
    def run(batches):
        codec, unpack = Codec.of(path, pattern), zstandard.ZstdDecompressor()
        for batch in batches:
            head, tail = [], []
            for i, packed in zip(batch.column("chunk").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                ends = np.concatenate(([0], codec.ends(unpack.decompress(packed).decode())))
                head.append(ends[ends <= OVERLAP - LOOK] + i * STEP)
                tail.append(ends[(ends >= STEP) & (ends <= STEP + OVERLAP - LOOK)] + i * STEP)
            kind = pa.list_(pa.int64())
            columns = [batch.column("text_key"), batch.column("chunk"), pa.array(head, kind), pa.array(tail, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "chunk", "head", "tail"])

    return run


def stitches(bounds: DataFrame) -> DataFrame:
    """(text_key, chunk, piece, start, stop) from each chunk's boundaries in its overlaps.

    Chunks of one piece are to be joined; start is within the first chunk of the piece, stop within the last (null: the text's end).
    """
    ordered = Window.partitionBy("text_key").orderBy("chunk")
    met = bounds.withColumn("stitch", F.when(F.col("chunk") > 0, F.array_min(F.array_intersect("head", F.lag("tail").over(ordered)))))
    missing = F.min(F.when((F.col("chunk") > 0) & F.col("stitch").isNull(), F.col("chunk"))).over(Window.partitionBy("text_key"))
    met = met.withColumn("stop", F.lead("stitch").over(ordered)).withColumn("last", missing - 1)
    joined = F.col("chunk") >= F.col("last")
    start = F.coalesce(F.col("stitch"), F.lit(0)) - F.col("chunk") * STEP
    stop = F.when(~F.coalesce(joined, F.lit(False)), F.col("stop") - F.col("chunk") * STEP)
    return met.select("text_key", "chunk", F.when(joined, F.col("last")).otherwise(F.col("chunk")).alias("piece"), start.alias("start"), stop.alias("stop"))


def _grouped(batches, *keys: str):
    """(key, rows) of streamed rows that come in the order of their keys; rows are read one by one."""
    rows = (r for batch in batches for r in batch.to_pylist())
    return itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _pieces(path: str, pattern: str):
    def run(batches):
        codec, unpack = Codec.of(path, pattern), zstandard.ZstdDecompressor()
        for (key, piece), rows in _grouped(batches, "text_key", "piece"):
            first = last = next(rows)
            parts = [unpack.decompress(first["packed"]).decode()]
            for last in rows:
                parts[-1] = parts[-1][:STEP]
                parts.append(unpack.decompress(last["packed"]).decode())
            n, ids, _ = codec.part("".join(parts), first["start"], last["stop"])
            yield pa.RecordBatch.from_pylist([{"text_key": key, "piece": piece, "n": n, "ids": np.array(ids.split(), np.uint32).tobytes()}], _PIECE)

    return run


_PIECE = pa.schema([("text_key", pa.binary()), ("piece", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])


def _together(path: str, pattern: str, whole: bool):
    """A text's result from its pieces in order; without `whole` only digests grow."""
    def run(batches):
        codec = Codec.of(path, pattern)
        for (key,), rows in _grouped(batches, "text_key"):
            n, shown, raw = 0, hashlib.sha256(), hashlib.sha256()
            all_ids, all_raw = [], []
            for row in rows:
                ids = np.frombuffer(row["ids"], np.uint32).tolist()
                decimal, decoded = b" ".join([codec.decimal[i] for i in ids]), codec.decoded(ids)
                if whole:
                    all_ids += ids
                    all_raw.append(decoded)
                elif ids:
                    shown.update(b" " + decimal if n else decimal)
                    raw.update(decoded)
                n += len(ids)
            done = {"ids": pa.array([all_ids], pa.list_(pa.int32())), "decoded": pa.array([b"".join(all_raw)], pa.binary())} if whole else {"ids_sha256": pa.array([shown.hexdigest()]), "decoded_sha256": pa.array([raw.hexdigest()])}
            yield pa.RecordBatch.from_pydict({"text_key": pa.array([key], pa.binary()), "n_tokens": pa.array([n], pa.int64()), **done})

    return run


def _encoded(docs: DataFrame, ranks: str, pattern: str, whole: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = _RESULT[whole]
    # small row groups, so that one long text's chunks are read by many tasks
    first = common.written(rows.mapInArrow(_first_pass(ranks, pattern, whole), f"doc_id long, {result}, {_PENDING}"), "chunks", compression="zstd", **{"parquet.block.size": str(4 << 20)})
    done = first.where("text_key is null").drop("text_key", "chunk", "packed")
    waiting = first.where("text_key is not null and chunk is null").select("doc_id", "text_key")
    cut = first.where("chunk is not null").select("text_key", "chunk", "packed")
    # tasks that met copies of one text give equal rows for its chunks
    bounds = cut.mapInArrow(_boundaries(ranks, pattern), "text_key binary, chunk int, head array<long>, tail array<long>").dropDuplicates(["text_key", "chunk"])
    placed = cut.groupBy("text_key", "chunk").agg(F.first("packed").alias("packed")).join(stitches(bounds), ["text_key", "chunk"])
    ordered = placed.repartition("text_key", "piece").sortWithinPartitions("text_key", "piece", "chunk")
    pieces = ordered.select("text_key", "piece", "packed", "start", "stop").mapInArrow(_pieces(ranks, pattern), "text_key binary, piece int, n long, ids binary")
    gathered = pieces.repartition("text_key").sortWithinPartitions("text_key", "piece").mapInArrow(_together(ranks, pattern, whole), f"text_key binary, {result}")
    later = common.joined_unevenly(waiting, common.written(gathered, "long-texts", compression="zstd"), "text_key")
    return done.unionByName(later.select(done.columns))


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded binary) for each document; `ranks` is a file every executor has."""
    return _encoded(docs, ranks, pattern, True)


def encoded_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The same with SHA-256 digests in place of the ids and the decoded bytes."""
    return _encoded(docs, ranks, pattern, False)


def decoded(ids: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The frame with `decoded` (binary) for its `ids` (array<int>); null ids give null."""
    place = ids.columns

    def run(batches):
        codec = Codec.of(ranks, pattern)
        for batch in batches:
            raw = [None if x is None else codec.decoded(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in place), pa.array(raw, pa.binary())], [*place, "decoded"])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema.fields if f.name != "decoded"]
    place = [c for c in place if c != "decoded"]
    return ids.mapInArrow(run, ", ".join([*types, "decoded binary"]))
