"""Media columns: content-addressed payloads in tar shards, with rows of digest, offset and length.

A payload is stored as a grey image of 8-bit samples, WIDTH samples a row (PNG, so lossless). Its address is the digest of the image
file: equal payloads are one member of one shard. What rows hold is the reference (digest, shard, offset, length); the metadata columns
(width, height, bit depth) come from a range read of the image's header alone, and only features read whole members.

1. A map task encodes each payload that it has not met yet and appends it to its own tar shard, in a folder that executors and driver share:
   no payload is shuffled. A retried task writes a shard of another name, which nothing refers to.
2. The members' rows (a written table, so shards are not written twice) are grouped by payload and one place of each is kept: an address has
   one member that all rows refer to, and other tasks' copies of it are left unreferred to, at most one in a shard.
3. Readers take the index by shard and offset, with range reads through the file system that the folder's address names.
4. References are joined to the rows on the text's digest; a digest that many rows hold is dealt to several tasks.

Edge cases: null and empty texts are one row of padding (an image of one row); equal texts have equal values, so repeated rows share a
member; rows with a null doc_id are kept; a very long text is a taller image; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, PAD = 576, 255
LEVEL = 6
#: Bytes that hold a PNG's signature and its first chunk, the header.
HEADER_BYTES = 33
#: Bytes of members that one task reads back.
READ_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    """The text with padding up to a positive multiple of WIDTH."""
    return text + bytes([PAD]) * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """A grey PNG, 8 bits a sample, whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter's number, none
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first bytes of a PNG."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def samples_of(image: bytes) -> bytes:
    """The payload that a stored image holds."""
    width, height, _ = header_of(image)
    body, at = [], 8
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            body.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, standard deviation and the shares of eight equal ranges of the samples, then a difference hash of 8 x 8 block means."""
    samples = np.frombuffer(payload, np.uint8)
    count = np.bincount(samples, minlength=256)
    values = np.arange(256)
    mean = float(count @ values) / len(samples)
    spread = max(0.0, float(count @ (values * values)) / len(samples) - mean * mean) ** 0.5
    shares = count.reshape(8, 32).sum(axis=1) / len(samples)
    edges = np.linspace(0, len(samples), 66).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(samples, dtype=np.int64)))
    means = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, np.diff(edges))
    bits = np.packbits(means[1:] > means[:-1]).tobytes().hex()
    return f"{mean:.4f} {spread:.4f} {' '.join(f'{x:.4f}' for x in shares)} {bits}"


def _file_system(folder: str):
    """The file system of a folder's address, and the folder's path in it; Hadoop's names of one store are taken too."""
    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://")):
        folder = ours + folder.removeprefix(theirs) if folder.startswith(theirs) else folder
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


_MEMBER = "text_key binary, digest string, shard string, offset long, length long"


class _Shard:
    """A tar file that a task writes member by member."""

    def __init__(self, folder: str):
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
        self.out = system.open_output_stream(f"{path}/{self.name}")

    def add(self, digest: str, image: bytes) -> int:
        """Writes a member; the offset of its bytes."""
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(image)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + image + b"\0" * (-len(image) % 512))
        begin = self.at + len(head)
        self.at = begin + len(image) + (-len(image) % 512)
        return begin

    def close(self) -> None:
        """Ends the archive with two empty blocks, up to a whole record."""
        self.out.write(b"\0" * (1024 + (-(self.at + 1024) % tarfile.RECORDSIZE)))
        self.out.close()


def _members(folder: str):
    def run(batches):
        met: set[bytes] = set()
        shard = None
        for batch in (part for whole in batches for part in common.steps(whole)):
            rows = []
            for text in common.texts_of(batch):
                key = hashlib.sha256(text).digest()
                if key in met:
                    continue
                met.add(key)
                image = to_image(padded(text))
                digest = hashlib.sha256(image).hexdigest()
                shard = shard or _Shard(folder)
                rows.append((key, digest, shard.name, shard.add(digest, image), len(image)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["text_key", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    return run


def stored(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the documents' payloads into tar shards under `folder`; (text_key, digest, shard, offset, length), one row for each payload."""
    members = common.written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_members(folder), _MEMBER), "media-members", compression="zstd")
    one = members.groupBy("text_key").agg(F.min(F.struct("shard", "offset", "length", "digest")).alias("m")).select("text_key", "m.digest", "m.shard", "m.offset", "m.length")
    return common.written(one.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset"), "media-index", compression="zstd")


def _dealt(index: DataFrame) -> DataFrame:
    """The index in as many parts of neighbouring members as their bytes ask for."""
    parts = max(index.sparkSession.sparkContext.defaultParallelism, (index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES)
    return index.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")


class _Ranges:
    """Range reads from the shards of a folder, the last shard kept open."""

    def __init__(self, folder: str):
        self.system, self.path = _file_system(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.name, self.file = shard, self.system.open_input_file(f"{self.path}/{shard}")
        return self.file.read_at(length, offset)


def _with(index: DataFrame, folder: str, make, names: str) -> DataFrame:
    """The index with columns made from range reads: make(read, offset, length) -> tuple."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]

    def run(batches):
        ranges = _Ranges(folder)
        for batch in batches:
            made = [make(lambda a, n, s=s: ranges.read(s, a, n), a, n) for s, a, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)]
            columns = [pa.array([x[k] for x in made], kinds[kind]) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(n for n, _ in fields)])

    return index.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields) + ", " + names)


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and bit_depth, from a read of each member's first bytes only."""
    return _with(index, folder, lambda read, a, n: header_of(read(a, min(n, HEADER_BYTES))), "width int, height int, bit_depth int")


def _details(read, offset: int, length: int) -> tuple:
    image = read(offset, length)
    payload = samples_of(image)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(image).hexdigest(), feature_of(payload)


def with_features(index: DataFrame, folder: str) -> DataFrame:
    """The index with what the stored members hold, read back whole."""
    return _with(index, folder, _details, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length, width, height, bit_depth, payload_bytes, payload_sha256, tail_crc32, media_sha256, feature)."""
    index = stored(docs, folder)
    media = common.written(with_features(with_metadata(_dealt(index), folder), folder), "media", compression="zstd")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), F.unhex(F.sha2("payload", 256)).alias("text_key"))
    return common.joined_unevenly(keyed, media, "text_key").drop("text_key")
