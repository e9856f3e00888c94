"""What several of the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled by one vectorised step inside a task, in bytes; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame written once as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """For each name itself, or with as many underscores after it as keep it apart from the columns (names in any letter case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo."""
    return F.crc32(key.cast("string")) % modulus


def one_label_each(labels: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """(key, label double), one row for each key; labels other than 0 and 1 and null keys are left out, of contradicting rows the larger counts."""
    return labels.where(F.col(column).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(column).cast("double")).alias("label"))


def bounded(df: DataFrame, most: int, *keys: Column) -> DataFrame:
    """At most about `most` rows of a frame with different keys, chosen by a hash of the keys; all rows where there are no more than that."""
    n = df.count()
    if n <= most:
        return df
    slots = 1 << 20
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(slots)) < int(slots * most / n))


#: A key on more than one of HEAVY_SHARE rows is heavy, so there are at most HEAVY_SHARE heavy keys, whatever the input's size is.
HEAVY_SHARE, HEAVY_ROWS = 1000, 64


def joined_unevenly(left: DataFrame, right: DataFrame, key: str, counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has each key at most once, where one key may be on a large share of left's rows.

    Rows of a heavy key are dealt by a hash of their other columns to as many parts as leave each about a thousandth of left's rows, and
    right's row of the key is repeated for each part. All heavy keys together have 2 * HEAVY_SHARE parts at most.
    counted: a cheaper frame with left's keys, to find the heavy ones in.
    """
    heavy_key, parts, salt = unused([*left.columns, *right.columns], "heavy", "parts", "salt")
    keys = (left if counted is None else counted).select(key)
    least = max(HEAVY_ROWS, keys.count() // HEAVY_SHARE)
    found = keys.groupBy(key).count().where(F.col("count") > least)
    heavy = F.broadcast(written(found.select(F.col(key).alias(heavy_key), F.ceil(F.col("count") / least).cast("int").alias(parts)), "heavy-keys"))  # HEAVY_SHARE keys at most
    others = [f.name for f in left.schema.fields if f.name != key and "map<" not in f.dataType.simpleString()]
    place = F.pmod(F.xxhash64(*others), F.col(parts)).cast("int")
    dealt = left.join(heavy, F.col(key) == F.col(heavy_key), "left").withColumn(salt, F.coalesce(place, F.lit(0))).drop(heavy_key, parts)
    places = F.when(F.col(parts).isNotNull(), F.sequence(F.lit(0), F.col(parts) - 1)).otherwise(F.array(F.lit(0)))
    repeated = right.join(heavy, F.col(key) == F.col(heavy_key), "left").withColumn(salt, F.explode(places)).drop(heavy_key, parts)
    return dealt.join(repeated, [key, salt], how).drop(salt)


def steps(batch: pa.RecordBatch, most: int = STEP_BYTES, column: str = "text"):
    """Slices of an Arrow batch with about `most` bytes of text each."""
    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary() if batch.column(column).type == pa.string() else pa.large_binary()).to_pylist()]


def word_list(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than space and \\x09-\\x0D, which is what bytes.split() takes as white space."""
    return text.split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of ranges of a sequence of 64-bit values, from one running sum, modulo 2**64; for sequences of bounded length."""

    FACTOR = 0x9E3779B97F4A7C15 | 1
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers) < n:
            size = max(n, STEP_BYTES + 4096)
            for name, base in (("_powers", cls.FACTOR), ("_inverse", pow(cls.FACTOR, -1, 1 << 64))):
                filled = np.full(size, base, np.uint64)
                filled[0] = 1
                setattr(cls, name, np.multiply.accumulate(filled))
        return cls._powers, cls._inverse

    def __init__(self, values: np.ndarray):
        powers, _ = self.powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, inverse = self.powers(len(self.sums))
        return mix64((self.sums[ends] - self.sums[starts]) * inverse[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SPACES = re.compile(rb"[\x20\x09-\x0d]")
#: A random value for each byte.
_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
#: Longer words are hashed by themselves.
LONG_WORD = 1 << 16


def _pieces(data: bytes):
    """(start, end) of pieces of about STEP_BYTES that end at white space, words over LONG_WORD alone."""
    at = 0
    while at < len(data):
        found = _SPACES.search(data, min(at + STEP_BYTES, len(data) - 1))
        end = found.end() if found else len(data)
        if end - at > STEP_BYTES + LONG_WORD:
            # the last word is a long one: what is before it is a piece, then the word
            before = max(data.rfind(s, at, at + STEP_BYTES) for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            if before >= at:
                yield at, before + 1
                at = before + 1
        yield at, end
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts in a row, and for each text the index of its first word (one more at the end).

    Equal words have equal hashes; different ones may too. Memory is that of a piece and eight bytes a word, however long a text is.
    """
    data = b" ".join(texts) + b" "
    hashes, starts_of = [], []
    for begin, end in _pieces(data):
        buffer = np.frombuffer(data, np.uint8, end - begin, begin)
        if end - begin > STEP_BYTES + LONG_WORD:
            words = data[begin:end].split()
            hashes.append(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
            starts_of.append(np.array([begin + data[begin:end].find(w) for w in words], np.int64))
            continue
        space = _SPACE[buffer]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        made = Rolling(_BYTE[buffer]).ranges(starts, ends) + (ends - starts).astype(np.uint64)
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            made[k] = xxhash.xxh3_64_intdigest(data[begin + int(starts[k]) : begin + int(ends[k])])
        hashes.append(made)
        starts_of.append(starts + begin)
    hashes, starts = np.concatenate(hashes), np.concatenate(starts_of)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    return hashes, np.searchsorted(starts, begin)
