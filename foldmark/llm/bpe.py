"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut into chunks at those ends of words where a rolling hash of the last eight bytes says so (one of MEAN_WORDS ends), so a passage is
cut the same way in every document. Chunks begin with their white space and tile the text.

1. Keys of all chunks are counted. Those that occur twice or more go into a bit map of MAP_BITS for each, FILTER_BITS at most whatever the
   input's size is; a wrong "yes" of the map costs a little work and changes nothing.
2. Documents without repeated chunks are encoded where they are read; of the others a table keeps the compressed text and the keys of such chunks.
3. Each chunk that occurs again is encoded once for the whole table: (key, ids), the ids packed into two or four bytes each.
4. The different texts of step 2's table get those ids by a join on chunk keys, then on the text's digest; only these texts are shuffled.
   Their chunks that occur once are encoded where they are. Results go to the documents by the text's digest.
5. Every join between two chunks of a text is tried: the last word of the left and the first of the right are encoded together, and where that
   disagrees with their separate ids the two chunks are merged and encoded again, until all joins agree. A worker remembers joins that agreed.

Within a chunk words that the worker has met are taken from a store of bounded size where `exact_words` finds in the tokenizer's own
description that it never looks across white space; for any other tokenizer a chunk is encoded in one piece.

Letters A-Z are put in lower case before the cut where the tokenizer does that itself, but for a letter followed by a byte beyond ASCII, which may
be a mark that the tokenizer composes with the capital first.

Decoding: a tokenizer without a decoder joins its tokens by spaces, so the decoded text is put together from the chunks'; with a
decoder the ids of the whole text are decoded at once.

Edge cases: null and empty texts, and texts of white space alone, have no ids and the empty decoded text; special tokens written out in a
text become their ids as in the library; rows are independent, so nulls in doc_id, repeated rows and empty tables need no rule;
a run without white space is never cut, however long; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: One end of a word in so many ends a chunk.
MEAN_WORDS = 128
#: Chunks up to this length are looked for in other documents; longer ones are encoded where they are.
SHARED_BYTES = 1 << 16
#: Bits of the map for each repeated chunk, and most bits of the map (32 MB).
MAP_BITS, FILTER_BITS = 64, 1 << 28
#: Words, and joins found good, that a worker remembers.
STORE_WORDS, STORE_WORD_BYTES, STORE_JOINS = 150_000, 512, 200_000
#: New words that are encoded in one call.
LINE_WORDS = 256
_BUCKET_BITS = 32_768


def exact_words(description: dict) -> bool:
    """Whether this tokenizer never looks across white space."""
    def parts(x, inner):
        return [] if not x else [y for p in x[inner] for y in parts(p, inner)] if x["type"] == "Sequence" else [x]

    split = parts(description.get("pre_tokenizer"), "pretokenizers")
    first = split[0] if split else {}
    pattern = first.get("pattern", {}).get("Regex", "") if first.get("type") == "Split" else ""
    removed = first.get("behavior") == "Removed" and first.get("invert") is True
    blind = bool(pattern) and all(not p.strip() == "" and " " not in p and ("\\s" not in p or p.startswith("[^\\s")) for p in pattern.split("|"))
    normal = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in parts(description.get("normalizer"), "normalizers"))
    added = all(not (t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])) for t in description.get("added_tokens", []))
    return removed and blind and normal and added and not description.get("post_processor")


class Encoder:
    """A tokenizer with what its worker remembers; one for each worker process and file."""

    _open: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        description = json.loads(self.tokenizer.to_str())
        self.exact, self.joined = exact_words(description), description.get("decoder") is None
        self.folds = '"Lowercase"' in json.dumps(description.get("normalizer"))
        self.added = [t["content"].lower().encode() for t in description.get("added_tokens", [])]
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.packed = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.decimal = [b"%d" % i for i in range(size)]
        self.shown = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.young: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.old: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.good: set[bytes] = set()

    def ids(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def folded(self, text: bytes) -> bytes:
        """The text with A-Z in lower case where that can't change its ids: not before a byte beyond ASCII, nor where it would spell an added token."""
        if not self.folds:
            return text
        if text.isascii():
            lower = text.lower()
        else:
            letters = np.frombuffer(text, np.uint8)
            capital = (letters >= 65) & (letters <= 90)
            capital[:-1] &= letters[1:] < 128
            lower = (letters + capital.view(np.uint8) * np.uint8(32)).tobytes()
        return text if any(t in lower for t in self.added) else lower

    def _ids_of_line(self, words: list[bytes]) -> list[list[int]]:
        """The words' ids, encoded as one line and parted where each word begins."""
        words = [w.decode() for w in words]
        begin = np.cumsum([0, *(len(w) + 1 for w in words)])
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = found.ids
        first = np.searchsorted(np.fromiter((a for a, _ in found.offsets), np.int64, len(ids)), begin)
        return [ids[a:b] for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]

    def entry(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        """(number of ids, ids in decimal, tokens), both joined by spaces."""
        return len(ids), b" ".join([self.decimal[i] for i in ids]), b" ".join([self.shown[i] for i in ids])

    def words(self, wanted: set[bytes]) -> dict[bytes, tuple[int, bytes, bytes]]:
        """The store, with all the words in it; for tokenizers with exact words."""
        young, old = self.young, self.old
        missing = []
        for w in wanted.difference(young):
            kept = old.get(w)
            if kept is None:
                missing.append(w)
            else:
                young[w] = kept
        for k in range(0, len(missing), LINE_WORDS):
            part = missing[k : k + LINE_WORDS]
            for w, ids in zip(part, self._ids_of_line(part), strict=True):
                young[w] = self.entry(ids)
        return young

    def forget(self) -> None:
        """After each step: what is too long to keep goes, and a full generation becomes the old one."""
        if len(self.young) > STORE_WORDS:
            self.old = {w: v for w, v in self.young.items() if len(w) <= STORE_WORD_BYTES}
            self.young = {}
        if len(self.good) > STORE_JOINS:
            self.good = set()

    def chunks(self, chunks: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """The entries of chunks that are encoded here and now."""
        if not self.exact:
            return [self.entry(x) for x in self.ids(chunks)]
        split = [c.split() for c in chunks]
        store = self.words({w for words in split for w in words})
        found = []
        for words in split:
            got = [v for v in map(store.__getitem__, words) if v[0]]
            found.append((sum([v[0] for v in got]), b" ".join([v[1] for v in got]), b" ".join([v[2] for v in got])))
        return found

    def broken(self, joins: set[tuple[bytes, bytes]]) -> set[tuple[bytes, bytes]]:
        """Of (last word of a chunk, first word of the next) those whose ids together are not their ids one after the other."""
        unknown = sorted(j for j in joins if b"".join(j) not in self.good)
        if not unknown:
            return set()
        together = self.ids([a + b for a, b in unknown])
        if self.exact:
            store = self.words({w for j in unknown for x in j for w in x.split()})
            apart = [b" ".join([store[w][1] for x in j for w in x.split() if store[w][0]]) for j in unknown]
            same = [b" ".join([self.decimal[i] for i in t]) == x for t, x in zip(together, apart, strict=True)]
        else:
            left, right = self.ids([a for a, _ in unknown]), self.ids([b for _, b in unknown])
            same = [t == a + b for t, a, b in zip(together, left, right, strict=True)]
        self.good.update(a + b for (a, b), s in zip(unknown, same, strict=True) if s and len(a) + len(b) <= STORE_WORD_BYTES)
        return {j for j, s in zip(unknown, same, strict=True) if not s}


_ROOM = 8


def cuts(texts: list[bytes]) -> list[list[bytes]]:
    """The chunks of each text in a row; each but the first begins with its white space, white space at the end belongs to the last."""
    if not texts:
        return []
    lead = b" " + b"\0" * _ROOM  # no window of a text reaches into another
    data = b"".join([x for t in texts for x in (lead, t)]) + b" "
    buffer = np.frombuffer(data, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths + len(lead)) - lengths
    space = common._SPACE[buffer]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    window = np.zeros(len(ends), np.uint64)
    for k in range(_ROOM):
        window |= buffer[ends - 1 - k].astype(np.uint64) << np.uint64(8 * k)
    ends = ends[common.mix64(window * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(MEAN_WORDS) == 0]
    low, high = np.searchsorted(ends, begin, side="right").tolist(), np.searchsorted(ends, begin + lengths).tolist()
    places, found = ends.tolist(), []
    for a, n, i, j in zip(begin.tolist(), lengths.tolist(), low, high, strict=True):
        bounds = [a, *places[i:j], a + n]
        found.append([data[x:y] for x, y in zip(bounds, bounds[1:], strict=False)] if n else [])
    return found


def cut(text: bytes) -> list[bytes]:
    return cuts([text])[0]


def _last_word(chunk: bytes) -> bytes:
    """The last word with the white space before it."""
    words = chunk.rstrip()
    start = len(words.rsplit(None, 1)[0]) if len(words.split(None, 1)) > 1 else 0
    return chunk[start:]


def _first_word(chunk: bytes) -> bytes:
    """The white space at the chunk's begin and its first word."""
    lead = len(chunk) - len(chunk.lstrip())
    words = chunk.split(None, 1)
    return chunk[: lead + len(words[0])] if words else chunk


def folded_cuts(encoder: Encoder, texts: list[bytes]) -> list[list[bytes]]:
    return cuts([encoder.folded(t) for t in texts])


def encode_texts(encoder: Encoder, texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    """For each text its number of ids, the ids in decimal and the decoded text, both joined by spaces."""
    return encode_chunks(encoder, folded_cuts(encoder, texts))


def encode_chunks(encoder: Encoder, cuts: list[list[bytes]], known: list[dict[bytes, bytes]] | None = None) -> list[tuple[int, bytes, bytes]]:
    """The same of texts cut into chunks; known: packed ids by chunk key, for each text."""
    entries: list[list] = []
    for k, chunks in enumerate(cuts):
        given = known[k] if known and known[k] else {}
        entries.append([encoder.entry(np.frombuffer(given[x], encoder.packed).tolist()) if given and (x := chunk_key(c)) in given else None for c in chunks])
    here = list(dict.fromkeys(c for chunks, got in zip(cuts, entries, strict=True) for c, e in zip(chunks, got, strict=True) if e is None))
    made = dict(zip(here, encoder.chunks(here), strict=True))
    joins = [[(_last_word(a), _first_word(b)) for a, b in zip(chunks, chunks[1:], strict=False)] for chunks in cuts]
    broken = encoder.broken({j for js in joins for j in js})
    done = []
    for chunks, got, js in zip(cuts, entries, joins, strict=True):
        got = [e or made[c] for c, e in zip(chunks, got, strict=True)]
        if broken and not broken.isdisjoint(js):
            got = _repaired(encoder, chunks, got)
        got = [v for v in got if v[0]]
        ids = b" ".join([v[1] for v in got])
        shown = b" ".join([v[2] for v in got]) if encoder.joined else encoder.tokenizer.decode(list(map(int, ids.split())), skip_special_tokens=False).encode()
        done.append((sum([v[0] for v in got]), ids, shown))
    encoder.forget()
    return done


def _repaired(encoder: Encoder, chunks: list[bytes], entries: list[tuple[int, bytes, bytes]]) -> list[tuple[int, bytes, bytes]]:
    """Entries of chunks merged and encoded again until every join agrees."""
    done: list[tuple[bytes, tuple[int, bytes, bytes]]] = []
    for text, entry in zip(chunks, entries, strict=True):
        while done and encoder.broken({(_last_word(done[-1][0]), _first_word(text))}):
            text = done.pop()[0] + text
            entry = encoder.entry(encoder.ids([text])[0])
        done.append((text, entry))
    return [e for _, e in done]


def chunk_key(chunk: bytes) -> bytes:
    """A cryptographic digest: equal keys, equal chunks."""
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _hashes(chunks: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(c) for c in chunks), np.uint64, len(chunks))


def _counted(path: str):
    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            for part in common.steps(batch):
                chunks = [c for x in folded_cuts(encoder, common.texts_of(part)) for c in x if len(c) <= SHARED_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(chunks).view(np.int64))], ["key"])

    return run


def repeated_chunks(rows: DataFrame, path: str) -> np.ndarray:
    """The bit map of the chunks that occur twice or more: at most FILTER_BITS / 8 bytes reach the driver."""
    twice = common.written(rows.select("text").mapInArrow(_counted(path), "key long").groupBy("key").count().where("count > 1").select("key"), "repeated")
    size, wanted = _BUCKET_BITS, min(FILTER_BITS, MAP_BITS * twice.count())
    while size < wanted:
        size *= 2
    place = F.pmod(F.col("key"), F.lit(size)) + 1  # the key's unsigned remainder, for the size is a power of two; Spark's maps count from one
    maps = twice.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    found = np.zeros(size // 8, np.uint8)
    for x in maps:
        begin = (x["bucket"] - 1) * (_BUCKET_BITS // 8)
        found[begin : begin + _BUCKET_BITS // 8] = np.frombuffer(x["bits"], np.uint8)
    return found


def _marked(bits: np.ndarray, chunks: list[bytes]) -> np.ndarray:
    place = _hashes(chunks) % np.uint64(len(bits) * 8)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _repeated(bits: np.ndarray, found: list[list[bytes]]) -> list[list[bytes]]:
    """Each text's different chunks that the map marks."""
    marked = iter(_marked(bits, [c for x in found for c in x]).tolist())
    return [list(dict.fromkeys([c for c in x if next(marked) and len(c) <= SHARED_BYTES])) for x in found]


_PENDING = "text_key binary, packed binary, keys array<binary>"


def _columns(doc_ids, done: list[tuple[int, bytes, bytes]], whole: bool) -> dict[str, pa.Array]:
    columns = {"doc_id": doc_ids, "n_tokens": pa.array([x[0] for x in done], pa.int64())}
    if whole:
        return columns | {"ids": pa.array([np.array(x[1].split(), np.int32) for x in done], pa.list_(pa.int32())), "decoded": pa.array([x[2].decode() for x in done], pa.string())}
    return columns | {name: pa.array([hashlib.sha256(x[k]).hexdigest() for x in done], pa.string()) for k, name in ((1, "ids_sha256"), (2, "decoded_sha256"))}


def _first_pass(path: str, bits, whole: bool):
    """Finished rows of documents without repeated chunks, pending ones of the others."""
    def run(batches):
        encoder, squeeze = Encoder.of(path), zstandard.ZstdCompressor()
        for batch in batches:
            for part in common.steps(batch, common.STEP_BYTES // 2):
                texts = common.texts_of(part)
                found = folded_cuts(encoder, texts)
                repeated = _repeated(bits.value, found)
                here = [k for k, r in enumerate(repeated) if not r]
                made = _columns(part.column("doc_id").take(pa.array(here, pa.int64())), encode_chunks(encoder, [found[k] for k in here]), whole)
                done = pa.RecordBatch.from_pydict(made | {"text_key": pa.nulls(len(here), pa.binary()), "packed": pa.nulls(len(here), pa.binary()), "keys": pa.nulls(len(here), pa.list_(pa.binary()))})
                yield done
                later = [k for k, r in enumerate(repeated) if r]
                waits = {f.name: pa.nulls(len(later), f.type) for f in done.schema} | {"doc_id": part.column("doc_id").take(pa.array(later, pa.int64()))}
                waits |= {"text_key": pa.array([hashlib.sha256(texts[k]).digest() for k in later], pa.binary()), "packed": pa.array([squeeze.compress(texts[k]) for k in later], pa.binary()), "keys": pa.array([[chunk_key(c) for c in repeated[k]] for k in later], pa.list_(pa.binary()))}
                yield pa.RecordBatch.from_pydict(waits)

    return run


def _chunk_texts(path: str):
    """(key, chunk) of the pending rows' repeated chunks."""
    def run(batches):
        encoder, unpack = Encoder.of(path), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in common.steps(batch, column="packed"):
                met: set[bytes] = set()
                new = [t for t, keys in zip(part.column("packed").to_pylist(), part.column("keys").to_pylist(), strict=True) if not met.issuperset(keys) and not met.update(keys)]
                chunks = {chunk_key(c): c for x in folded_cuts(encoder, [unpack.decompress(t) for t in new]) for c in x}
                found = {x: chunks[x] for x in met}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["key", "chunk"])

    return run


def _chunk_ids(path: str):
    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            for part in common.steps(batch, column="chunk"):
                done = encoder.chunks(common.texts_of(part, "chunk"))
                encoder.forget()
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([np.array(x[1].split(), encoder.packed).tobytes() for x in done], pa.binary())], ["key", "ids"])

    return run


def _second_pass(path: str, whole: bool):
    """Results of the pending texts, with the text's digest in place of the document's id."""
    def run(batches):
        encoder, unpack = Encoder.of(path), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in common.steps(batch, common.STEP_BYTES // 8, "packed"):
                known = [{x["key"]: x["ids"] for x in c or ()} for c in part.column("chunks").to_pylist()]
                found = folded_cuts(encoder, [unpack.decompress(x) for x in part.column("packed").to_pylist()])
                columns = _columns(part.column("text_key"), encode_chunks(encoder, found, known), whole)
                yield pa.RecordBatch.from_pydict({"text_key": columns.pop("doc_id"), **columns})

    return run


def _encoded(docs: DataFrame, path: str, whole: bool, schema: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = rows.sparkSession.sparkContext.broadcast(repeated_chunks(rows, path))  # FILTER_BITS bits at most
    first = common.written(rows.mapInArrow(_first_pass(path, bits, whole), f"{schema}, {_PENDING}"), "first-pass", compression="zstd")
    done, pending = first.where("packed is null").drop("text_key", "packed", "keys"), first.where("packed is not null").select("doc_id", "text_key", "packed", "keys")
    chunks = pending.select("packed", "keys").mapInArrow(_chunk_texts(path), "key binary, chunk binary").groupBy("key").agg(F.first("chunk").alias("chunk"))
    ids = common.written(chunks.mapInArrow(_chunk_ids(path), "key binary, ids binary"), "chunk-ids", compression="zstd")
    uses = pending.select("text_key", F.explode("keys").alias("key")).distinct()
    lists = common.joined_unevenly(uses, ids, "key").groupBy("text_key").agg(F.collect_list(F.struct("key", "ids")).alias("chunks"))  # no longer than the text
    # both sides are grouped by the text's digest, so the join shuffles neither again
    texts = pending.groupBy("text_key").agg(F.first("packed").alias("packed")).join(lists, "text_key")
    results = common.written(texts.mapInArrow(_second_pass(path, whole), schema.replace("doc_id long", "text_key binary")), "second-pass", compression="zstd")
    later = common.joined_unevenly(pending.select("doc_id", "text_key"), results, "text_key")
    return done.unionByName(later.select(done.columns))


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded string) for each document; `tokenizer` is a file every executor has."""
    return _encoded(docs, tokenizer, True, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The same with SHA-256 digests in place of the ids and the decoded text."""
    return _encoded(docs, tokenizer, False, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
