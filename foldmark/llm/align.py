"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping, and corpus-wide counts of linked ids.

Both tokenizers encode a space and the text. Tokens are byte ranges, so the ends of A's and B's tokens are two ascending arrays. The walk
goes along a diagonal, the current shift between the two indices: exponential probing compares ever longer stretches of both arrays at that shift
and jumps over them, halving finds the place where they part. There an irregular group is resolved token by token until both sides end on one
byte; the walk goes on with the new shift. Each step gives links, the pairs of tokens whose ranges overlap.

Counting: each document has its linked id pairs with their multiplicities, packed in a table. Tasks count the documents of each pair before the
shuffle. The most frequent pairs, HEAD at most, are broadcast with their counts; a document's other pairs are joined by pair with the rest of the counts
and summed by the text's digest, so the result is exact whatever the vocabulary is. Whether a pair's count is the highest of its A id comes
from a window by A id, which holds a row for each id of B at most.

Tokens come from stores of words that a worker has met: A's pre-tokens are encoded one by one, B's text is cut between a non-space and a space,
over which no piece of its vocabulary reaches (checked; else, or where a text holds the piece's own mark for a space, the whole text is encoded).

Edge cases: null and empty texts, and texts that A's or B's tokens don't spell byte for byte, have no tokens: zeros and an empty string; special tokens'
strings are plain text; rows are independent, so null and repeated ids need no rule (each row counts as a document); extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Most pairs whose counts are broadcast (17 bytes each).
HEAD = 1 << 20
#: Different pairs that a task counts before it passes them on.
COUNTED = 1 << 21
#: Words that a worker remembers for each tokenizer, and their greatest length.
STORE, STORE_CHARS = 200_000, 64
#: Words that A and B encode in one call; their tokens are told apart by the bytes that they spell.
TOGETHER_A, TOGETHER_B = 512, 64
#: The first probe of a diagonal, in tokens.
PROBE = 4
#: Marks that stand for a space in B's pieces, and B's byte pieces.
MARK, BYTE_PIECE = "▁", re.compile("<0x([0-9A-F]{2})>")
_SEGMENT = re.compile(" *[^ ]+| +")


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level tokenizers write for bytes: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Words:
    """Ids of words in a store of bounded size: word -> (packed ids, bytes that they spell)."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.packed = np.dtype("<u2" if len(spelled) <= 1 << 16 else "<u4")
        self.store: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # of words that their ids don't spell

    def split(self, text: str) -> list[str]:
        raise NotImplementedError

    def encoded(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def together(self, words: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Words with the ids of all of them, one word's after another's; words that must be encoded apart may be left out."""
        raise NotImplementedError

    def entries(self, words: set[str]) -> None:
        """Puts words that aren't in the store into it."""
        missing = list(words)
        for part, ids in self.together(missing):
            place = np.array(ids, np.int64)
            lengths = self.lengths[place]
            ends, due = np.cumsum(lengths), np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in part])
            upto = np.searchsorted(ends, due, "right")
            # else words that don't spell themselves, which are then encoded one by one
            if lengths.all() and np.array_equal(ends[upto - 1], due) and b"".join(map(self.spelled.__getitem__, ids)) == "".join(part).encode():
                raw, cuts = place.astype(self.packed).tobytes(), (upto * self.packed.itemsize).tolist()
                self.store.update(zip(part, [raw[begin:end] for begin, end in zip([0, *cuts], cuts, strict=False)], strict=True))
        missing = [w for w in missing if w not in self.store]
        for word, ids in zip(missing, self.encoded(missing) if missing else (), strict=True):
            self.store[word] = np.array(ids, self.packed).tobytes()
            raw = b"".join([self.spelled[i] for i in ids])
            if raw != word.encode():
                self.odd[word] = raw

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text in a row, None where they don't spell the text."""
        split = [self.split(t) for t in texts]
        met = set(itertools.filterfalse(self.store.__contains__, itertools.chain.from_iterable(split)))
        self.entries(met)
        store, found = self.store, []
        for text, words in zip(texts, split, strict=True):
            ids = np.frombuffer(b"".join(map(store.__getitem__, words)), self.packed)
            if self.odd and not self.odd.keys().isdisjoint(words) and b"".join([self.odd.get(w) or w.encode() for w in words]) != text.encode():
                ids = None
            found.append(ids)
        for word in [w for w in met if len(w) > STORE_CHARS]:
            del store[word]
            self.odd.pop(word, None)
        if len(store) > STORE:
            # the words of this step stay, frequent ones are among them
            used = store.keys() & set(itertools.chain.from_iterable(split))
            self.store = {w: store[w] for w in used} if len(used) <= STORE // 2 else {}
            self.odd = {w: raw for w, raw in self.odd.items() if w in self.store}
        return found


class LettersBPE(_Words):
    """A: a byte-level tokenizer described in JSON, whose pre-tokens are the matches of `pattern`."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(pattern)
        letters, added = byte_of_letter(), {t["id"] for t in json.loads(self.tokenizer.to_str()).get("added_tokens", [])}
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        super().__init__([b"" if i not in names else names[i].encode() if i in added else bytes(letters[c] for c in names[i]) for i in range(1 + max(names))])

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encoded(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def together(self, words: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        for part in itertools.batched(words, TOGETHER_A):
            yield part, self.tokenizer.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids


class PiecesBPE(_Words):
    """B: a sentencepiece model that puts a space before the text; words are given with it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.space = [self.model.piece_to_id(MARK)]
        byte = [BYTE_PIECE.fullmatch(p) for p in pieces]
        super().__init__([bytes([int(m[1], 16)]) if m else p.replace(MARK, " ").encode() for p, m in zip(pieces, byte, strict=True)])

    def split(self, text: str) -> list[str]:
        return _SEGMENT.findall(text) if self.apart and MARK not in text else [text]

    def encoded(self, words: list[str]) -> list[list[int]]:
        # the model drops the space that it adds where nothing follows
        return [self.space if w == " " else ids for w, ids in zip(words, self.model.encode([w[1:] for w in words], num_threads=1), strict=True)]

    def together(self, words: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        # words that `split` would cut out of their joined text again; the first one's space is the one that the model adds
        parts = [list(p) for p in itertools.batched([w for w in words if MARK not in w and w[-1] != " "], TOGETHER_B)] if self.apart else []
        return zip(parts, self.model.encode(["".join(p)[1:] for p in parts], num_threads=1) if parts else [], strict=True)


class Pair:
    """The two tokenizers of a worker."""

    _open: dict[tuple[str, str, str], "Pair"] = {}

    @classmethod
    def of(cls, a: str, pattern: str, b: str) -> "Pair":
        if (a, pattern, b) not in cls._open:
            cls._open[a, pattern, b] = cls(a, pattern, b)
        return cls._open[a, pattern, b]

    def __init__(self, a: str, pattern: str, b: str):
        self.a, self.b = LettersBPE(a, pattern), PiecesBPE(b)
        self.size_a, self.size_b = len(self.a.spelled), len(self.b.spelled)
        self.packed = np.dtype("<u4" if self.size_a * self.size_b <= 1 << 32 else "<u8")
        # what stands before the next id: a comma within a side, | between the sides, ; between groups
        self.shown = np.array([b"%d%s" % (i, mark) for words, marks in ((self.a, (b",", b"|")), (self.b, (b",", b";"))) for mark in marks for i in range(len(words.spelled))], object)

    def tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        given = [" " + t.decode() for t in texts]
        return [None if a is None or b is None or len(t) == 1 else (a, b) for t, a, b in zip(given, self.a.ids(given), self.b.ids(given), strict=True)]


def walk(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of two tokenisations of the same bytes, as indices of tokens, from the tokens' lengths."""
    a, b = lengths_a.astype("<u4").tobytes(), lengths_b.astype("<u4").tobytes()
    of_a, of_b = lengths_a.tolist(), lengths_b.tolist()
    n, m = len(of_a), len(of_b)
    # a link is one number, its token of A times 2^32 and its token of B
    firsts, runs, singles = [], [], []
    i = j = 0
    while i < n:
        # along the diagonal: both arrays end on one byte before i and j, so equal lengths are equal ends at this shift
        if of_a[i] == of_b[j]:
            at, shift, probe = 4 * i, 4 * (j - i), 4 * PROBE
            limit = 4 * (n if n - i < m - j else i + m - j)
            while at + probe <= limit and a[at : at + probe] == b[at + shift : at + shift + probe]:
                at += probe
                probe += probe
            while probe > 4:
                probe >>= 1
                if at + probe <= limit and a[at : at + probe] == b[at + shift : at + shift + probe]:
                    at += probe
            run = (at >> 2) - i
            firsts.append(i << 32 | j)
            runs.append(run)
            i += run
            j += run
            if i == n:
                break
        # an irregular group: the side that ends first goes on, until both end on one byte
        ahead = of_a[i] - of_b[j]
        singles.append(i << 32 | j)
        while ahead:
            if ahead < 0:
                i += 1
                ahead += of_a[i]
            else:
                j += 1
                ahead -= of_b[j]
            singles.append(i << 32 | j)
        i += 1
        j += 1
    count = np.array(runs, np.int64)
    along = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    links = np.concatenate([np.repeat(np.array(firsts, np.int64), count) + along * ((1 << 32) + 1), np.array(singles, np.int64)])
    links.sort()
    return links >> 32, links & 0xFFFFFFFF


class Aligned:
    """The alignment of the texts of a step, all of which have tokens, as one sequence: texts end on one byte on both sides."""

    def __init__(self, pair: Pair, tokens: list[tuple[np.ndarray, np.ndarray]]):
        self.pair = pair
        self.n_a, self.n_b = (np.fromiter((len(t[k]) for t in tokens), np.int64, len(tokens)) for k in (0, 1))
        self.a, self.b = (np.concatenate([t[k] for t in tokens]).astype(np.int64) if tokens else np.zeros(0, np.int64) for k in (0, 1))
        lengths_a, lengths_b = pair.a.lengths[self.a], pair.b.lengths[self.b]
        self.link_a, self.link_b = walk(lengths_a, lengths_b)
        closes = np.cumsum(lengths_a)[self.link_a] == np.cumsum(lengths_b)[self.link_b]
        self.last_a, self.last_b = self.link_a[closes], self.link_b[closes]  # of each group
        self.text_of_link = np.searchsorted(np.cumsum(self.n_a), self.link_a, "right")
        self.n_links = np.bincount(self.text_of_link, minlength=len(tokens))
        self.n_groups = np.bincount(self.text_of_link[closes], minlength=len(tokens))

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's different linked id pairs (A's id times B's vocabulary, and B's id) in ascending order with their numbers of links."""
        keys, found = self.a[self.link_a] * self.pair.size_b + self.b[self.link_b], []
        ends = np.cumsum(self.n_links)
        for k, end in enumerate(ends.tolist()):
            found.append(np.unique(keys[end - int(self.n_links[k]) : end], return_counts=True))
        return found

    def groups(self) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        size_a, size_b = self.pair.size_a, self.pair.size_b
        sizes_a, sizes_b = (np.diff(x, prepend=-1) for x in (self.last_a, self.last_b))
        mark_a, mark_b = self.a.copy(), self.b + 2 * size_a
        mark_a[self.last_a] += size_a
        mark_b[self.last_b] += size_b
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)] = mark_a
        order[np.arange(len(self.b)) + np.repeat(np.cumsum(sizes_a), sizes_b)] = mark_b
        shown, ends = self.pair.shown[order].tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(shown[begin:end])[:-1] for begin, end in zip([0, *ends], ends, strict=False)]


_KEPT = "doc_id long, text_key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _first_pass(a: str, pattern: str, b: str):
    """For each document its counts, the digest of its groups and its packed pairs with their numbers of links."""
    def run(batches):
        pair = Pair.of(a, pattern, b)
        for batch in batches:
            for part in common.steps(batch):
                texts = common.texts_of(part)
                tokens = pair.tokens(texts)
                place = {k: at for at, k in enumerate(k for k, t in enumerate(tokens) if t)}
                done = Aligned(pair, [tokens[k] for k in place])
                columns: dict[str, list] = {"n_a": done.n_a.tolist(), "n_b": done.n_b.tolist(), "n_groups": done.n_groups.tolist(), "n_links": done.n_links.tolist()}
                empty = dict.fromkeys(columns, 0) | {"groups_sha256": "", "pairs": b"", "times": b""}
                columns["groups_sha256"] = [hashlib.sha256(x).hexdigest() for x in done.groups()]
                found = done.pairs()
                columns["pairs"], columns["times"] = [np.diff(p, prepend=0).astype(pair.packed).tobytes() for p, _ in found], [t.astype(_TIMES).tobytes() for _, t in found]
                out = {name: [x[place[k]] if k in place else empty[name] for k in range(len(texts))] for name, x in columns.items()}
                keys = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
                arrays = {n: pa.array(x, pa.string() if n == "groups_sha256" else pa.binary() if n in ("pairs", "times") else pa.int64()) for n, x in out.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_key": keys, **arrays})

    return run


_TIMES = np.dtype("<u4")


def _lists(batch: pa.RecordBatch, packed: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of all rows, their numbers of links, and how many pairs each row has."""
    count = pc.fill_null(pc.binary_length(batch.column("times")), 0).to_numpy(zero_copy_only=False).astype(np.int64) // _TIMES.itemsize
    steps = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), packed).astype(np.int64)
    begin = (np.cumsum(count) - count)[count > 0]
    sums = np.cumsum(steps)
    sums -= np.repeat(np.concatenate(([0], sums))[begin], count[count > 0])  # a row's differences start anew
    return sums, np.frombuffer(b"".join(batch.column("times").to_pylist()), _TIMES).astype(np.int64), count


def _counted(packed: np.dtype):
    """(pair, documents) of a task's rows, passed on whenever COUNTED different pairs have come together."""
    def row_batch(pairs, n):
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    def run(batches):
        held, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            pairs, _, _ = _lists(batch, packed)
            waiting.append(np.unique(pairs, return_counts=True))
            size += len(waiting[-1][0])
            if size > COUNTED // 2:
                held, waiting, size = _merged([held, *waiting]), [], 0
                if len(held[0]) > COUNTED:
                    yield row_batch(*held)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield row_batch(*_merged([held, *waiting]))

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, place, np.concatenate([c for _, c in parts]))
    return pairs, n


def counts(first: DataFrame, packed: np.dtype, size_b: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair, and whether no other pair of its A id has more."""
    n = first.select("pairs", "times").mapInArrow(_counted(packed), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / size_b).cast("long"))  # a row for each id of B at most
    return n.withColumn("best", F.col("n") == F.max("n").over(of_a))


def split_head(counted: DataFrame, most: int):
    """(pair, n, best) arrays of the most frequent pairs, `most` at most, by pair; and the other pairs' rows."""
    octave = F.floor(F.log2("n")).cast("int")
    sizes, least, total = {r["octave"]: r["pairs"] for r in counted.groupBy(octave.alias("octave")).agg(F.count("*").alias("pairs")).collect()}, 64, 0
    while least and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    head = counted.where(octave >= least).toArrow().sort_by("pair")
    return [head.column(c).to_numpy() for c in ("pair", "n", "best")], counted.where(octave < least)


def _second_pass(packed: np.dtype, head):
    """Sums over the pairs of the head, and each document's other pairs."""
    def run(batches):
        known, n, best = head.value
        weight, wins = np.append(n, 0), np.append(best, False)  # one more, for pairs that aren't known
        for batch in batches:
            for part in common.steps(batch, common.STEP_BYTES, "pairs"):
                pairs, times, count = _lists(part, packed)
                place = np.searchsorted(known, pairs)
                met = np.append(known, -1)[place] == pairs
                place[~met] = len(known)
                row = np.repeat(np.arange(len(count)), count)
                sums = {"count_sum": np.zeros(len(count), np.int64), "n_best": np.zeros(len(count), np.int64)}
                np.add.at(sums["count_sum"], row, times * weight[place])
                np.add.at(sums["n_best"], row, times * wins[place])
                others, ends = np.flatnonzero(~met), np.cumsum(np.bincount(row[~met], minlength=len(count)))
                offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                rest = {name: pa.ListArray.from_arrays(offsets, pa.array(x[others], pa.int64())) for name, x in (("rest", pairs), ("rest_times", times))}
                keep = {c: part.column(c) for c in part.schema.names if c not in ("pairs", "times")}
                yield pa.RecordBatch.from_pydict(keep | {c: pa.array(x) for c, x in sums.items()} | rest)

    return run


def aligned(docs: DataFrame, a: str, pattern: str, b: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each document.

    a, b: files of the tokenizers that every executor has; pattern: A's pre-tokens. n_best counts links whose pair is in as many documents as any pair of
    its A id, count_sum sums the links' numbers of documents.
    """
    spark, pair = docs.sparkSession, Pair.of(a, pattern, b)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = common.written(rows.mapInArrow(_first_pass(a, pattern, b), _KEPT), "aligned", compression="zstd")
    counted = common.written(counts(first, pair.packed, pair.size_b), "pair-counts", compression="zstd")
    frequent, rare = split_head(counted, head)
    kept = [c for c in first.columns if c not in ("pairs", "times")]
    sums = first.mapInArrow(_second_pass(pair.packed, spark.sparkContext.broadcast(frequent)), f"{_KEPT.split(', pairs')[0]}, count_sum long, n_best long, rest array<long>, rest_times array<long>")
    sums = common.written(sums, "pair-sums", compression="zstd")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    done, waiting = sums.where("size(rest) = 0").select(columns), sums.where("size(rest) > 0")
    uses = waiting.select("text_key", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("text_key", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    # copies of a text count once here; a rare pair is in few documents, so no key of this join is heavy
    more = uses.groupBy("text_key", "pair").agg(F.max("times").alias("times")).join(rare, "pair").groupBy("text_key").agg(
        F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    later = common.joined_unevenly(waiting.select(*kept, "count_sum", "n_best"), common.written(more, "rare-sums"), "text_key")
    later = later.withColumn("count_sum", F.col("count_sum") + F.col("more_sum")).withColumn("n_best", F.col("n_best") + F.col("more_best"))
    return done.unionByName(later.select(columns))


_LINKS = "doc_id long, a_ids array<int>, b_ids array<int>, groups string, link_a array<int>, link_b array<int>"


def links(docs: DataFrame, a: str, pattern: str, b: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, groups, link_a, link_b): ids, groups as text, and the links as indices into the ids."""
    def run(batches):
        pair = Pair.of(a, pattern, b)
        for batch in batches:
            for part in common.steps(batch):
                tokens = pair.tokens(common.texts_of(part))
                rows = []
                for doc_id, t in zip(part.column("doc_id").to_pylist(), tokens, strict=True):
                    done = Aligned(pair, [t] if t else [])
                    rows.append((doc_id, done.a, done.b, done.groups()[0].decode() if t else "", done.link_a, done.link_b))
                kinds = [pa.int64(), *[pa.list_(pa.int32())] * 2, pa.string(), *[pa.list_(pa.int32())] * 2]
                columns = [pa.array([np.asarray(r[k], np.int32) if k in (1, 2, 4, 5) else r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _LINKS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _LINKS)
