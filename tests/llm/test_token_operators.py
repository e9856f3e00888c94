"""Byte-level BPE, alignment of tokenizers and periodic runs against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldmark.llm import align, byte_bpe, common, periodic, queries

from conftest_words import prose


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def ranks():
    with open(queries.RANKS, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["a", "B", "1", "²", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", "!", "...", "é", "漢", "🙂", " ", " ", "́", "_", "\x1c", "\x85", "\x0b", "<|endoftext|>", "▁", "<s>", "the ", "\x00"]


def odd_text(r, most):
    return "".join(r.choice(ODD) for _ in range(r.randint(0, most)))


def test_every_character_is_classed_as_the_library_does(library):
    codec = byte_bpe.Codec.of(queries.RANKS, queries.PATTERN)
    wrong = []
    for c in (*range(0x32000), *range(0xE0000, 0xE0200)):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}{chr(c)}"
            if codec.encoded(codec.pattern.findall(text))[1] != " ".join(map(str, library.encode_ordinary(text))).encode():
                wrong.append(c)
    assert wrong == []


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STEP", 96)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 24)


def test_chunks_overlap_and_cover(small_chunks):
    for n in (0, 1, 24, 96, 119, 120, 121, 216, 217, 1000):
        text = "".join(chr(97 + k % 26) for k in range(n))
        cut = byte_bpe.chunks(text)
        assert "".join([*(c[: byte_bpe.STEP] for c in cut[:-1]), cut[-1]]) == text
        assert len(cut) == 1 or len(cut[-1]) > byte_bpe.OVERLAP


def test_byte_bpe(spark, docs, library):
    got = byte_bpe.encoded_digests(docs, queries.RANKS, queries.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert byte_bpe.encoded_digests(docs.where("false"), queries.RANKS, queries.PATTERN).count() == 0


def test_stitched_pieces_are_the_whole_text(spark, library, monkeypatch):
    """Small chunks over texts in which boundaries resynchronise at once, late, or (runs longer than an overlap) not at all."""
    r = random.Random(11)
    texts = [odd_text(r, 400) for _ in range(60)]
    texts += ["x" * 500 + " end of it", " " * 300 + "y " * 90, "a b" * 40 + "7" * 200 + " c" * 100 + "z" * 400, "'re" * 200, "漢字" * 200, prose(3, 200), "\n\n\nx " * 60, "word " * 30 + "q" * 97 + " more words " * 20]
    found = defaultdict(list)
    codec = byte_bpe.Codec.of(queries.RANKS, queries.PATTERN)
    monkeypatch.setattr(byte_bpe, "STEP", 96)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 24)
    # the tasks run in workers of their own, so the steps are taken here with the small sizes, and the stitches by Spark
    rows = []
    for k, text in enumerate(texts):
        for i, chunk in enumerate(byte_bpe.chunks(text)):
            ends = np.concatenate(([0], codec.ends(chunk)))
            head, tail = ends[ends <= 24 - byte_bpe.LOOK] + i * 96, ends[(ends >= 96) & (ends <= 120 - byte_bpe.LOOK)] + i * 96
            rows.append((bytes([k]), i, head.tolist(), tail.tolist()))
    for s in byte_bpe.stitches(spark.createDataFrame(rows, "text_key binary, chunk int, head array<long>, tail array<long>")).orderBy("text_key", "chunk").collect():
        found[s["text_key"][0]].append(s)
    joined = 0
    for k, text in enumerate(texts):
        ids, cut, rest = [], byte_bpe.chunks(text), found[k]
        while rest:
            piece = [s for s in rest if s["piece"] == rest[0]["piece"]]
            rest = rest[len(piece) :]
            joined += len(piece) > 1
            whole = "".join([*(cut[s["chunk"]][:96] for s in piece[:-1]), cut[piece[-1]["chunk"]]])
            ids += codec.part(whole, piece[0]["start"], piece[-1]["stop"])[1].split()
        assert list(map(int, ids)) == library.encode_ordinary(text), text
    assert joined >= 4


def test_byte_bpe_of_long_texts(spark, library):
    """Texts of many chunks, copies of them, and one that never resynchronises."""
    long, run = " ".join(prose(k, 2000) for k in range(5)), "b" * 40_000 + " and on " + prose(9, 3000)
    rows = [(1, long), (2, long), (None, long), (3, run), (4, "short"), (4, long + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = byte_bpe.encoded(docs, queries.RANKS, queries.PATTERN).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in rows)
    again = byte_bpe.decoded(spark.createDataFrame([(1, library.encode_ordinary(long)), (2, None), (3, [])], "doc_id long, ids array<int>"), queries.RANKS, queries.PATTERN)
    assert {r["doc_id"]: r["decoded"] and bytes(r["decoded"]) for r in again.collect()} == {1: long.encode(), 2: None, 3: b""}


class Plain:
    """Alignment by comparing all ranges."""

    def __init__(self, ranks):
        self.a = Tokenizer.from_file(queries.LETTERS)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
        self.raw = {i: t for t, i in ranks.items()}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def of(self, text):
        """(ids of A, ids of B, groups, links) or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if not b"".join(self.raw[i] for i in a) == b"".join(map(self.piece, b)) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum([len(self.raw[i]) for i in a]).tolist(), np.cumsum([len(self.piece(i)) for i in b]).tolist()
        groups, links, x, y = [], [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links += [(p, q) for p in range(x, i) for q in range(y, j) if max(([0] + ends_a)[p], ([0] + ends_b)[q]) < min(ends_a[p], ends_b[q])]
            x, y = i, j
        return a, b, groups, links


def plain_alignment(plain, rows):
    found = [(i, plain.of(t)) for i, t in rows]
    count = Counter(p for _, x in found if x for p in {(x[0][i], x[1][j]) for i, j in x[3]})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = Counter()
    for i, x in found:
        if not x:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        pairs = [(x[0][p], x[1][q]) for p, q in x[3]]
        out[i, len(x[0]), len(x[1]), len(x[2]), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), sha(";".join(x[2]).encode())] += 1
    return out


@pytest.mark.parametrize("head", [align.HEAD, 40, 0])
def test_alignment(spark, ranks, texts, head):
    r = random.Random(4)
    rows = [(k, t if t is None else t[:4000]) for k, t in enumerate(texts)] + [(100 + k, odd_text(r, 60)) for k in range(150)] + [(7, texts[7]), (None, texts[6])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pairs string, n_a int").repartition(3)
    got = align.aligned(docs, queries.LETTERS, queries.PATTERN, queries.PIECES, head)
    assert Counter(map(tuple, got.collect())) == plain_alignment(Plain(ranks), rows)
    assert align.aligned(docs.where("false"), queries.LETTERS, queries.PATTERN, queries.PIECES, head).count() == 0


def test_links(spark, ranks):
    plain, rows = Plain(ranks), [(1, "unbelievable  résumés, 漢字!\n\n\tdone"), (2, None), (3, "▁no"), (4, prose(2, 300))]
    got = {r["doc_id"]: r for r in align.links(spark.createDataFrame(rows, "doc_id long, text string"), queries.LETTERS, queries.PATTERN, queries.PIECES).collect()}
    for i, text in rows:
        a, b, groups, links = plain.of(text) or ([], [], [], [])
        assert (got[i]["a_ids"], got[i]["b_ids"], got[i]["groups"]) == (a, b, ";".join(groups))
        assert sorted(zip(got[i]["link_a"], got[i]["link_b"], strict=True)) == sorted(links)


def test_words_encoded_together_have_the_ids_of_words_encoded_apart(monkeypatch):
    r = random.Random(9)
    texts = [" " + odd_text(r, 60) for _ in range(200)] + [" " + prose(3, 300), " ", "   ", " ▁a ▁ b ", " x  "]
    for words in (align.LettersBPE(queries.LETTERS, queries.PATTERN), align.PiecesBPE(queries.PIECES)):
        met, given = {w for t in texts for w in words.split(t)}, []
        apart = dict(zip(met, words.encoded(list(met)), strict=True))
        one_by_one = words.encoded
        monkeypatch.setattr(words, "encoded", lambda x, given=given, f=one_by_one: given.extend(x) or f(x))
        words.entries(met)
        assert {w: np.frombuffer(x, words.packed).tolist() for w, x in words.store.items()} == {w: list(x) for w, x in apart.items()}
        spelled = {w: b"".join(words.spelled[i] for i in x) for w, x in apart.items()}
        assert words.odd == {w: raw for w, raw in spelled.items() if raw != w.encode()}
        usual = " " + prose(4, 300)
        given.clear()
        assert words.ids([usual])[0].tolist() == [i for x in one_by_one(words.split(usual)) for i in x] and not given


def test_a_full_store_keeps_the_words_in_use(monkeypatch):
    monkeypatch.setattr(align, "STORE", 40)
    words = align.LettersBPE(queries.LETTERS, queries.PATTERN)
    words.ids(["".join(f" {c}" for c in "abcdefghijklmnopqrstuvwxyzABCD")])
    words.ids([" a b" + "".join(f" {c}" for c in "EFGHIJKLMNOPQRS")])
    assert words.store.keys() == {f" {c}" for c in "abEFGHIJKLMNOPQRS"}


def test_diagonals_of_every_shape():
    """The walk against all ends, with long one-to-one stretches, shifts that change, and long irregular groups."""
    r = np.random.default_rng(5)
    for _ in range(300):
        ends = np.cumsum(r.integers(1, 4, r.integers(1, 400)))
        keep = [np.concatenate((x[:-1] < r.choice([0.3, 0.9, 1.0]), [True])) for x in (r.random(len(ends)), r.random(len(ends)))]
        a, b = (np.diff(ends[k], prepend=0) for k in keep)
        got = list(zip(*(x.tolist() for x in align.walk(a, b)), strict=True))
        cuts = np.union1d(ends[keep[0]], ends[keep[1]])
        assert got == list(zip(np.searchsorted(ends[keep[0]], cuts).tolist(), np.searchsorted(ends[keep[1]], cuts).tolist(), strict=True))


def plain_runs(words):
    """For each period the stretches of places whose word is met again a period later."""
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int32)
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([0], w[q:] == w[:-q], [0]))
        edge = np.flatnonzero(np.diff(same))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start + q >= max(6, 4 * q):
                found.setdefault((start, end - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def loops(r, parts, most_period, most_length, letters=(1, 2, 3, 30)):
    words = []
    for _ in range(parts):
        base = [b"%d" % r.randint(0, r.choice(letters)) for _ in range(r.randint(1, most_period))]
        words += (base * r.randint(1, 12))[: r.randint(1, most_length)]
    return words


def test_runs_of_many_short_texts():
    r = random.Random(1)
    for _ in range(200):
        texts = [loops(r, r.randint(0, 6), 25, 120) for _ in range(r.randint(1, 6))]
        assert [[tuple(x) for x in found.tolist()] for found in periodic.runs_of_texts(texts)] == [plain_runs(w) for w in texts]


def test_fragments_of_tiles_make_the_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic, "TILE", 64)
    r, rows, want = random.Random(2), [], {}
    for k in range(40):
        words = loops(r, r.randint(1, 8), 60, 400)
        codes = periodic.coded([words])[:-1].astype(np.int32)
        want[k] = plain_runs(words)
        for low, high, begin, end in periodic.tiles(len(codes)):
            batch = periodic.pa.RecordBatch.from_pylist([{"text_key": bytes([k]), "lowest": low, "highest": high, "begin": begin, "n_words": len(codes), "codes": periodic.zstandard.ZstdCompressor().compress(codes[begin:end].tobytes())}])
            rows += [(f["text_key"], f["period"], f["start"], f["end"]) for out in periodic._solved([batch]) for f in out.to_pylist()]
    got = defaultdict(list)
    for x in periodic.stitched(spark.createDataFrame(rows, "text_key binary, period long, start long, end long")).collect():
        got[x["text_key"][0]].append((x["start"], x["length"], x["period"]))
    assert {k: sorted(got[k]) for k in want} == want


def test_periodic_runs(spark, docs, texts):
    r = random.Random(3)
    long = loops(r, 12, 2500, 4000, (2, 30, 3000))
    looped = [b"one"] * 9000 + [b"end"]
    more = spark.createDataFrame([(50, b" ".join(long).decode()), (51, b" ".join(looped).decode()), (52, b" ".join(looped).decode()), (None, "a a a a a a")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more).repartition(3)
    got = periodic.runs(both).collect()
    want = Counter()
    for row in both.collect():
        words = (row["text"] or "").encode().split()
        found = plain_runs(words)
        want[row["doc_id"], tuple(found), plain_collapsed(words, found)] += 1
    assert Counter((g["doc_id"], tuple(map(tuple, g["runs"])), g["collapsed"].encode()) for g in got) == want
    assert periodic.runs(docs.where("false")).count() == 0


def test_periodic_query(spark, tmp_path, texts):
    rows = [(k, texts[k % len(texts)]) for k in range(60)] + [(None, texts[5]), (3, texts[3])]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_runs int").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for i, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        want[i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % x for x in runs).encode()), sha(plain_collapsed(words, runs))] += 1
    assert got == want


def test_parts_of_a_heavy_key_follow_its_rows(spark):
    """A key on a third of the rows goes to hundreds of parts, and the join keeps each row."""
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("x"))
    right = spark.range(30_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("y"))
    joined = common.joined_unevenly(left, right, "key")
    assert joined.count() == 30_000 and joined.where("y != key * 2").count() == 0
