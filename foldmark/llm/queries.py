"""The registered queries of the training-data operators.

SQL can express op5; the others learn, search approximately, draw, hash, encode or store, so tests/llm holds them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, byte_bpe, common, media, mixing, periodic, pii, quality, simhash, substring, toxicity, urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LETTERS, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SURROGATE_KEY = b"a key of the caller's; queries use this one"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(_table(spark, sf_dir, "documents"), common.new_folder(spark, "media-shards"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats_removed(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(_table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_replaced")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded_digests(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(_table(spark, sf_dir, "documents"), LETTERS, PATTERN, PIECES)


def looped(docs: DataFrame) -> DataFrame:
    """documents whose texts have loops by the contract's rule: one id of ten repeats the words from some place on with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    docs = docs.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    n = F.size("words")
    docs = docs.withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))))
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    made = F.array_join(F.transform(place, lambda i: F.get("words", i.cast("int"))), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(looped(_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ann, op3_media, op4_mixing, op5_substring_dedup, op6_urls, op7_simhash, op8_bpe, op9_surrogates, op10_quality, op11_byte_bpe, op12_alignment, op13_periodic_runs)}

_OP5 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i : md5(array_to_string(w[i : i + 49], ' ')))) AS k FROM d WHERE len(w) >= 50),
earliest AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN earliest USING (k) WHERE first < doc_id),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS line FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": _OP5}
