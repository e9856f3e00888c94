"""The pipeline's stages: what each keeps, and the result against the stages' plain meaning."""

from collections import Counter

import corpus_pipeline
from foldmark.llm import bpe, common, pii, quality, queries, simhash

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.written(stage(spark, docs, SF_DIR), "stage")
        kept[name] = (docs, after)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        docs = after
    before, after = kept["quality classifier"]
    good = {r["doc_id"] for r in quality.scored(before, labels).where(f"score >= {quality.CUT}").collect()}
    assert {r["doc_id"] for r in after.collect()} == good and good
    before, after = kept["near-duplicates"]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(groups.values()))
    before, after = kept["personal data"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        found = pii.entities(texts[r["doc_id"]])
        assert (r["text"] == texts[r["doc_id"]]) == (not found) and r["n_chars"] == len(r["text"])
        assert not any(texts[r["doc_id"]][a:b] in r["text"] for a, b, _, _ in found)
    before, after = kept["mixing"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    taken = Counter((r["doc_id"], r["text"]) for r in after.collect())
    assert taken and all(texts[d] == t and n <= 3 for (d, t), n in taken.items())
    before, after = kept["token ids"]
    encoder = bpe.Encoder.of(queries.TOKENIZER)
    sizes = Counter((r["doc_id"], len(encoder.tokenizer.encode(r["text"], add_special_tokens=False).ids)) for r in before.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in after.collect()) == sizes


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "personal data", "mixing", "token ids"]
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
