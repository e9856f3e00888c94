"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon and of its word stems, how many of their hits are near a word of the second person, shares of
capitals, shouted words and punctuation, and rates of obfuscated words (letters replaced by digits or signs) and of those that spell
lexicon words. The lexicon is the fixed list below and what the training rows teach: words and four-letter stems whose share of toxic
documents is significantly higher.

Training rows are those whose remainder isn't HELD_OUT, by remainder: two folds teach the lexicon, one the trees, one the calibration, at every
size, so no part is fitted on what an earlier part has seen. LABELLED bounds the labelled rows used (a hash of the id chooses).

Edge cases: null and empty texts are scored like any text, with all densities 0; rows with a null doc_id are scored and count as not
held out, without a label; of contradicting labels the larger counts; where the trees' fold lacks a class every score is the prior, where the calibration's does the trees'
probability;
repeated rows get equal scores; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, trees

MODULUS, HELD_OUT = 5, 0
LABELLED, STEM = 40_000, 4
#: A word counts from this many standard errors of its log odds.
CERTAIN = 3.0
# Insults in the four languages, the start of the lexicon.
INSULTS = """idiot idiots stupid moron morons clown worthless pathetic loser losers scum trash disgusting dumb ugly hate garbage filthy
dumm idiotisch trottel abschaum widerlich versager stupide imbécile crétin ordure dégoûtant minable estúpido imbécil basura asqueroso patético""".split()
# Words of the second person.
SECOND_PERSON = "you your yours yourself ur u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tus vosotros usted ustedes".split()
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, "#": None})
_RUN = re.compile(r"\S+")
_WORD, _OBFUSCATED, _SHOUTED = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_][0-9@$*!|#]+[^\W\d_]"), re.compile(r"\b[A-ZÄÖÜÉÈÀÑ]{3,}\b")
_NEAR = 5
NAMES = ["length", "lexicon", "lexicon_count", "lexicon_kinds", "stems", "stem_count", "fixed", "second_person", "near_second_person", "capitals", "shouted", "exclaimed", "asked", "punctuation", "digits", "obfuscated", "obfuscated_lexicon"]


def features_of(text: str, words: frozenset, stems: frozenset, fixed=frozenset(INSULTS), second=frozenset(SECOND_PERSON)) -> list[float]:
    """The features in the order of NAMES."""
    lower = text.lower()
    tokens = _WORD.findall(lower)
    n = max(1, len(tokens))
    hits = [i for i, w in enumerate(tokens) if w in words]
    near = 0
    if hits:
        you = np.array([i for i, w in enumerate(tokens) if w in second], np.int64)
        # both lists ascend: a hit is near where a word of the second person lies in its reach
        near = int((np.searchsorted(you, np.array(hits) - _NEAR) < np.searchsorted(you, np.array(hits) + _NEAR, "right")).sum())
        persons = len(you)
    else:
        persons = sum(1 for w in tokens if w in second)
    rooted = sum(1 for w in tokens if w[:STEM] in stems)
    insults = sum(1 for i in hits if tokens[i] in fixed)
    hidden = spelt = 0
    for run in _RUN.findall(lower) if _OBFUSCATED.search(lower) else ():
        here = len(_OBFUSCATED.findall(run))
        hidden += here
        if here and not words.isdisjoint(_WORD.findall(run.translate(_LEET))):
            spelt += here
    count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size = max(1, len(text))
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    return [math.log1p(len(tokens)), 100 * len(hits) / n, math.log1p(len(hits)), math.log1p(len({tokens[i] for i in hits})), 100 * rooted / n, math.log1p(rooted), 100 * insults / n, 100 * persons / n, math.log1p(near), int(count[65:91].sum()) / letters, len(_SHOUTED.findall(text)) / n, 100 * int(count[33]) / size, 100 * int(count[63]) / size, 100 * marks / size, 100 * int(count[48:58].sum()) / size, 100 * hidden / n, math.log1p(spelt)]


def _features(words: frozenset, stems: frozenset):
    def run(batches):
        for batch in (part for whole in batches for part in common.steps(whole)):
            made = [features_of(t or "", words, stems) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "features"])

    return run


def lexicon(rows: DataFrame, term) -> list[str]:
    """The terms (term(text): an array column) whose share of documents with label 1 is significantly higher; as many as the bounded sample of labelled rows teaches."""
    found = rows.select("label", F.explode(F.array_distinct(term)).alias("word")).where("word <> ''").groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).where("bad >= 4")
    total = rows.agg(F.sum("label").alias("bad"), F.count("*").alias("n")).first()
    if not total["bad"]:
        return []
    bad, good = float(total["bad"]), float(total["n"] - total["bad"])
    odds = F.log((F.col("bad") + 0.5) / (bad - F.col("bad") + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good - F.col("n") + F.col("bad") + 1))
    rated = found.withColumn("certain", odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))).where((F.col("certain") >= CERTAIN) & (odds >= 1.5))
    return [x["word"] for x in rated.select("word").collect()]


def scored(docs: DataFrame, labels: DataFrame, column: str = "toxic", labelled: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score) for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = common.one_label_each(labels, column).withColumn("fold", common.remainder(F.col("_key"), MODULUS)).where(F.col("fold") != HELD_OUT)
    known = common.written(common.bounded(known, labelled, F.col("_key")), "labelled")
    taught = rows.join(F.broadcast(known.where(F.col("fold").isin(1, 2))), rows["doc_id"] == F.col("_key"))  # `labelled` rows at most
    lower = F.lower(F.coalesce("text", F.lit("")))
    tokens = F.split(lower, r"[^\p{L}]+")
    words = frozenset(lexicon(taught, tokens)) | frozenset(INSULTS)
    stems = frozenset(lexicon(taught, F.transform(tokens, lambda w: F.substring(w, 1, STEM))))
    made = common.written(rows.mapInArrow(_features(words, stems), "doc_id long, features array<double>"), "features")
    train = common.written(made.join(F.broadcast(known), made["doc_id"] == F.col("_key")).select("features", "label", "fold"), "train")
    prior = train.agg(F.avg("label")).first()[0]
    prior = 0.5 if prior is None else prior
    model = trees.fit(train.where("fold = 3"))
    levels = trees.calibration(trees.probability(model, train.where("fold = 4"), prior))
    out = trees.calibrated(levels, trees.probability(model, made, prior))
    return out.select("doc_id", F.coalesce(common.remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score")
