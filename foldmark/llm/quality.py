"""Document quality by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs: one of label 1 is preferred to one of label 0. A document's strength is linear in its features,
and the logistic loss of a pair is that of the difference of the two strengths, so the fit is a logistic regression without
intercept on differences of standardised features. Each labelled document meets PAIRS opponents, by its place in a hashed order.

The threshold is a quantile of the training strengths, the one of a hundred that tells the two labels apart best (mean of the two
shares of right answers). A score is the logistic function of the strength, shifted so that the threshold scores exactly CUT.

Training rows are those whose remainder isn't HELD_OUT; LABELLED bounds them (a hash of the id chooses).

Edge cases: null and empty texts are scored like any text, with all shares 0; rows with a null doc_id are scored and count as not held
out, without a label; of contradicting labels the larger counts; without labels of both kinds every score is 0.85 where none is 0 and 0.35 where
none is 1; repeated rows get equal scores; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, trees

MODULUS, HELD_OUT, CUT = 4, 2, 0.7
LABELLED, PAIRS = 20_000, 8
#: Standardised features are held within so many standard deviations.
LIMIT = 8.0
_PLAIN = re.compile(rb"(?<![^\x20\x09-\x0d])[^\x00-\x40\x5b-\x60\x7b-\x7f]+[,.;:?!]?(?![^\x20\x09-\x0d])")
_SIGNS = [ord(c) for c in "#%$&*|@^~<>{}[]\\=_+/"]


def features_of(text: bytes) -> list[float]:
    """Shares of characters, words and lines, some with their square roots."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    upper, lower, digits, high = (int(count[a:b].sum()) for a, b in ((65, 91), (97, 123), (48, 58), (128, 256)))
    signs, bars, shouts = int(count[_SIGNS].sum()), int(count[124]), int(count[33])
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = Counter(words)
    once = len(kinds) / n
    shares = [signs / size, bars / n, shouts / n, upper / max(1, upper + lower), digits / size, 1 - (upper + lower + high) / size, len(_PLAIN.findall(text)) / n, (int(count[46]) + int(count[63])) / n, int(count[44]) / n, 1 - len(set(lines)) / max(1, len(lines)), len(lines) / n, float((lengths <= 3).mean()), float((lengths >= 12).mean()), once, kinds.most_common(1)[0][1] / n if kinds else 0.0]
    return [*shares, *(math.sqrt(max(0.0, x)) for x in shares), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), high / size]


def _features(batches):
    for batch in (part for whole in batches for part in common.steps(whole)):
        made = [features_of(t) for t in common.texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(made, pa.list_(pa.float64()))], ["key", "label", "features"])


def preference_pairs(train: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(features, label): feature differences of pairs, `pairs` for each row of (key, features, label) with the fewer label; every second turned round.

    train is a bounded sample, so its two classes are numbered in one task.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key", "features")
    placed = train.withColumn("place", F.row_number().over(order) - 1)
    good, bad = placed.where("label = 1"), placed.where("label = 0")
    n_good, n_bad = good.count(), bad.count()
    few, many, size = (bad, good, n_good) if n_bad <= n_good else (good, bad, n_bad)
    sent = few.select("features", F.col("place").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(min(pairs, size) - 1))).alias("turn")).withColumn("place", F.pmod(F.col("own") * pairs + F.col("turn"), F.lit(size)))
    met = sent.join(many.select("place", F.col("features").alias("other")), "place")
    flip = F.pmod(F.col("own") + F.col("turn"), F.lit(2)) == 0
    few_won = 1.0 if n_bad > n_good else 0.0
    return met.select(F.when(flip, F.zip_with("features", "other", lambda a, b: a - b)).otherwise(F.zip_with("other", "features", lambda a, b: a - b)).alias("features"), F.when(flip, F.lit(few_won)).otherwise(F.lit(1.0 - few_won)).alias("label"))


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: strengths are weights on standardised features; without a fit every document has the constant score."""

    mean: tuple = ()
    scale: tuple = ()
    weights: tuple = ()
    threshold: float = 0.0
    constant: float | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        made = np.array([features_of(t) for t in texts])
        strength = np.clip((made - self.mean) / self.scale, -LIMIT, LIMIT) @ np.array(self.weights)
        score = 1 / (1 + np.exp(-np.clip(strength - self.threshold, -500, 500) - math.log(CUT / (1 - CUT))))
        return np.where(strength >= self.threshold, np.maximum(score, CUT), np.minimum(score, np.nextafter(CUT, 0)))


def fitted(docs: DataFrame, labels: DataFrame, column: str = "quality", labelled: int = LABELLED) -> Ranking:
    """The ranking that the labelled documents teach; docs: (doc_id long, text string)."""
    known = common.one_label_each(labels, column).where(common.remainder(F.col("_key"), MODULUS) != HELD_OUT)
    known = common.bounded(known, labelled, F.col("_key"))
    taught = docs.join(F.broadcast(known), docs["doc_id"] == F.col("_key"))  # `labelled` keys at most
    made = taught.select("text", F.col("_key").alias("key"), "label").mapInArrow(_features, "key long, label double, features array<double>")
    train = common.written(made, "train")
    if not trees.both_classes(train):
        return Ranking(constant=0.35 if train.agg(F.max("label")).first()[0] == 0.0 else 0.85)
    size = train.select(F.size("features")).first()[0]
    moments = train.agg(*(f(F.col("features")[k]).alias(f"{n}{k}") for k in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean, scale = [moments[f"m{k}"] for k in range(size)], [moments[f"s{k}"] or 1.0 for k in range(size)]
    lit = lambda x: F.array(*map(F.lit, x))
    scaled = F.zip_with(F.zip_with("features", lit(mean), lambda a, b: a - b), lit(scale), lambda a, b: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), a / b)))
    pairs = preference_pairs(train.withColumn("features", scaled)).withColumn("features", array_to_vector("features"))
    weights = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-3, maxIter=60).fit(pairs).coefficients.toArray().tolist()
    seen = train.select("label", F.aggregate(F.zip_with(scaled, lit(weights), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("strength"))
    levels = seen.agg(F.percentile("strength", lit([k / 100 for k in range(1, 100)]))).first()[0]
    share = lambda k, right: F.avg(F.when(F.col("label") == k, right.cast("double")))
    right = seen.agg(*((share(1, F.col("strength") >= t) + share(0, F.col("strength") < t)).alias(f"r{k}") for k, t in enumerate(levels))).first()
    best = max(range(len(levels)), key=lambda k: (right[f"r{k}"], -k))
    return Ranking(tuple(mean), tuple(scale), tuple(weights), levels[best])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scored(docs: DataFrame, labels: DataFrame, column: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score) for each document."""
    rows = _rows(docs)
    ranking = fitted(rows, labels, column, labelled)

    def run(batches):
        for batch in (part for whole in batches for part in common.steps(whole)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranking.scores(common.texts_of(batch)))], ["doc_id", "score"])

    held = F.coalesce(common.remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score")


def accepted(docs: DataFrame, labels: DataFrame, column: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """The documents whose score reaches CUT, columns as given."""
    ranking = fitted(_rows(docs), labels, column, labelled)

    def run(batches):
        for batch in (part for whole in batches for part in common.steps(whole)):
            yield batch.filter(pa.array(ranking.scores(common.texts_of(batch)) >= CUT))

    return docs.mapInArrow(run, docs.schema)
