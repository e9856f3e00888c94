"""Gradient-boosted trees and their calibration, on bounded training samples."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, DEPTH, STEP = 20, 4, 0.3


def both_classes(rows: DataFrame) -> bool:
    """Whether the column label has a 0 and a 1."""
    low, high = rows.agg(F.min("label"), F.max("label")).first()
    return low == 0.0 and high == 1.0


def fit(rows: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP):
    """Trees fitted on (features array<double>, label); rows in a fixed order, so that fits are repeatable; None where a class is missing."""
    if not both_classes(rows):
        return None
    ordered = rows.select(array_to_vector("features").alias("features"), "label", F.col("features").alias("order")).repartitionByRange(2, "order").sortWithinPartitions("order", "label").drop("order")
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=2, maxBins=64, seed=7).fit(ordered)


def probability(model, rows: DataFrame, prior: float = 0.5) -> DataFrame:
    """The rows with `raw`, the model's probability of label 1; without a model, the prior."""
    if model is None:
        return rows.withColumn("raw", F.lit(float(prior)))
    scored = model.transform(rows.withColumn("_vector", array_to_vector("features")).withColumnRenamed("features", "_features").withColumnRenamed("_vector", "features"))
    return scored.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("_features", "features")


def calibration(rows: DataFrame):
    """An isotonic fit of label on raw; None where a class is missing."""
    if not both_classes(rows):
        return None
    levels = rows.groupBy("raw").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))  # equal scores are one point
    return IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="level").fit(levels)


def calibrated(model, rows: DataFrame) -> DataFrame:
    """The rows with `score` from 0 to 1: the isotonic level, and a thousandth of raw so that ties stay ordered."""
    if model is None:
        return rows.withColumn("score", F.col("raw"))
    return model.transform(rows).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("level") + 0.001 * F.col("raw")))).drop("level")
