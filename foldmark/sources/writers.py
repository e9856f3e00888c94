"""Sinks: partitioned predictions, table sets, locked splits, the content-addressed representation store, run metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprints import fingerprint, settings_digest
from ..operators import rules


def write_predictions(rows: DataFrame, path: str, keys: tuple[str, ...] = ("cohort", "method", "target", "fold", "seed")) -> None:
    """Row-level predictions, a folder for each of the keys; the rows of a folder are brought together first, so files stay few."""
    rules.strict(rules.output_violations(rows, [*keys, "segment_id"], ["y_true", "y_pred"]))
    rows.repartition(*keys).write.partitionBy(*keys).parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """A set of result tables, one folder each; "csv" writes headers."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(form).save(f"{folder}/{name}")


def write_splits(splits: DataFrame, subjects: DataFrame, folds: int, path: str) -> None:
    """Locked splits: never overwritten."""
    rules.strict(rules.split_violations(splits, subjects, folds))
    splits.write.mode("errorifexists").parquet(path)


def read_splits(spark: SparkSession, path: str, subjects: DataFrame, folds: int, dataset_fingerprint: str | None = None) -> DataFrame:
    splits = spark.read.parquet(path)
    rules.strict(rules.split_violations(splits, subjects, folds, dataset_fingerprint))
    return splits


def write_selected(segments: DataFrame, selection: DataFrame, path: str) -> None:
    """Only the selected segments' samples, as floats; where they came from stays in source_* columns."""
    few = segments.join(selection, ["subject_id", "idx"], "left_semi")
    few.withColumn("samples", F.col("samples").cast("array<float>")).withColumnsRenamed({"file": "source_file", "idx": "source_index"}).write.parquet(path)


def representation_key(encoder: dict, input_fingerprint: str) -> str:
    """The address of a representation: its encoder's settings and its input's identity."""
    return settings_digest(encoder=settings_digest(**encoder), inputs=input_fingerprint)


def missing_rows(rows: DataFrame, store: str, key: str) -> DataFrame:
    """Rows whose representation the store lacks under the key."""
    spark = rows.sparkSession
    try:
        have = spark.read.parquet(store).where(F.col("cache_key") == key).select("segment_id")
    except Exception as e:  # a store that no one has written to yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows
    return rows.join(have, "segment_id", "left_anti")


def store_representation(features: DataFrame, store: str, key: str, size: int) -> None:
    """Adds those (segment_id, subject_id, features) that the store lacks under the key, checked for length, finiteness and repeated ids."""
    rules.strict(rules.array_violations(features, "segment_id", "features", size))
    new = missing_rows(features, store, key)
    new.withColumn("features", F.col("features").cast("array<float>")).withColumn("cache_key", F.lit(key)).write.mode("append").partitionBy("cache_key").parquet(store)


def load_representation(spark: SparkSession, store: str, key: str, size: int, identity: str | None = None) -> DataFrame:
    """A key's rows, checked for length, finiteness and repeated ids, and, where an identity is given (see representation_identity), for what they are."""
    rows = spark.read.parquet(store).where(F.col("cache_key") == key)
    rules.strict(rules.array_violations(rows, "segment_id", "features", size))
    if identity is not None and representation_identity(rows) != identity:
        raise ValueError(f"representation {key} is not the one that was stored")
    return rows


def representation_identity(rows: DataFrame) -> str:
    """The digest of ids and features as floats, whatever the order of the rows."""
    return fingerprint(rows, F.col("segment_id"), F.array_join(F.transform(F.col("features").cast("array<float>"), lambda x: x.cast("string")), ",")).first()[0]


def attach_representation(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Rows with their features; raises where one has none."""
    both = rows.join(features.select("segment_id", "features"), "segment_id", "left")
    rules.strict(rules.broken(both, "features_present", F.col("features").isNull(), F.col("segment_id")))
    return both


def write_metadata(spark: SparkSession, path: str, chosen: DataFrame | None = None, **facts) -> None:
    """One JSON row of facts about a run; chosen: rows of selected settings, listed once each in order (a row for each fold and target)."""
    row = spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "facts string").withColumn("written_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    if chosen is not None:
        row = row.crossJoin(F.broadcast(chosen.distinct().agg(F.sort_array(F.collect_list(F.struct(*chosen.columns))).alias("chosen"))))  # one row
    row.coalesce(1).write.mode("overwrite").json(path)


def hash_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, fingerprint): the identity of each table, whatever the order of its rows."""
    out = None
    for name, df in sorted(tables.items()):
        one = fingerprint(df, *(F.col(c) for c in sorted(df.columns))).select(F.lit(name).alias("name"), "fingerprint")
        out = one if out is None else out.unionByName(one)
    return out
