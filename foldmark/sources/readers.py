"""Scans: manifests, text and binary records, arrays in files, prediction files with their run metadata."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import padded_id
from ..operators import manifest, rules

# Names that array files use for the same field.
ALIASES = {"record": ("PPG_Record", "PPG_record", "PPG"), "sbp": ("SegSBP", "SBP"), "dbp": ("SegDBP", "DBP"), "include": ("IncludeFlag", "Include"), "subject": ("SubjectID", "Subject"), "age": ("Age",), "sex": ("Gender", "Sex"), "height": ("Height",), "weight": ("Weight",), "bmi": ("BMI",)}


def load_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A CSV or Parquet manifest, canonical, its valid rows only; raises on violations if strict."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    rows = manifest.valid_rows(manifest.canonical_manifest(raw))
    if strict:
        rules.strict(rules.together(rules.missing_columns(raw, ["dataset", "source", "subject_id", "segment_id", "waveform_path", "sample_rate_hz", "n_samples", "sbp", "dbp"]), rules.manifest_violations(rows)))
    return rows


def text_records(spark: SparkSession, path: str, name_pattern: str = r"^(\d+)_(\d+)\.txt$") -> DataFrame:
    """(file, subject_id, part, samples): one white-space separated record a file, ids from its name; a bad token is a null sample."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    tokens = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return rows.select("file", F.regexp_extract("file", name_pattern, 1).alias("subject_id"), F.regexp_extract("file", name_pattern, 2).alias("part"), F.transform(tokens, lambda t: t.try_cast("double")).alias("samples"))


def subject_sheet(rows: DataFrame, names: dict[str, str], numbers: tuple[str, ...]) -> DataFrame:
    """Selected columns of a subject table under new names, numbers coerced."""
    return rows.select(*((F.col(f"`{old}`").cast("string").try_cast("double") if new in numbers else F.trim(F.col(f"`{old}`").cast("string"))).alias(new) for old, new in names.items()))


def csv_with_ids(spark: SparkSession, path: str, key: str = "ID", width: int = 6) -> DataFrame:
    """A CSV with a header that may begin with a byte-order mark; ids padded with zeros."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip().strip('"') for c in rows.columns))
    return rows.withColumn(key, padded_id(F.trim(key), width))


def header_channels(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """(file, record, n_signals, rate, n_samples, signal_index, gain, baseline, units, name) of the named channel, from header texts."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")).alias("lines"))
    head = F.split(F.trim(F.get("lines", F.lit(0))), r"\s+")
    at = lambda k, t: F.get(head, F.lit(k)).try_cast(t)
    signals = rows.select("file", F.get(head, F.lit(0)).alias("record"), at(1, "int").alias("n_signals"), F.regexp_extract(F.coalesce(F.get(head, F.lit(2)), F.lit("")), r"^([0-9.]+)", 1).try_cast("double").alias("rate"), at(3, "int").alias("n_samples"), F.posexplode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("signal_index", "line"))
    gain = r"^\S+\s+\d+\S*\s+([0-9.eE+-]+)(?:\((-?\d+)\))?(?:/(\S+))?"
    out = signals.withColumn("gain", F.regexp_extract("line", gain, 1).try_cast("double")).withColumn("baseline", F.coalesce(F.regexp_extract("line", gain, 2).try_cast("double"), F.lit(0.0))).withColumn("units", F.regexp_extract("line", gain, 3)).withColumn("name", F.regexp_extract("line", r"(\S+)\s*$", 1))
    return out.where(F.col("name") == channel).drop("line")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, path, length, content) of files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select(F.substring_index("path", "/", -1).alias("file"), "path", "length", "content")


def int16_channels(files: DataFrame, channels: DataFrame) -> DataFrame:
    """(record, samples): interleaved little-endian int16 contents decoded to (x - baseline) / gain; files: (record, content)."""
    joined = files.join(channels.select("record", "n_signals", "signal_index", "gain", "baseline"), "record")

    def run(batches):
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                x = np.frombuffer(r.content, "<i2")
                if len(x) % r.n_signals:
                    raise ValueError(f"{r.record}: {len(x)} samples don't divide among {r.n_signals} signals")
                made.append((x.reshape(-1, r.n_signals)[:, r.signal_index].astype(float) - r.baseline) / r.gain)
            yield pd.DataFrame({"record": pdf["record"], "samples": made})

    return joined.mapInPandas(run, "record string, samples array<double>")


def _field(data, name: str):
    return next((np.asarray(data[a]) for a in ALIASES[name] if a in data), None)


def array_segments(files: DataFrame, rate: int = 125) -> DataFrame:
    """One row for each segment of array files (NPZ): (file, subject_id, idx, sbp, dbp, included, age, sex, height_cm, weight_kg, bmi, rate, samples).

    The segment axis is that whose length is the labels'; without an include flag all are included, a flag that is not above 0 excludes.
    """
    schema = "file string, subject_id string, idx int, sbp double, dbp double, included boolean, age double, sex string, height_cm double, weight_kg double, bmi double, rate int, samples array<double>"

    def number(data, name):
        x = _field(data, name)
        return float(x.ravel()[0]) if x is not None and x.size else None

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                with np.load(io.BytesIO(r.content), allow_pickle=False) as data:
                    x, s, d = _field(data, "record"), _field(data, "sbp").ravel(), _field(data, "dbp").ravel()
                    if len(s) != len(d):
                        raise ValueError(f"{r.file}: label lengths {len(s)} and {len(d)} differ")
                    axes = [k for k, n in enumerate(x.shape) if n == len(s)]
                    if x.ndim != 2 or not axes:
                        raise ValueError(f"{r.file}: no axis of {x.shape} has {len(s)} segments")
                    x = np.moveaxis(x, axes[0], 0).astype(float)
                    flag = _field(data, "include")
                    keep = np.ones(len(s), bool) if flag is None else np.nan_to_num(flag.ravel().astype(float)) > 0
                    who, sex = _field(data, "subject"), _field(data, "sex")
                    subject = r.file.rsplit(".", 1)[0] if who is None else str(who.ravel()[0]).removesuffix(".0")
                    n = len(s)
                    yield pd.DataFrame({"file": r.file, "subject_id": subject, "idx": np.arange(n, dtype=np.int32), "sbp": s.astype(float), "dbp": d.astype(float), "included": keep, "age": [number(data, "age")] * n, "sex": [None if sex is None else str(sex.ravel()[0])] * n, "height_cm": [number(data, "height")] * n, "weight_kg": [number(data, "weight")] * n, "bmi": [number(data, "bmi")] * n, "rate": rate, "samples": list(x)})

    return files.select("file", "content").mapInPandas(run, schema)


def subject_summaries(segments: DataFrame, least: int = 1) -> DataFrame:
    """(subject_id, median_sbp, median_dbp, eligible, indices) of included segments with finite labels; subjects with at least `least`."""
    good = segments.where(F.col("included") & rules.finite("sbp") & rules.finite("dbp"))
    out = good.groupBy("subject_id").agg(F.percentile("sbp", F.lit(0.5)).alias("median_sbp"), F.percentile("dbp", F.lit(0.5)).alias("median_dbp"), F.count("*").alias("eligible"), F.array_sort(F.collect_list("idx")).alias("indices"))
    return out.where(F.col("eligible") >= least)


def prediction_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, violations): CSVs */predictions.csv with the decoder parameters of run.json beside each, and where the two disagree about the model."""
    strip = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    rows = spark.read.option("header", True).csv(f"{folder}/*/predictions.csv").select("*", F.col("_metadata.file_path").alias("prediction_artifact"))
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in ("y_true", "y_pred", "estimator_output") if c in rows.columns}).withColumn("_dir", strip("prediction_artifact"))
    runs = spark.read.json(f"{folder}/*/run.json", multiLine=True).select(F.col("model").alias("_model"), "decoder_mean", "decoder_sd", F.col("_metadata.file_path").alias("_p")).withColumn("_dir", strip("_p")).drop("_p")
    both = rows.join(runs, "_dir", "left")
    odd = both.select("prediction_artifact", "model", "_model").distinct()
    found = rules.broken(odd, "model_agrees", ~F.col("model").eqNullSafe(F.col("_model")), F.col("prediction_artifact"), F.col("_model"))
    return both.drop("_dir", "_model"), found


def digests(files: DataFrame) -> DataFrame:
    """(file, md5, sha1, sha256) of files' contents."""
    return files.select("file", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def digest_violations(files: DataFrame, expected: DataFrame, algorithm: str = "sha1") -> DataFrame:
    """Expected (file, digest) that are missing or differ."""
    both = expected.join(digests(files).select("file", F.col(algorithm).alias("_have")), "file", "left")
    return rules.together(rules.broken(both, "file_present", F.col("_have").isNull(), F.col("file")), rules.broken(both, "digest_equal", F.col("_have") != F.lower("digest"), F.col("file"), F.col("_have")))


def stored_selection(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(subject_id, idx): a stored selection's segments; raises where subjects repeat, lists differ in size or hold an index twice, or subjects are unknown."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path).withColumn("chosen", F.from_json("selected_segment_indices", "array<int>"))
    size = rows.agg(F.max(F.size("chosen"))).first()[0]
    found = [rules.repeated(rows, "subject_unique", ["subject_id"]), rules.broken(rows, "equal_sizes", ~F.size("chosen").eqNullSafe(F.lit(size)), F.col("subject_id")), rules.broken(rows, "indices_unique", F.size(F.array_distinct("chosen")) < F.size("chosen"), F.col("subject_id"))]
    if known is not None:
        found.append(rules.broken(rows.join(known, "subject_id", "left_anti"), "subject_known", F.lit(True), F.col("subject_id")))
    rules.strict(rules.together(*found))
    return rows.select("subject_id", F.explode("chosen").alias("idx"))


def reusable_selection(records: DataFrame, wanted: dict, defaults: dict) -> DataFrame:
    """Selection records whose identity fields, absent ones at their defaults, equal the wanted ones."""
    out = records
    for field, value in wanted.items():
        have = F.col(field).cast("string") if field in records.columns else F.lit(None).cast("string")
        out = out.where(F.coalesce(have, F.lit(str(defaults[field])) if field in defaults else F.lit(None)).eqNullSafe(F.lit(str(value))))
    return out
