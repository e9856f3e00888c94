"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.functions.fingerprints import ordered_fingerprint
from foldmark.operators import sampling
from foldmark.sources import readers, writers
from foldmark.sources.records import Int16Records, header


def test_text_records(spark, tmp_path):
    (tmp_path / "7_1.txt").write_text("1.5\t2\tx\t4\n")
    row = readers.text_records(spark, str(tmp_path)).first()
    assert (row["subject_id"], row["part"], row["samples"]) == ("7", "1", [1.5, 2.0, None, 4.0])


def test_csv_ids_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ID,Quality\n12,1\n1234567,0\n".encode())
    assert sorted(r["ID"] for r in readers.csv_with_ids(spark, str(tmp_path / "a.csv")).collect()) == ["000012", "1234567"]


def test_int16_records(spark, tmp_path):
    (tmp_path / "r1.hea").write_text("r1 2 30 4\nr1.dat 16 100(10)/mV 16 0 0 0 0 ECG\nr1.dat 16 50(0)/NU 16 0 0 0 0 PPG\n")
    np.array([[1, 100], [2, 150], [3, 200], [4, 250]], "<i2").tofile(tmp_path / "r1.dat")
    channels = readers.header_channels(spark, str(tmp_path / "*.hea"), "PPG")
    row = channels.first()
    assert (row["record"], row["rate"], row["n_signals"], row["signal_index"], row["gain"], row["units"]) == ("r1", 30.0, 2, 1, 50.0, "NU")
    files = readers.binary_files(spark, str(tmp_path), "*.dat").withColumn("record", F.regexp_replace("file", r"\.dat$", ""))
    assert readers.int16_channels(files, channels).first()["samples"] == [2.0, 3.0, 4.0, 5.0]
    digest = readers.digests(files).first()["sha1"]
    expected = spark.createDataFrame([("r1.dat", digest.upper()), ("gone", "0")], "file string, digest string")
    assert [r["rule"] for r in readers.digest_violations(files, expected).collect()] == ["file_present"]


def test_array_segments(spark, tmp_path):
    np.savez(tmp_path / "p9.npz", PPG_Record=np.arange(12.0).reshape(4, 3), SegSBP=np.array([120.0, 121, np.nan]), SegDBP=np.array([80.0, 81, 82]), IncludeFlag=np.array([1, 0, np.nan]), Age=np.array([44]))
    rows = readers.array_segments(readers.binary_files(spark, str(tmp_path), "*.npz")).orderBy("idx").collect()
    assert [r["included"] for r in rows] == [True, False, False] and rows[1]["samples"] == [1.0, 4.0, 7.0, 10.0] and rows[0]["subject_id"] == "p9" and rows[0]["age"] == 44.0
    summary = readers.subject_summaries(readers.array_segments(readers.binary_files(spark, str(tmp_path), "*.npz"))).first()
    assert (summary["eligible"], summary["indices"], summary["median_sbp"]) == (1, [0], 120.0)


def test_prediction_files(spark, tmp_path):
    for name, model in (("a", "m"), ("b", "other")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "predictions.csv").write_text("segment_id,model,y_true,y_pred\n1,m,2,3\n")
        (tmp_path / name / "run.json").write_text(json.dumps({"model": model, "decoder_mean": 1.0, "decoder_sd": 2.0}))
    rows, found = readers.prediction_files(spark, str(tmp_path))
    assert rows.count() == 2 and rows.first()["decoder_sd"] == 2.0 and found.count() == 1


def test_selection(spark, tmp_path):
    (tmp_path / "s.csv").write_text('subject_id,selected_segment_indices\na,"[1,2]"\nb,"[0,3]"\n')
    assert readers.stored_selection(spark, str(tmp_path / "s.csv")).count() == 4
    (tmp_path / "t.csv").write_text('subject_id,selected_segment_indices\na,"[1,1]"\na,"[0]"\n')
    with pytest.raises(ValueError, match="violations"):
        readers.stored_selection(spark, str(tmp_path / "t.csv"))
    records = spark.createDataFrame([("x", None), ("y", "2")], "name string, version string")
    assert [r["name"] for r in readers.reusable_selection(records, {"version": 1}, {"version": 1}).collect()] == ["x"]


def test_manifest_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("dataset,source,subject_id,segment_id,waveform_path,sample_rate_hz,n_samples,sbp,dbp,valid_for_analysis\nd,s,1,a,p.npy,125,10,120,80,true\nd,s,1,b,p.npy,125,10,70,80,FALSE\n")
    assert [r["segment_id"] for r in readers.load_manifest(spark, str(tmp_path / "m.csv")).collect()] == ["a"]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s"), ("b", "s")], "segment_id string, subject_id string")
    store, key = str(tmp_path / "store"), writers.representation_key({"name": "e"}, "f")
    assert writers.missing_rows(rows, store, key).count() == 2
    writers.store_representation(rows.limit(1).withColumn("features", F.array(F.lit(1.0), F.lit(2.0))), store, key, 2)
    assert writers.missing_rows(rows, store, key).count() == 1 and writers.load_representation(spark, store, key, 2).count() == 1
    with pytest.raises(ValueError, match="features_present"):
        writers.attach_representation(rows, writers.load_representation(spark, store, key, 2))
    with pytest.raises(ValueError, match="array_length"):
        writers.store_representation(rows.withColumn("features", F.array(F.lit(1.0))), store, key, 2)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c", "m", "t", 0, 1, "a", 1.0, 2.0)], "cohort string, method string, target string, fold int, seed int, segment_id string, y_true double, y_pred double")
    writers.write_predictions(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(ValueError, match="key_unique"):
        writers.write_predictions(rows.unionByName(rows), str(tmp_path / "q"))
    writers.write_tables({"x": rows}, str(tmp_path / "t"), "csv")
    writers.write_metadata(spark, str(tmp_path / "meta"), rows.select("fold", "target"), version=3)
    assert json.loads(spark.read.json(str(tmp_path / "meta")).first()["facts"]) == {"version": 3}
    assert writers.hash_manifest({"x": rows, "y": rows}).select("fingerprint").distinct().count() == 1


def test_int16_records_in_ranges(spark, tmp_path):
    """Two channels over many byte ranges, none of which ends with a frame; a filter on the channel; a file that is no whole number of frames."""
    x = np.arange(6000, dtype="<i2").reshape(-1, 3)
    (tmp_path / "r1.dat").write_bytes(x.tobytes())
    (tmp_path / "r1.hea").write_text("# about\nr1 3 125 2000\nr1.dat 16 2(10)/mV 16 0 0 0 0 ppg\nr1.dat 16 4/mV 16 0 0 0 0 ecg\r\nr1.dat 16 1 16 0 0 0 0 resp\n")
    (tmp_path / "alone.dat").write_bytes(b"zz")
    spark.dataSource.register(Int16Records)
    rows = spark.read.format("int16_records").option("splitBytes", 1000).option("samples", 64).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 12
    found = {}
    for r in rows.orderBy("channel", "start").collect():
        assert r["record"] == "r1" and r["start"] == len(found.setdefault(r["channel"], [])) and len(r["samples"]) <= 64
        found[r["channel"]] += r["samples"]
    assert found == {"ppg": ((x[:, 0] - 10.0) / 2).tolist(), "ecg": (x[:, 1] / 4.0).tolist(), "resp": x[:, 2].astype(float).tolist()}
    assert rows.where("channel = 'ecg'").select("channel").distinct().collect() == [("ecg",)]
    assert spark.read.format("int16_records").option("channel", "none").load(str(tmp_path)).count() == 0
    (tmp_path / "r1.dat").write_bytes(x.tobytes() + b"\0\0")
    with pytest.raises(Exception, match="don't divide"):
        rows.count()
    with pytest.raises(ValueError, match="16-bit"):
        header("r 1 125\nr.dat 212 1 16 0 0 0 0 ppg\n")


def test_subject_sheet_renames_and_coerces(spark):
    rows = spark.createDataFrame([(" 7 ", "61", "x"), ("8", "old", None)], "`Subject ID` string, `Age [years]` string, other string")
    made = readers.subject_sheet(rows, {"Subject ID": "subject_id", "Age [years]": "age"}, ("age",))
    assert made.columns == ["subject_id", "age"] and [tuple(r) for r in made.collect()] == [("7", 61.0), ("8", None)]


def test_selected_segments_keep_where_they_came_from(spark, tmp_path):
    rows = spark.createDataFrame([("s", k, f"f{k}", [float(k), 0.1]) for k in range(4)], "subject_id string, idx int, file string, samples array<double>")
    writers.write_selected(rows, spark.createDataFrame([("s", 1), ("s", 3), ("t", 0)], "subject_id string, idx int"), str(tmp_path / "out"))
    made = spark.read.parquet(str(tmp_path / "out"))
    assert dict(made.dtypes)["samples"] == "array<float>" and sorted((r["source_index"], r["source_file"], r["samples"][0]) for r in made.collect()) == [(1, "f1", 1.0), (3, "f3", 3.0)]


def test_splits_are_written_once_and_checked_when_read(spark, tmp_path):
    who = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)], "subject_id int, g string")
    splits, path = sampling.split_manifest(who, "g", "g", 4, 3, fingerprint="f1"), str(tmp_path / "splits")
    writers.write_splits(splits, who, 4, path)
    assert sorted(map(tuple, writers.read_splits(spark, path, who, 4, "f1").collect())) == sorted(map(tuple, splits.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_splits(splits, who, 4, path)
    with pytest.raises(ValueError):
        writers.read_splits(spark, path, who, 4, "another")
    with pytest.raises(ValueError):
        writers.read_splits(spark, path, who.unionByName(spark.createDataFrame([(99, "a")], "subject_id int, g string")), 4)


def test_identities_follow_content(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.5])], "segment_id string, features array<double>")
    one = writers.representation_identity(rows)
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    first, swapped = (ordered_fingerprint(x, ["place"], F.col("segment_id")).first()[0] for x in (placed, placed.withColumn("place", -F.col("place"))))
    assert first == ordered_fingerprint(placed.repartition(3), ["place"], F.col("segment_id")).first()[0] != swapped
    assert one == writers.representation_identity(rows.orderBy(F.desc("segment_id")).repartition(3)) != writers.representation_identity(rows.where("segment_id = 'a'"))
