"""What grows with the input: rows of a task, and how often the input is read."""

import re

from pyspark.sql import functions as F

from foldmark.operators import rules, scoring
from foldmark.plans import QUERIES, base, checks

SF_DIR = "/root/testdata/sf0.001"


def test_predictions_deal_lines_to_more_tasks_where_there_are_more(spark, monkeypatch):
    lines = base.table(spark, SF_DIR, "lineitem").count()
    monkeypatch.setattr(base, "LINES", 200, raising=False)
    made = base.predictions(spark, SF_DIR)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 3 * lines and len(sizes) >= lines // 200 // 2 and max(sizes) < 3 * 200 * 4
    # units and moments are grouped where the rows were dealt to, without another shuffle
    plan = scoring.balanced_metrics(scoring.scoring_units(made, ["cohort", "method"]), ["cohort", "method"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(.*subject_id", plan)) == 0 and len(re.findall(r"Exchange hashpartitioning\(o_custkey", plan)) == 1


def scans_of(df, name: str) -> int:
    """How often a frame's plan reads a table."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"/{name}.parquet")


def test_manifest_summary_makes_its_segments_once(spark):
    made = QUERIES["manifest_summary"](spark, SF_DIR)
    assert scans_of(made, "lineitem") == scans_of(made, "orders") == 0 and made.count() == 5


def test_constants_are_compared_on_units_made_once(spark):
    made = QUERIES["constant_contrast"](spark, SF_DIR)
    assert scans_of(made, "lineitem") == scans_of(made, "orders") == 0 and made.count() == 10
    # metrics and the two lifts read the lines; nothing of the constants does
    assert scans_of(QUERIES["information_source_table"](spark, SF_DIR), "lineitem") == 2


def test_unit_rules_run_where_the_lines_were_dealt_to(spark):
    found = rules.unit_violations(checks.faulty_units(spark, SF_DIR), ["cohort", "subject_id", "measurement_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # no row is multiplied, and only the two passes' own dealing shuffles by subject
    assert "Expand" not in plan and len(re.findall(r"Exchange hashpartitioning\(.*measurement_id", plan)) == 0


def test_counts_of_segments_differ_only_where_two_are_known(spark):
    rows = [(1, "m1", 4), (1, "m2", 4), (2, "m1", 4), (2, "m2", 5), (3, "m1", None), (3, "m2", 4), (4, "m1", None), (4, "m2", None)]
    units = spark.createDataFrame([(0, s, 0, m, 0, 1.0, 1.0, n) for s, m, n in rows], "cohort int, subject_id int, measurement_id int, method string, fold int, y_true double, y_pred double, n_segments int")
    found = rules.unit_violations(units, ["cohort", "subject_id", "measurement_id"]).collect()
    assert [(r["rule"], r["key"]) for r in found] == [("equal_counts", "0|2|0")]


def test_seeds_are_compared_where_the_units_were_grouped(spark):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        units = scoring.scoring_units(base.predictions(spark, SF_DIR), ["cohort", "method", "seed"])
        found = rules.seed_pairing_violations(units, ["cohort", "subject_id", "measurement_id"])
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    # no unit is dealt out by cohort and method, of which there are few
    assert len(re.findall(r"Exchange hashpartitioning\(cohort", plan)) == 0 and "o_custkey" in plan
    assert found.count() > 0


def test_moments_are_made_once_and_drawn_without_dealing_them_out_by_key(spark):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        for name in ("bootstrap_ci", "seed_bootstrap_ci"):
            made = QUERIES[name](spark, SF_DIR)
            plan = made._jdf.queryExecution().executedPlan().toString()
            # the joins with the keys' levels send no moments through a shuffle
            assert scans_of(made, "lineitem") == 0 and "SortMergeJoin" not in plan and made.count() == 15
        assert scans_of(QUERIES["benchmark_summary"](spark, SF_DIR), "lineitem") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
