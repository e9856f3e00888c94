"""Queries of the validation rules, on predictions with faults put in by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules, scoring, sessions
from .base import ORACLE_SQL, PRED, predictions, query, sql_units, table
from .cohort import _ordered_events


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"))


_FAULTY = f"""{PRED}, {sql_units('cohort, fold, method', 'u')}, fu AS (SELECT cohort, CASE WHEN subject_id % 101 = 0 AND measurement_id % 2 = 0 THEN (fold + 1) % 5 ELSE fold END AS fold, method, subject_id, measurement_id,
 CASE WHEN method = 'signal' AND measurement_id % 211 = 0 THEN y_true + 1 ELSE y_true END AS y_true,
 CASE WHEN measurement_id % 307 = 0 THEN NULL ELSE y_pred END AS y_pred, CASE WHEN measurement_id % 401 = 0 THEN 0 ELSE n_segments END AS n_segments
 FROM u WHERE NOT (method = 'covariates' AND measurement_id % 113 = 0))"""


def faulty_units(spark, d) -> DataFrame:
    u = scoring.scoring_units(predictions(spark, d), ["cohort", "fold", "method"]).where(~((F.col("method") == "covariates") & (F.col("measurement_id") % 113 == 0)))
    m = F.col("measurement_id")
    return u.withColumns({
        "fold": F.when((F.col("subject_id") % 101 == 0) & (m % 2 == 0), (F.col("fold") + 1) % 5).otherwise(F.col("fold")),
        "y_true": F.when((F.col("method") == "signal") & (m % 211 == 0), F.col("y_true") + 1).otherwise(F.col("y_true")),
        "y_pred": F.when(m % 307 != 0, F.col("y_pred")),
        "n_segments": F.when(m % 401 == 0, 0).otherwise(F.col("n_segments")),
    })


@query(f"""WITH {_FAULTY}, per AS (SELECT cohort, subject_id, measurement_id, max(y_true) - min(y_true) AS range,
 count(DISTINCT n_segments) AS counts,
 count(*) FILTER (y_pred IS NULL) AS odd, count(*) FILTER (n_segments <= 0) AS empty FROM fu
 GROUP BY ALL)
SELECT rule, count(*) AS n FROM (SELECT 'finite' AS rule FROM per WHERE odd > 0 UNION ALL SELECT 'one_truth'
 FROM per WHERE range > 1e-10 UNION ALL SELECT 'equal_counts' FROM per WHERE counts > 1
UNION ALL SELECT 'counts_positive' FROM per WHERE empty > 0 UNION ALL SELECT 'one_fold' FROM fu
 GROUP BY cohort, subject_id HAVING count(DISTINCT fold) > 1) GROUP BY rule""")
def unit_violations(spark, d):
    return _counted(rules.unit_violations(faulty_units(spark, d), ["cohort", "subject_id", "measurement_id"]))


@query(f"""WITH {_FAULTY}, b AS (SELECT * FROM fu WHERE method = 'signal_plus'), o AS (SELECT *
 FROM fu WHERE method <> 'signal_plus') SELECT rule, count(*) AS n FROM (
SELECT 'combination_present' AS rule FROM (SELECT r_regionkey AS cohort, method FROM region
 CROSS JOIN (VALUES ('signal'), ('covariates'), ('signal_plus'), ('absent')) e(method) EXCEPT SELECT cohort, method
 FROM fu)
UNION ALL SELECT 'same_rows' FROM b CROSS JOIN (VALUES ('signal'), ('covariates')) m(method)
 LEFT JOIN o ON o.method = m.method AND o.cohort = b.cohort AND o.subject_id = b.subject_id AND o.measurement_id = b.measurement_id
 WHERE o.method IS NULL
UNION ALL SELECT 'same_truth' FROM b JOIN o USING (cohort, subject_id, measurement_id) WHERE abs(b.y_true - o.y_true) > 1e-10)
 GROUP BY rule""")
def matrix_completeness(spark, d):
    cohorts = table(spark, d, "region").select(F.col("r_regionkey").alias("cohort"))
    expected = cohorts.withColumn("method", F.explode(F.array(*map(F.lit, ("signal", "covariates", "signal_plus", "absent")))))
    return _counted(rules.matrix_violations(faulty_units(spark, d), expected, ["cohort", "subject_id", "measurement_id"], "signal_plus"))


@query(f"""WITH {PRED}, {sql_units('cohort, method, seed', 'u')}, s AS (SELECT cohort, method,
 count(DISTINCT seed) AS seeds FROM u GROUP BY ALL), p AS (SELECT cohort, method, subject_id, measurement_id,
 count(DISTINCT seed) AS have, max(y_true) - min(y_true) AS range FROM u GROUP BY ALL)
SELECT rule, count(*) AS n FROM (SELECT 'seed_missing' AS rule FROM p JOIN s USING (cohort, method)
 WHERE have < seeds UNION ALL SELECT 'seed_truth' FROM p WHERE range > 1e-10) GROUP BY rule""")
def seed_pairing_violations(spark, d):
    units = scoring.scoring_units(predictions(spark, d), ["cohort", "method", "seed"])
    return _counted(rules.seed_pairing_violations(units, ["cohort", "subject_id", "measurement_id"]))


_DECODED = """de AS (SELECT l_orderkey || '-' || l_linenumber AS segment_id, CASE WHEN l_orderkey % 97 = 0 THEN 'other' ELSE 'base' END AS condition,
 CASE WHEN l_linenumber % 2 = 0 THEN 'identity' ELSE 'z_score' END AS output_scale,
 CASE WHEN l_linenumber % 2 = 0 AND l_orderkey % 89 <> 0 THEN 0.0 ELSE 100.0 END AS decoder_mean,
 CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 50.0 END AS decoder_sd, l_quantity AS estimator_output, l_extendedprice AS y_true
 FROM lineitem),
 dp AS (SELECT *, estimator_output * decoder_sd + decoder_mean + CASE WHEN hash_ THEN 5 ELSE 0 END AS y_pred
 FROM (SELECT *, CAST(split_part(segment_id, '-', 1) AS BIGINT) % 83 = 0 AS hash_ FROM de))"""


@query(f"""WITH {_DECODED} SELECT rule, count(*) AS n FROM (SELECT 'condition_known' AS rule FROM dp
 WHERE condition = 'other' UNION ALL SELECT 'identity_decoder' FROM dp WHERE output_scale = 'identity' AND (decoder_mean <> 0 OR decoder_sd <> 1)
 UNION ALL SELECT 'reproduced' FROM dp WHERE abs(estimator_output * decoder_sd + decoder_mean - y_pred) > 1e-3 + 1e-6 * abs(y_pred))
 GROUP BY rule""")
def prediction_violations(spark, d):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("segment_id"), F.when(o % 97 == 0, "other").otherwise("base").alias("condition"), F.when(n % 2 == 0, "identity").otherwise("z_score").alias("output_scale"),
        F.when((n % 2 == 0) & (o % 89 != 0), 0.0).otherwise(100.0).alias("decoder_mean"), F.when(n % 2 == 0, 1.0).otherwise(50.0).alias("decoder_sd"), F.col("l_quantity").alias("estimator_output"), F.col("l_extendedprice").alias("y_true"), (o % 83 == 0).alias("off"),
    ).withColumn("y_pred", F.col("estimator_output") * F.col("decoder_sd") + F.col("decoder_mean") + F.when(F.col("off"), 5).otherwise(0))
    return _counted(rules.prediction_violations(rows, ["base"]))


@query("""SELECT rule, count(*) AS n FROM (SELECT 'key_unique' AS rule FROM lineitem GROUP BY l_orderkey, l_linenumber
 HAVING count(*) > 1 UNION ALL SELECT 'finite_ratio' FROM lineitem WHERE l_discount = 0) GROUP BY rule""")
def output_violations(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") / F.nullif(F.col("l_discount"), F.lit(0.0))).alias("ratio"))
    return _counted(rules.output_violations(rows, ["l_orderkey", "l_linenumber"], ["ratio"]))


@query("SELECT 'array_length' AS rule, count(*) AS n FROM embeddings WHERE label = 3 HAVING count(*) > 0")
def array_violations(spark, d):
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") == 3, F.slice(v, 1, 10)).otherwise(v).alias("v"))
    return _counted(rules.array_violations(rows, "vec_id", "v", 64))


@query(f"""WITH ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
 FROM events), t AS (SELECT min(event_type) AS t FROM events), mk AS (SELECT *, event_type = (SELECT t
 FROM t) AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY n) <> (SELECT t FROM t), true) AS onset
 FROM ev),
s AS ({ORACLE_SQL['session_derivation']}), j AS (SELECT mk.onset, s.* FROM mk JOIN s USING (event_id))
 SELECT rule, count(*) AS n FROM (SELECT 'onset_place' AS rule FROM j WHERE onset AND session_position <> 3
 UNION ALL SELECT 'position_in_session' FROM j WHERE session_position NOT BETWEEN 1 AND 7) GROUP BY rule""")
def session_violations(spark, d):
    rows = _ordered_events(spark, d)
    marked = sessions.onsets(rows, ["user_id"], "n", F.col("event_type") == rows.agg(F.min("event_type")).first()[0])
    made = sessions.derived_sessions(marked, ["user_id"], "n", 7, 3).withColumnsRenamed({"user_id": "subject_id", "event_id": "record_id"})
    return _counted(rules.session_violations(made, 7, 3))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4")
def expected_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n <> 4")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(count(*)) OVER () AS smallest FROM orders GROUP BY ALL")
def stratum_counts(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.min("n").alias("smallest"))))  # one row


@query("""SELECT l_orderkey, round(max(l_extendedprice) - min(l_extendedprice), 4) AS range FROM lineitem
 GROUP BY l_orderkey HAVING max(l_extendedprice) - min(l_extendedprice) > 10000""")
def range_checks(spark, d):
    spread = F.max("l_extendedprice") - F.min("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(spread.alias("range")).where("range > 10000").withColumn("range", F.round("range", 4))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_valid, count(DISTINCT o_custkey) AS n_subjects,
 count(DISTINCT o_custkey || '-' || o_orderpriority) AS n_sessions FROM orders""")
def selection_counters(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_orderstatus") == "F").alias("n_valid"), F.countDistinct("o_custkey").alias("n_subjects"), F.countDistinct("o_custkey", "o_orderpriority").alias("n_sessions"))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS s, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS part FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT 'subjects_apart' AS rule, count(*) AS n FROM (SELECT s FROM p GROUP BY s HAVING count(*) > 1) HAVING count(*) > 0""")
def subjects_apart(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "subject_id")
    return _counted(rules.subjects_apart(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'")))


@query("""WITH r AS (SELECT o_orderpriority AS k, o_orderkey % 7 AS fold FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderkey % 7 = 3)),
g AS (SELECT k, count(DISTINCT fold) AS n, count(*) FILTER (fold >= 5) AS odd FROM r GROUP BY k)
SELECT rule, count(*) AS n FROM (SELECT 'folds_whole' AS rule FROM g WHERE odd > 0 UNION ALL SELECT 'folds_complete' FROM g WHERE n <> 5) GROUP BY rule""")
def whole_folds(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_orderkey") % 7).alias("fold")).where("not (k = '5-LOW' and fold = 3)")
    return _counted(rules.whole_folds(rows, ["k"], 5))


@query(f"""WITH {PRED}, h AS (SELECT DISTINCT cohort, method, seed FROM pred WHERE NOT (cohort = 2 AND method = 'signal' AND seed = 1)),
 w AS (SELECT cohort, method, string_agg(seed, ',' ORDER BY seed) AS have FROM h GROUP BY ALL)
SELECT 'seeds_expected' AS rule, count(*) AS n FROM w WHERE have <> CASE method WHEN 'covariates' THEN '0' ELSE '0,1,2' END
 HAVING count(*) > 0""")
def seeds_per_method(spark, d):
    rows = predictions(spark, d).where("not (cohort = 2 and method = 'signal' and seed = 1)").withColumn("seed", F.col("seed").cast("int"))
    expected = spark.createDataFrame([("signal", [0, 1, 2]), ("signal_plus", [2, 1, 0]), ("covariates", [0])], "method string, seeds array<int>")
    return _counted(rules.seeds_per_method(rows, expected, ["cohort"]))
