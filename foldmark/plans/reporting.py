"""Queries for descriptive reports, feature transforms and record arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import contrasts, manifest, reports, ridge, scans, scoring, transforms, waveform
from .base import PRED, SUBJECTS, predictions, query, sql_metrics, sql_moments, sql_units, subjects, table
from .evaluation import _ORDER_UNITS, _order_units, complementarity, constant_contrast, paired_bootstrap_ci
from .base import ORACLE_SQL as _ORACLE


def _round(df: DataFrame, names, digits: int = 4) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})


_SUBJECT_MEANS = f"""{_ORDER_UNITS}, sm AS (SELECT cohort, subject_id, avg(y_true) AS y FROM ou
 GROUP BY ALL), sj AS (SELECT sm.*, s.acctbal, s.segment FROM sm JOIN subjects s USING (cohort, subject_id))"""


def _subject_means(spark, d) -> DataFrame:
    return _order_units(spark, d).groupBy("cohort", "subject_id").agg(F.avg("y_true").alias("y")).join(subjects(spark, d), ["cohort", "subject_id"])


_SPEARMAN = f"""{_SUBJECT_MEANS}, rk AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY acctbal) + (count(*) OVER (PARTITION BY cohort, acctbal) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY cohort ORDER BY round(y, 6)) + (count(*) OVER (PARTITION BY cohort,
 round(y, 6)) - 1) / 2.0 AS ry FROM sj WHERE acctbal IS NOT NULL), sp AS (SELECT cohort, count(*) AS n,
 CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho FROM rk GROUP BY cohort)"""


@query(f"WITH {_SPEARMAN} SELECT cohort, n, round(rho, 6) + 0.0 AS rho FROM sp")
def spearman_association(spark, d):
    return _round(reports.spearman(_subject_means(spark, d).withColumn("y", F.round("y", 6)), ["cohort"], "acctbal", "y"), ["rho"], 6)


@query(f"""WITH {_SPEARMAN}, df AS (SELECT cohort, avg(y) FILTER (segment = 'BUILDING') - avg(y) FILTER (segment = 'MACHINERY') AS difference,
 count(*) FILTER (segment = 'BUILDING') AS n_first, count(*) FILTER (segment = 'MACHINERY') AS n_second
 FROM sj GROUP BY cohort) SELECT cohort, n, round(rho, 6) + 0.0 AS rho, round(difference, 4) + 0.0 AS difference, n_first, n_second
 FROM sp JOIN df USING (cohort)""")
def association_report(spark, d):
    rows = _subject_means(spark, d)
    made = reports.group_difference(rows, ["cohort"], "y", "segment", "BUILDING", "MACHINERY")
    return _round(_round(spearman_association(spark, d).join(made, "cohort"), ["difference"]), ["rho"], 6)


@query()
def association_p_values(spark, d):
    return _round(reports.with_p_values(spearman_association(spark, d)), ["p"], 8)


@query(f"""WITH {SUBJECTS} SELECT cohort, count(acctbal) AS n, round(avg(acctbal), 4) + 0.0 AS mean, min(acctbal) AS least,
 round(quantile_cont(acctbal, 0.5), 4) + 0.0 AS median, max(acctbal) AS greatest, count(DISTINCT segment) AS n_categories,
 count(*) FILTER (acctbal IS NULL) AS n_missing FROM subjects GROUP BY cohort""")
def distribution_report(spark, d):
    return _round(reports.distribution(subjects(spark, d), ["cohort"], "acctbal", "segment"), ["mean", "median"])


@query(f"""WITH {SUBJECTS}, r AS (SELECT s.*, o.o_orderkey AS measurement_id, o.o_totalprice AS price
 FROM orders o JOIN subjects s ON o.o_custkey = s.subject_id)
SELECT cohort, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT measurement_id) AS n_measurements, {', '.join(f'round(avg({c}), 4) + 0.0 AS {c}_mean, round(stddev_pop({c}), 4) AS {c}_sd, min({c}) AS {c}_min, max({c}) AS {c}_max, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}_missing' for c in ('price', 'acctbal'))},
 count(DISTINCT segment) AS n_segment FROM r GROUP BY cohort""")
def cohort_summary(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("measurement_id"), F.col("o_totalprice").alias("price"))
    rows = orders.join(subjects(spark, d), F.col("o_custkey") == F.col("subject_id"))
    return _round(reports.cohort_summary(rows, ["cohort"], ["price", "acctbal"], ["segment"]), ["price_mean", "price_sd", "acctbal_mean", "acctbal_sd"])


_SEGMENTS = """sg AS (SELECT n.n_regionkey AS cohort, o.o_custkey AS subject_id, o.o_orderkey AS measurement_id, l.l_orderkey * 10 + l.l_linenumber AS segment_id,
 CAST(CASE WHEN l.l_linenumber % 2 = 0 THEN 125 ELSE 50 END AS DOUBLE) AS sample_rate_hz, CAST(l.l_quantity * 100 AS DOUBLE) AS n_samples, CAST(100 + l.l_quantity AS DOUBLE) AS sbp, CAST(50 + l.l_linenumber AS DOUBLE) AS dbp,
 CASE WHEN o.o_custkey % 6 <> 0 THEN CAST(20 + o.o_custkey % 60 AS DOUBLE) END AS age, CASE o.o_custkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'Male' WHEN 2 THEN 'unknown' END AS sex,
 CASE WHEN o.o_custkey % 5 <> 0 THEN CAST(20 + l.l_linenumber AS DOUBLE) END AS bmi
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
 JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def _segments(spark, d) -> DataFrame:
    """Lines as segments of an annotated manifest."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"))
    rows = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(subjects(spark, d).select("cohort", "subject_id"), "subject_id")
    who, line, size = F.col("subject_id"), F.col("l_linenumber"), F.col("l_quantity")
    sex = F.when(who % 4 == 0, "female").when(who % 4 == 1, "Male").when(who % 4 == 2, "unknown")
    return rows.select(
        "cohort", "subject_id", F.col("o_orderkey").alias("measurement_id"), (F.col("l_orderkey") * 10 + line).alias("segment_id"),
        F.when(line % 2 == 0, 125.0).otherwise(50.0).alias("sample_rate_hz"), (size * 100).cast("double").alias("n_samples"), (100 + size).cast("double").alias("sbp"), (50 + line).cast("double").alias("dbp"),
        F.when(who % 6 != 0, (20 + who % 60).cast("double")).alias("age"), sex.alias("sex"), F.when(who % 5 != 0, (20 + line).cast("double")).alias("bmi"),
    )


@query(f"""WITH {_SEGMENTS}, w AS (SELECT cohort, count(DISTINCT subject_id) AS subjects, count(DISTINCT measurement_id) AS measurements,
 count(*) AS segments, count(*) AS input_windows, 'source ' || cohort AS source, quantile_cont(n_samples * 2.0 / sample_rate_hz, 0.5) AS label_duration_median,
 array_to_string(list_sort(list(DISTINCT CASE WHEN n_samples % 2 = 0 THEN 'segment' ELSE 'measurement' END)), ',') AS label_scope,
 array_to_string(list_sort(list(DISTINCT sample_rate_hz)), ',') AS sample_rates_hz, quantile_cont(n_samples / sample_rate_hz, 0.5) AS duration_median,
 min(n_samples / sample_rate_hz) AS duration_min, max(n_samples / sample_rate_hz) AS duration_max, avg(CASE WHEN age IS NULL THEN 1.0 ELSE 0.0 END) AS age_missing,
 avg(CASE WHEN sex IS NULL OR lower(sex) = 'unknown' THEN 1.0 ELSE 0.0 END) AS sex_missing, avg(CASE WHEN bmi IS NULL THEN 1.0 ELSE 0.0 END) AS bmi_missing
 FROM sg GROUP BY cohort),
u AS (SELECT cohort, m.sbp, m.dbp FROM (SELECT cohort, subject_id, measurement_id, min(struct_pack(i := segment_id, sbp := sbp, dbp := dbp)) AS m
 FROM sg GROUP BY ALL)),
l AS (SELECT cohort, count(*) AS label_units, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_sd, min({c}) AS {c}_min, max({c}) AS {c}_max' for c in ('sbp', 'dbp'))}
 FROM u GROUP BY cohort),
p AS (SELECT cohort, count(*) FILTER (s = 'female') AS female_subjects, count(*) FILTER (s = 'male') AS male_subjects
 FROM (SELECT cohort, subject_id, lower(min(sex)) AS s FROM sg GROUP BY ALL) GROUP BY cohort)
SELECT * REPLACE (round(label_duration_median, 6) AS label_duration_median, round(duration_median, 6) AS duration_median, round(duration_min, 6) AS duration_min,
 round(duration_max, 6) AS duration_max, round(age_missing, 6) AS age_missing, round(sex_missing, 6) AS sex_missing,
 round(bmi_missing, 6) AS bmi_missing)
FROM w JOIN l USING (cohort) JOIN p USING (cohort)""")
def manifest_summary(spark, d):
    names = ["label_duration_median", "duration_median", "duration_min", "duration_max", "age_missing", "sex_missing", "bmi_missing", "sbp_mean", "sbp_sd", "dbp_mean", "dbp_sd"]
    scope = F.when(F.col("n_samples") % 2 == 0, "segment").otherwise("measurement")
    rows = _segments(spark, d).withColumns({"label_scope": scope, "label_duration_seconds": F.col("n_samples") * 2.0 / F.col("sample_rate_hz"), "source": F.concat(F.lit("source "), F.col("cohort").cast("string"))})
    return _round(reports.manifest_summary(rows, ["cohort"]), names, 6)


@query(f"""WITH {_SEGMENTS}, b AS (SELECT cohort, subject_id, max(age) AS age, coalesce(lower(max(sex)), 'unknown') AS sex, list_sort(list(DISTINCT bmi) FILTER (bmi IS NOT NULL)) AS v
 FROM sg GROUP BY ALL)
SELECT cohort, subject_id, age, sex, list_median(v) AS bmi, CAST(coalesce(len(v), 0) AS INTEGER) AS bmi_values
 FROM b""")
def canonical_covariates(spark, d):
    return reports.canonical_covariates(_segments(spark, d), ["cohort"])


@query(f"""WITH {PRED}, {sql_units('cohort, method')}, s AS (SELECT cohort, method, subject_id, avg(y_true) AS y, avg(y_pred) AS p
 FROM units GROUP BY ALL) SELECT cohort, method, round(stddev_samp(p), 4) AS prediction_sd,
 round(stddev_samp(y), 4) AS truth_sd, count(*) AS n_subjects, round(stddev_samp(p) / nullif(stddev_samp(y), 0), 6) AS ratio
 FROM s GROUP BY ALL""")
def spread_ratio(spark, d):
    made = reports.prediction_spread(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"])
    return _round(_round(made, ["prediction_sd", "truth_sd"]), ["ratio"], 6)


@query(f"""WITH {PRED}, {sql_units('cohort, method')} SELECT cohort, method, round(avg(y_pred - y_true), 4) + 0.0 AS bias,
 round(avg(y_pred - y_true) - 1.96 * stddev_samp(y_pred - y_true), 4) + 0.0 AS lower, round(avg(y_pred - y_true) + 1.96 * stddev_samp(y_pred - y_true), 4) + 0.0 AS upper,
 round(avg((y_pred + y_true) / 2), 4) AS mean_level, count(*) AS n FROM units GROUP BY ALL""")
def bland_altman(spark, d):
    return _round(reports.agreement(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"]), ["bias", "lower", "upper", "mean_level"])


@query(f"""WITH {PRED}, {sql_units('cohort, method')} SELECT cohort, method, round(regr_slope(y_pred, y_true), 8) + 0.0 AS slope,
 round(regr_intercept(y_pred, y_true), 4) + 0.0 AS intercept FROM units GROUP BY ALL""")
def trend(spark, d):
    made = reports.trend(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"])
    return _round(_round(made, ["slope"], 8), ["intercept"])


@query(f"""WITH {_ORDER_UNITS}, w AS (SELECT cohort, y_true, 1.0 / count(*) OVER (PARTITION BY cohort, subject_id) AS w
 FROM ou), b AS (SELECT cohort, CAST(least(greatest(floor((y_true - 0.0) / (500000.0 / 25)) + 1, 1), 25) AS INTEGER) AS bin, sum(w) AS weight
 FROM w GROUP BY ALL)
SELECT cohort, bin, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY cohort) / (500000.0 / 25), 10) AS density
 FROM b""")
def histograms(spark, d):
    rows = _order_units(spark, d)
    counts = rows.groupBy("cohort", "subject_id").agg(F.count("*").alias("n"))
    made = reports.histogram(rows.join(counts, ["cohort", "subject_id"]), ["cohort"], "y_true", 0.0, 500000.0, 25, 1 / F.col("n"))
    return made.select("cohort", "bin", F.round("weight", 6).alias("weight"), F.round("density", 10).alias("density"))


@query(f"""WITH {PRED}, {sql_units('cohort, method')}, {sql_moments('cohort, method', 'units')}, {sql_metrics('cohort, method', 'moments')}
SELECT cohort, method, CASE WHEN method = 'signal_plus' THEN 'signal + balance/segment' WHEN method = 'covariates' THEN 'only balance/segment' ELSE method END AS label,
 round(mae, 2) AS mae, CAST(rank() OVER (PARTITION BY cohort ORDER BY round(mae, 6)) AS INTEGER) AS rank,
 CASE method WHEN 'covariates' THEN 1 WHEN 'signal' THEN 2 ELSE 3 END AS presentation FROM metrics""")
def report_rows(spark, d):
    metrics = scoring.balanced_metrics(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"]).withColumn("mae", F.round("mae", 6))
    fields = manifest.available_fields(subjects(spark, d), ["cohort"], {"acctbal": "balance", "segment": "segment"})
    order = F.broadcast(spark.createDataFrame([("covariates", 1), ("signal", 2), ("signal_plus", 3)], "method string, presentation int"))  # a row for each method
    rows = scoring.ranked(metrics, ["cohort"]).join(fields, "cohort").join(order, "method")
    return rows.select("cohort", "method", reports.method_label(F.col("method"), F.col("fields")).alias("label"), F.round("mae", 2).alias("mae"), "rank", "presentation")


@query(f"""WITH inner_ AS ({_ORACLE['paired_bootstrap_ci']}) SELECT contrast, count(*) FILTER (delta < 0) AS n_improved,
 count(*) FILTER (ci_high < 0) AS n_certain, count(*) AS n, round(max(greatest(0.0, delta - ci_low)), 4) AS widest_low,
 round(max(greatest(0.0, ci_high - delta)), 4) AS widest_high FROM inner_ GROUP BY contrast""")
def improving_contrasts(spark, d):
    made = paired_bootstrap_ci(spark, d)
    low, high = reports.error_bars(F.col("delta"), F.col("ci_low"), F.col("ci_high"))
    bars = made.groupBy("contrast").agg(F.round(F.max(low), 4).alias("widest_low"), F.round(F.max(high), 4).alias("widest_high"))
    return reports.improving(made, ["contrast"]).join(bars, "contrast")


@query(f"""WITH {PRED}, {sql_units('cohort, method')}, {sql_moments('cohort, method', 'units')}, {sql_metrics('cohort, method', 'moments')} SELECT cohort, {', '.join(f'round(max(mae) FILTER (method = {m!r}), 4) AS {m}_mae' for m in ('signal', 'covariates', 'signal_plus'))}
 FROM metrics GROUP BY cohort""")
def wide_metrics(spark, d):
    metrics = scoring.balanced_metrics(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"])
    wide = metrics.groupBy("cohort").pivot("method", ["signal", "covariates", "signal_plus"]).agg(F.first("mae"))
    return wide.select("cohort", *(rounded(m).alias(f"{m}_mae") for m in ("signal", "covariates", "signal_plus")))


@query(f"""WITH w AS ({_ORACLE['wide_metrics']}), c AS (SELECT * FROM ({_ORACLE['constant_contrast']})
 WHERE constant = 'median_constant'), l AS ({_ORACLE['complementarity']}) SELECT w.*, c.delta AS constant_delta, l.first_lift, l.second_lift, l.better_than_both
 FROM w LEFT JOIN c USING (cohort) LEFT JOIN l USING (cohort)""")
def information_source_table(spark, d):
    metrics = scoring.balanced_metrics(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"]).withColumn("mae", rounded("mae"))
    return reports.information_sources(metrics, constant_contrast(spark, d).where("constant = 'median_constant'"), complementarity(spark, d), ["cohort"], ["signal", "covariates", "signal_plus"])


# means of cents as exact decimals with six digits, in SQL by whole numbers of cents and millionths
_MICRO = "(2 * CAST(sum(CAST(round(y_true * 100) AS BIGINT)) AS HUGEINT) * 10000 + count(*)) // (2 * count(*))"


def _cents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y_true", F.col("y_true").cast("decimal(18, 2)"))


@query(f"""WITH {_ORDER_UNITS}, m AS (SELECT cohort, subject_id, {_MICRO} AS micro FROM ou GROUP BY ALL)
SELECT cohort, subject_id, measurement_id, CAST(CAST(round(y_true * 100) AS BIGINT) * 10000 - micro AS DOUBLE) / 1e6 AS deviation FROM ou JOIN m USING (cohort, subject_id)""")
def join_back_means(spark, d):
    rows = scoring.with_subject_mean(_cents(_order_units(spark, d)), ["cohort"], "y_true", "mean")
    return rows.select("cohort", "subject_id", "measurement_id", (F.col("y_true") - F.col("mean")).cast("double").alias("deviation"))


@query(f"""WITH {_ORDER_UNITS}, m AS (SELECT cohort, subject_id, CAST({_MICRO} AS DOUBLE) / 1e6 AS mean FROM ou GROUP BY ALL)
SELECT cohort, subject_id, mean, s.acctbal, s.segment FROM m JOIN subjects s USING (cohort, subject_id)""")
def covariate_join(spark, d):
    means = _cents(_order_units(spark, d)).groupBy("cohort", "subject_id").agg(F.avg("y_true").cast("double").alias("mean"))
    return means.join(subjects(spark, d), ["cohort", "subject_id"])


@query("""WITH a AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s, o_orderpriority AS p,
 count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT s, sum(n) AS total FROM a GROUP BY s)
 SELECT a.s AS status, a.p AS priority, a.n, CAST(b.total AS BIGINT) AS total FROM a JOIN b ON a.s IS NOT DISTINCT
 FROM b.s""")
def null_safe_match(spark, d):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    a = table(spark, d, "orders").groupBy(status.alias("s"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    b = a.groupBy("s").agg(F.sum("n").alias("total")).withColumnRenamed("s", "t")
    return a.join(b, F.col("s").eqNullSafe(F.col("t"))).select(F.col("s").alias("status"), "priority", "n", "total")


# ---- transforms

_POOL = """po AS (SELECT CAST(c_custkey % 5 AS INTEGER) AS pool, c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS a, CAST(c_nationkey AS DOUBLE) AS b, c_mktsegment AS seg, 1.0 + c_custkey % 3 AS w
 FROM customer)"""


def _pool(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select((k % 5).cast("int").alias("pool"), k.alias("k"), F.when(k % 9 != 0, F.col("c_acctbal")).alias("a"), F.col("c_nationkey").cast("double").alias("b"), F.col("c_mktsegment").alias("seg"), (1.0 + k % 3).alias("w"))


@query(f"""WITH {_POOL}, lo AS (SELECT pool, k, w, 'a' AS feature, a AS value FROM po UNION ALL SELECT pool, k, w, 'b', b
 FROM po), mg AS (SELECT pool, feature, value, sum(w) AS w FROM lo WHERE value IS NOT NULL GROUP BY ALL),
 cu AS (SELECT *, sum(w) OVER (PARTITION BY pool, feature ORDER BY value) AS c, sum(w) OVER (PARTITION BY pool, feature) AS t
 FROM mg),
me AS (SELECT pool, feature, min(value) AS median FROM cu WHERE c >= t / 2 - 1e-12 * t GROUP BY ALL),
 fi AS (SELECT lo.*, median, coalesce(value, median, 0.0) AS x, CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END AS g
 FROM lo LEFT JOIN me USING (pool, feature)),
pr AS (SELECT pool, feature, sum(x * w) / sum(w) AS m, sum(x * x * w) / sum(w) AS x2, sum(g * w) / sum(w) AS gm, max(g) AS hg
 FROM fi GROUP BY ALL), ps AS (SELECT *, CASE WHEN sqrt(greatest(0.0, x2 - m * m)) > 1e-8 THEN sqrt(greatest(0.0, x2 - m * m)) ELSE 1.0 END AS s,
 CASE WHEN sqrt(greatest(0.0, gm * (1 - gm))) > 1e-8 THEN sqrt(gm * (1 - gm)) ELSE 1.0 END AS gs
 FROM pr)
SELECT pool, k, feature, round((x - m) / s, 6) + 0.0 AS value, CASE WHEN hg > 0 THEN round((g - gm) / gs, 6) + 0.0 END AS indicator
 FROM fi JOIN ps USING (pool, feature)""")
def feature_transform(spark, d):
    rows = _pool(spark, d)
    made = transforms.apply_numeric(rows, transforms.fit_numeric(rows, ["pool"], ["a", "b"], "w"), ["pool"], ["k"], ["a", "b"])
    return _round(made, ["value", "indicator"], 6)


@query(f"""WITH {_ORDER_UNITS}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY cohort, subject_id) AS w
 FROM ou), p AS (SELECT fold, sum(y_true * w) / sum(w) AS m, sum(y_true * y_true * w) / sum(w) AS y2
 FROM w GROUP BY fold)
SELECT fold, measurement_id, round((y_true - m) / sqrt(y2 - m * m), 6) + 0.0 AS encoded, round(y_true, 3) AS decoded
 FROM w JOIN p USING (fold)""")
def decode_outputs(spark, d):
    rows = _order_units(spark, d)
    rows = rows.join(rows.groupBy("cohort", "subject_id").agg((1 / F.count("*")).alias("w")), ["cohort", "subject_id"])
    both = rows.join(transforms.fit_target(rows, ["fold"], "y_true", "w"), "fold").withColumn("z", (F.col("y_true") - F.col("decoder_mean")) / F.col("decoder_sd"))
    return both.select("fold", "measurement_id", rounded("z", 6).alias("encoded"), F.round(transforms.decoded(F.col("z"), F.col("decoder_mean"), F.col("decoder_sd")), 3).alias("decoded"))


@query("""WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x
 FROM embeddings), p AS (SELECT label, dim, avg(x) AS m, greatest(sqrt(greatest(0.0, avg(x * x) - avg(x) * avg(x))), 1e-6) AS s
 FROM e GROUP BY ALL)
SELECT vec_id, round(sum((x - m) / s), 4) + 0.0 AS total, round(max(abs((x - m) / s)), 4) AS largest,
 count(*) AS n FROM e JOIN p USING (label, dim) GROUP BY vec_id""")
def vector_standardisation(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.lit(1.0).alias("w"))
    params = transforms.fit_vectors(rows, ["label"], "v", "w")
    z = rows.join(params, "label").select("vec_id", transforms.standardised(F.col("v"), F.col("means"), F.col("scales")).alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + x)
    return z.select("vec_id", rounded(total).alias("total"), F.round(F.array_max(F.transform("z", lambda x: F.abs(x))), 4).alias("largest"), F.size("z").cast("long").alias("n"))


@query("""SELECT e.vec_id, len(e.embedding) + 4 AS n_features, round(CAST(e.embedding[1] AS DOUBLE) + c.c_acctbal, 4) + 0.0 AS first_plus_last, c.c_mktsegment = 'BUILDING' AS first_category
 FROM embeddings e JOIN customer c ON e.vec_id + 1 = c.c_custkey""")
def feature_assembly(spark, d):
    rows = table(spark, d, "embeddings").join(table(spark, d, "customer"), F.col("vec_id") + 1 == F.col("c_custkey"))
    hot = transforms.one_hot(F.col("c_mktsegment"), ("BUILDING", "MACHINERY"))
    x = rows.select("vec_id", F.concat(F.col("embedding").cast("array<double>"), hot, F.array(F.col("c_acctbal"))).alias("x"))
    return x.select("vec_id", F.size("x").cast("long").alias("n_features"), rounded(F.element_at("x", 1) + F.element_at("x", -1)).alias("first_plus_last"), (F.element_at("x", -4) == 1.0).alias("first_category"))


def _vector_rows(spark, d) -> DataFrame:
    """Vectors as rows of 97 subjects, one component of some a gap; two targets."""
    k = F.col("vec_id")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((i == 3) & (k % 11 == 0), None).otherwise(x))
    return table(spark, d, "embeddings").select(k.alias("measurement_id"), (k % 97).alias("subject_id"), (k % 97 % 5).cast("int").alias("fold"), v.alias("features"), F.col("label").cast("double").alias("y"), F.col("embedding")[0].cast("double").alias("first"))


@query("""WITH v AS (SELECT vec_id % 97 AS subject_id, CAST(vec_id % 97 % 5 AS INTEGER) AS fold, CAST(label AS DOUBLE) AS y FROM embeddings)
SELECT fold, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, round(stddev_samp(y), 6) AS truth_sd FROM v GROUP BY fold""")
def ridge_diagnostics(spark, d):
    _, found = ridge.benchmark(_vector_rows(spark, d), {"method": "vectors"})
    return found.select("fold", "n_rows", "n_subjects", rounded("truth_sd", 6).alias("truth_sd"))


@query()
def ridge_nested(spark, d):
    return _round(ridge.nested(_vector_rows(spark, d), ("y", "first"))[0], ["y_pred"])


@query()
def ridge_tuning(spark, d):
    return _round(ridge.nested(_vector_rows(spark, d), ("y", "first"))[2], ["validation_mae"])


@query("""WITH e AS (SELECT vec_id, CAST(vec_id % 97 % 5 AS INTEGER) AS fold, [1.0, CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(label AS DOUBLE)] AS z,
 1.0 / count(*) OVER (PARTITION BY vec_id % 97) AS w FROM embeddings), ij AS (SELECT fold, w, i, j, z[i + 1] * z[j + 1] AS product
 FROM e, range(5) a(i), range(5) b(j))
SELECT fold, CAST(i * 5 + j + 1 AS INTEGER) AS place, round(sum(w * product), 6) + 0.0 AS moment
 FROM ij GROUP BY ALL UNION ALL SELECT fold, 0, CAST(count(*) AS DOUBLE) FROM e GROUP BY fold""")
def ridge_cell_moments(spark, d):
    rows = ridge.weighted(_vector_rows(spark, d)).withColumn("z", F.slice("features", 1, 3)).withColumn("ys", F.array("y"))
    cells = ridge.cell_moments(rows, ["fold"])
    return cells.select("fold", F.posexplode("moments").alias("place", "moment")).withColumn("moment", rounded("moment", 6))


# ---- records as arrays

_ARRAYS = """ar AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id),
 el AS (SELECT user_id, generate_subscripts(x, 1) AS i, unnest(x) AS v, len(x) AS n FROM ar)"""


def _record_sizes(spark, d) -> DataFrame:
    """(segment_id, n): how many values each user has."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("segment_id")).agg(F.count("*").alias("n"))


@query(f"""WITH {_ARRAYS}, m AS (SELECT user_id, avg(v) AS m, stddev_pop(v) AS s, max(v) - min(v) AS r, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS q,
 count(*) AS n FROM el GROUP BY user_id),
c AS (SELECT user_id, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4 FROM el JOIN m USING (user_id)
 GROUP BY user_id)
SELECT user_id, round(m, 6) AS mean, round(s, 6) AS std, round(r, 6) AS range, round(q, 6) AS iqr,
 round(CASE WHEN m.n > 2 AND s > 1e-12 THEN sqrt(m.n * (m.n - 1.0)) / (m.n - 2) * m3 / pow(s, 3) END, 5) + 0.0 AS skew,
 round(CASE WHEN m.n > 3 AND s > 1e-12 THEN (m.n - 1.0) / ((m.n - 2.0) * (m.n - 3)) * ((m.n + 1) * (m4 / pow(s, 4) - 3) + 6) END, 5) + 0.0 AS kurtosis
 FROM m JOIN c USING (user_id)""")
def waveform_stats(spark, d):
    made = waveform.row_statistics(_samples(spark, d), ["user_id"], "value").drop("n")
    return _round(_round(made, ["mean", "std", "range", "iqr"], 6), ["skew", "kurtosis"], 5)


def _noisy(spark, d) -> DataFrame:
    """Samples of which some are not finite, by rule."""
    x = F.when(F.col("event_id") % 23 == 0, F.lit(float("nan"))).when(F.col("event_id") % 29 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return _samples(spark, d).withColumn("value", x)


@query("""WITH q AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 23 <> 0 AND event_id % 29 <> 0) AS k FROM events GROUP BY user_id),
 dd AS (SELECT user_id, value AS v, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events WHERE event_id % 23 <> 0 AND event_id % 29 <> 0),
 f AS (SELECT user_id, count(*) FILTER (d = 0) / nullif(count(d), 0) AS flat, avg(abs(d)) AS step, min(v) = max(v) AS same FROM dd GROUP BY user_id)
SELECT user_id, n, k / n AS finite_share, round(flat, 8) AS flat_share, round(step, 6) AS mean_step,
 concat_ws(';', CASE WHEN n < 2 THEN 'too_short' END, CASE WHEN k < n THEN 'not_finite' END, CASE WHEN same THEN 'constant' END) AS reasons FROM q LEFT JOIN f USING (user_id)""")
def signal_qc(spark, d):
    made = waveform.row_quality(_noisy(spark, d), ["user_id"], ["ts", "event_id"], "value")
    return made.withColumns({"flat_share": F.round("flat_share", 8), "mean_step": F.round("mean_step", 6)})


@query(f"""WITH {_ARRAYS}, s AS (SELECT user_id, len(x) AS n, CAST(ceil(len(x) * 20 / 30.0) AS INTEGER) AS r
 FROM ar) SELECT user_id, CAST(n AS INTEGER) AS raw_length, r AS resampled_length, greatest(r, 50) AS padded_length, r < 50 AS padded
 FROM s""")
def nested_step_flag(spark, d):
    steps = _record_sizes(spark, d).select("segment_id", waveform.stage_trace(F.col("n").cast("int"), F.lit(30), 20, 50).alias("steps"))
    at = lambda k: F.col("steps")[k]["length"]
    return steps.select(F.col("segment_id").alias("user_id"), at(0).alias("raw_length"), at(1).alias("resampled_length"), at(2).alias("padded_length"), waveform.any_padded(F.col("steps")).alias("padded"))


@query("WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT n AS n_samples, count(*) AS n_records FROM a GROUP BY n")
def sample_count_distribution(spark, d):
    return _record_sizes(spark, d).groupBy(F.col("n").alias("n_samples")).agg(F.count("*").alias("n_records"))


def _halves(samples, rates) -> np.ndarray:
    return np.array([[x[: len(x) // 2].mean() if len(x) > 1 else x.mean(), x[len(x) // 2 :].mean(), r] for x, r in zip(samples, rates, strict=True)])


#: Samples of a segment that the user's encoder gets.
SEGMENT = 32


@query(f"""WITH pl AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events),
 sg AS (SELECT user_id, p // {SEGMENT} AS segment, p % {SEGMENT} AS k, v, count(*) OVER (PARTITION BY user_id, p // {SEGMENT}) AS n FROM pl)
SELECT user_id, CAST(segment AS BIGINT) AS segment, round(avg(v) FILTER (k < n // 2 OR n = 1), 6) + 0.0 AS f0, round(avg(v) FILTER (k >= n // 2), 6) + 0.0 AS f1, 30.0::DOUBLE AS f2
 FROM sg GROUP BY user_id, segment""")
def apply_encoder(spark, d):
    rows = waveform.segments(_samples(spark, d), ["user_id"], ["ts", "event_id"], "value", SEGMENT).withColumn("rate", F.lit(30))
    made = waveform.encoded(rows, _halves, 3, keep=("user_id", "segment"))
    return made.select("user_id", "segment", *(rounded(F.col("features")[k], 6).alias(f"f{k}") for k in range(3)))


@query("""WITH s AS (SELECT user_id, event_id, ts, (value - lag(value) OVER w) * 30.0::DOUBLE AS slope FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 c AS (SELECT *, (slope - lag(slope) OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 30.0::DOUBLE AS curve FROM s)
SELECT user_id, round(max(slope), 4) AS steepest, round(min(slope), 4) AS lowest, round(avg(abs(curve)), 4) AS mean_curve, count(curve) AS n_curves FROM c GROUP BY user_id""")
def waveform_derivatives(spark, d):
    made = waveform.derivatives(_samples(spark, d), ["user_id"], ["ts", "event_id"], "value", 30.0)
    return made.groupBy("user_id").agg(rounded(F.max("slope")).alias("steepest"), rounded(F.min("slope")).alias("lowest"), rounded(F.avg(F.abs("curve"))).alias("mean_curve"), F.count("curve").alias("n_curves"))


def _samples(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "value")


_PLACED = """pl AS (SELECT user_id, value AS v, row_number() OVER w - 1 AS place, lag(value) OVER w AS b, lead(value) OVER w AS a
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"""WITH {_PLACED}, pk AS (SELECT user_id, place, (place - lag(place) OVER (PARTITION BY user_id ORDER BY place)) / 30.0::DOUBLE AS i
 FROM pl WHERE v > b AND v >= a), ch AS (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY place) AS c FROM pk)
SELECT user_id, count(*) AS n_peaks, round(avg(i), 6) AS interval_mean, round(stddev_samp(i), 6) AS interval_sd, round(sqrt(avg(c * c)), 6) AS interval_rmssd,
 round(60 / avg(i), 4) AS per_minute FROM ch GROUP BY user_id""")
def peak_intervals(spark, d):
    found = waveform.peaks(_samples(spark, d), ["user_id"], ["ts", "event_id"], "value")
    return _round(_round(waveform.peak_intervals(found, ["user_id"], 30.0), ["interval_mean", "interval_sd", "interval_rmssd"], 6), ["per_minute"])


#: Frequencies of the band in which the strongest is sought, in Hz.
BAND = [0.5 + 0.25 * k for k in range(15)]


@query(f"""WITH {_PLACED}, lv AS (SELECT user_id, avg(v) AS m FROM pl GROUP BY user_id),
fs AS (SELECT user_id, f, count(*) AS n, sum(cos(place * (2 * pi() * f / 30)) * (v - m)) AS c, sum(sin(place * (2 * pi() * f / 30)) * (v - m)) AS s
 FROM pl JOIN lv USING (user_id), (SELECT unnest({BAND})::DOUBLE AS f) GROUP BY user_id, f),
pw AS (SELECT *, (c * c + s * s) / n AS p FROM fs)
SELECT user_id, n, arg_max(f, struct_pack(p := p, g := -f)) AS peak_hz, round(max(p), 4) AS peak_power FROM pw GROUP BY user_id, n""")
def spectral_argmax(spark, d):
    placed = scans.numbered_from(_samples(spark, d), ["user_id"], ["ts", "event_id"], "place")
    return _round(waveform.band_peak(placed, ["user_id"], "place", "value", 30.0, BAND), ["peak_power"])


#: Labels of the methods that these queries score.
LABELS = {"signal": "Signal {model}", "covariates": "Covariates only{mark}", "signal_plus": "Signal {model} + covariates{mark}"}


@query(f"""WITH {PRED}, {sql_units('cohort, method')}, {sql_moments('cohort, method', 'units')}, {sql_metrics('cohort, method', 'moments')}
SELECT cohort, method, CASE method WHEN 'signal' THEN 'Signal part' WHEN 'covariates' THEN 'Covariates only' || CASE WHEN cohort % 2 = 0 THEN '†' ELSE '' END
 ELSE 'Signal part + covariates' || CASE WHEN cohort % 2 = 0 THEN '†' ELSE '' END END AS label,
 CASE method WHEN 'signal' THEN 'Signal part' WHEN 'covariates' THEN 'Covariates only' ELSE 'Signal part + covariates' END AS heatmap_label,
 printf('%.2f', mae) || CASE WHEN method = 'signal' THEN chr(10) || '±' || printf('%.2f', rmse) ELSE '' END AS text FROM metrics""")
def display_labels(spark, d):
    metrics = scoring.balanced_metrics(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"])
    fields = F.when(F.col("cohort") % 2 == 0, "age/sex").otherwise("age/sex/BMI")
    uses = ("covariates", "plus")
    label = reports.display_label(F.col("method"), F.lit("part"), fields, LABELS, covariates=uses)
    text = reports.metric_text(F.col("mae"), F.col("rmse"), F.col("method") == "signal")
    return metrics.select("cohort", "method", label.alias("label"), reports.heatmap_label(F.col("method"), F.lit("part"), LABELS).alias("heatmap_label"), text.alias("text"))


@query(f"""WITH {PRED}, {sql_units('cohort, method')}, {sql_moments('cohort, method', 'units')}, {sql_metrics('cohort, method', 'moments')},
 m AS (SELECT *, cohort % 2 AS policy, CASE method WHEN 'signal' THEN 'none' ELSE 'age/sex' END AS fields FROM metrics)
SELECT a.cohort, a.policy, a.fields AS demographic_fields, 'added' AS effect, a.method AS candidate, b.method AS reference, round(a.mae - b.mae, 4) + 0.0 AS delta_mae, round(a.rmse - b.rmse, 4) + 0.0 AS delta_rmse
 FROM m a JOIN m b ON a.cohort = b.cohort AND a.policy = b.policy AND a.method = 'signal_plus' AND b.method = 'signal' AND b.fields = 'none'""")
def condition_effects(spark, d):
    metrics = scoring.balanced_metrics(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"])
    metrics = metrics.withColumns({"policy": F.col("cohort") % 2, "demographic_fields": F.when(F.col("method") == "signal", "none").otherwise("age/sex")}).withColumnRenamed("method", "condition")
    effects = spark.createDataFrame([("added", "signal_plus", "signal"), ("alone", "covariates", "signal_only")], "effect string, candidate string, reference string")
    return _round(contrasts.condition_effects(metrics, effects, ["cohort", "policy"]), ["delta_mae", "delta_rmse"])


@query(f"""WITH {SUBJECTS}, o AS (SELECT s.cohort, s.subject_id, s.acctbal, CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE round(o.o_totalprice / 1e4, 0) END AS bmi,
 CASE s.subject_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS sex FROM orders o JOIN subjects s ON o.o_custkey = s.subject_id),
 c AS (SELECT cohort, subject_id, min(acctbal) AS age, coalesce(min(sex), 'unknown') AS sex, list_distinct(list(bmi) FILTER (bmi IS NOT NULL)) AS b FROM o GROUP BY ALL),
 k AS (SELECT *, len(b) AS bmi_values, list_aggregate(b, 'quantile_cont', 0.5) AS bmi FROM c)
SELECT cohort, count(*) AS n_subjects, count(age) AS age_observed, round(avg(age), 4) AS age_mean, min(age) AS age_min, max(age) AS age_max, count(bmi) AS bmi_observed,
 round(avg(bmi), 4) AS bmi_mean, min(bmi) AS bmi_min, max(bmi) AS bmi_max, count(*) FILTER (bmi_values > 1) AS bmi_several, count(*) FILTER (sex = 'female') AS female,
 count(*) FILTER (sex = 'male') AS male, count(*) FILTER (sex = 'unknown') AS neither, round(quantile_cont(age, 0.5), 4) AS age_median, round(quantile_cont(bmi, 0.5), 4) AS bmi_median FROM k GROUP BY cohort""")
def covariate_distribution(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows = orders.join(subjects(spark, d), F.col("o_custkey") == F.col("subject_id"))
    sex = F.when(F.col("subject_id") % 3 == 0, "female").when(F.col("subject_id") % 3 == 1, "male")
    bmi = F.when(F.col("o_orderkey") % 3 != 0, F.round(F.col("o_totalprice") / 1e4, 0))
    made = reports.canonical_covariates(rows.select("cohort", "subject_id", F.col("acctbal").alias("age"), sex.alias("sex"), bmi.alias("bmi")), ["cohort"])
    return _round(reports.covariate_distribution(made, ["cohort"]), ["age_mean", "bmi_mean", "age_median", "bmi_median"])
