"""Queries on predictions: units, balanced metrics, contrasts and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import bootstrap, contrasts, scoring
from ..sources.shared import written
from .base import METRIC_NAMES, PRED, SUBJECTS, predictions, query, sql_draws, sql_metrics, sql_moments, sql_round, sql_units, subjects, table

REPLICATES = 200


def _round(df: DataFrame, names, digits: int = 4) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})


def units(spark: SparkSession, d: str, seeds: bool = True) -> DataFrame:
    return scoring.scoring_units(predictions(spark, d), ["cohort", "fold", "method", *(["seed"] if seeds else [])])


@query(f"""WITH {PRED}, {sql_units('cohort, fold, seed, method')}, sg AS (SELECT cohort, fold, seed, method, subject_id, measurement_id, count(DISTINCT segment_id) AS n_segments FROM pred GROUP BY ALL)
SELECT cohort, fold, seed, method, subject_id, measurement_id, {sql_round(['y_true', 'y_pred'], 5)}, sg.n_segments
 FROM units JOIN sg USING (cohort, fold, seed, method, subject_id, measurement_id)""")
def scoring_units(spark, d):
    made = scoring.scoring_units(predictions(spark, d), ["cohort", "fold", "method", "seed"], "segment_id")
    return _round(made, ["y_true", "y_pred"], 5)


@query(f"""WITH {PRED}, {sql_units('cohort, fold, method')}, {sql_moments('cohort, method', 'units')}, {sql_metrics('cohort, method', 'moments')} SELECT cohort, method, n_subjects, n_measurements, {sql_round(METRIC_NAMES)}
 FROM metrics""")
def balanced_metrics(spark, d):
    return _round(scoring.balanced_metrics(units(spark, d, False), ["cohort", "method"]), METRIC_NAMES)


@query(f"""WITH {PRED}, {sql_units('cohort, fold, method')}, {sql_moments('cohort, method', 'units')}, {sql_metrics('cohort, method', 'moments')} SELECT cohort, method,
 round(mae, 4) + 0.0 AS mae, CAST(rank() OVER (PARTITION BY cohort ORDER BY round(mae, 6)) AS INTEGER) AS rank
 FROM metrics""")
def metric_rank(spark, d):
    metrics = scoring.balanced_metrics(units(spark, d, False), ["cohort", "method"])
    return _round(scoring.ranked(metrics.select("cohort", "method", rounded("mae", 6).alias("mae")), ["cohort"]), ["mae"])


@query(f"""WITH {PRED}, {sql_units('cohort, fold, seed, method')}, across AS (SELECT cohort, fold, method, subject_id, measurement_id, avg(y_true) AS y_true, avg(y_pred) AS y_pred, max(n_segments) AS n_segments,
 count(DISTINCT seed) AS n_seeds FROM units GROUP BY ALL)
SELECT cohort, method, CASE WHEN n_seeds > 1 THEN 'mean_over_seeds' ELSE 'single_seed' END AS aggregation_mode,
 count(*) AS n_units, max(n_segments) AS most_segments, round(avg(y_true), 4) AS y_true, round(avg(y_pred), 4) AS y_pred
 FROM across GROUP BY ALL""")
def seed_units(spark, d):
    across = scoring.across_seeds(units(spark, d), ["cohort", "fold", "method"])
    return across.groupBy("cohort", "method", "aggregation_mode").agg(F.count("*").alias("n_units"), F.max("n_segments").alias("most_segments"), rounded(F.avg("y_true")).alias("y_true"), rounded(F.avg("y_pred")).alias("y_pred"))


_SEED_METRICS = f"{PRED}, {sql_units('cohort, fold, seed, method')}, {sql_moments('cohort, method, seed', 'units')}, {sql_metrics('cohort, method, seed', 'moments')}"
_SEED_MEANS = ", ".join(f"round(avg({m}), 4) + 0.0 AS {m}, round(coalesce(stddev_samp({m}), 0.0), 4) + 0.0 AS {m}_seed_sd" for m in METRIC_NAMES)


@query(f"""WITH {_SEED_METRICS} SELECT cohort, method, {_SEED_MEANS}, max(n_subjects) AS n_subjects, max(n_measurements) AS n_measurements,
 count(*) AS n_seeds FROM metrics GROUP BY ALL""")
def seed_aggregate(spark, d):
    summary = scoring.seed_summary(scoring.balanced_metrics(units(spark, d), ["cohort", "method", "seed"]), ["cohort", "method"])
    return _round(summary, [*METRIC_NAMES, *(f"{m}_seed_sd" for m in METRIC_NAMES)])


@query(f"""WITH {PRED}, {sql_units('cohort, method')} SELECT * FROM (
SELECT cohort, method, 'row' AS policy, round(avg(abs(y_pred - y_true)), 4) AS mae FROM pred
 GROUP BY ALL
UNION ALL SELECT cohort, method, 'measurement', round(avg(abs(y_pred - y_true)), 4) FROM units
 GROUP BY ALL
UNION ALL SELECT cohort, method, 'subject', round(avg(g), 4) FROM (SELECT cohort, method, subject_id, avg(abs(y_pred - y_true)) AS g
 FROM units GROUP BY ALL) GROUP BY cohort, method)""")
def macro_mae_policies(spark, d):
    rows = predictions(spark, d)
    made = [scoring.macro_mae(rows, ["cohort", "method"], p).select("cohort", "method", F.lit(p).alias("policy"), rounded("mae").alias("mae")) for p in ("row", "measurement", "subject")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(f"""WITH {PRED}, {sql_units('cohort, method')},
dev AS (SELECT *, y_true - my AS dy, y_pred - mp AS dp FROM (SELECT *, avg(y_true) OVER w AS my, avg(y_pred) OVER w AS mp,
 count(*) OVER w AS n
 FROM units WINDOW w AS (PARTITION BY cohort, method, subject_id))),
per AS (SELECT cohort, method, subject_id, avg(my) AS my, avg(mp) AS mp, max(n) AS n, avg(abs(y_pred - y_true)) AS mae, avg(abs(dp - dy)) AS gap,
 sqrt(avg(dy * dy)) AS sy, sqrt(avg(dp * dp)) AS sp FROM dev GROUP BY cohort, method, subject_id)
SELECT cohort, method, count(*) AS n_subjects, CAST(sum(n) AS BIGINT) AS n_measurements, count(*) FILTER (n > 1) AS n_repeated,
 round(avg(mae), 4) AS overall_mae, round(avg(abs(mp - my)), 4) AS between_mae, round(avg(gap), 4) AS within_mae,
 round(avg(sy), 4) AS true_within_sd, round(avg(sp), 4) AS pred_within_sd, round(avg(sp) / nullif(avg(sy), 0), 4) AS within_ratio
 FROM per GROUP BY cohort, method""")
def between_within(spark, d):
    made = scoring.between_within(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"])
    return _round(made, ["overall_mae", "between_mae", "within_mae", "true_within_sd", "pred_within_sd", "within_ratio"])


def _order_units(spark, d) -> DataFrame:
    """One truth for each order: (cohort, fold, subject_id, measurement_id, y_true)."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(subjects(spark, d), F.col("o_custkey") == F.col("subject_id")).select("cohort", (F.col("subject_id") % 5).cast("int").alias("fold"), "subject_id", F.col("o_orderkey").alias("measurement_id"), F.col("o_totalprice").alias("y_true"))


_ORDER_UNITS = f"""{SUBJECTS}, ou AS (SELECT s.cohort, CAST(s.subject_id % 5 AS INTEGER) AS fold, s.subject_id, o.o_orderkey AS measurement_id, o.o_totalprice AS y_true
 FROM orders o JOIN subjects s ON o.o_custkey = s.subject_id)"""
_CONSTANTS = f"""{_ORDER_UNITS}, ow AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY cohort, subject_id) AS w
 FROM ou), folds AS (SELECT DISTINCT cohort, fold FROM ou),
fits AS (SELECT f.cohort, f.fold, o.y_true, o.w FROM folds f JOIN ow o ON f.cohort = o.cohort AND f.fold <> o.fold),
merged AS (SELECT cohort, fold, y_true, sum(w) AS w FROM fits GROUP BY ALL), cum AS (SELECT *, sum(w) OVER (PARTITION BY cohort, fold ORDER BY y_true) AS c, sum(w) OVER (PARTITION BY cohort, fold) AS a
 FROM merged),
med AS (SELECT cohort, fold, min(y_true) AS median_constant FROM cum WHERE c >= a / 2 - 1e-12 * a
 GROUP BY ALL), mean AS (SELECT cohort, fold, sum(y_true * w) / sum(w) AS mean_constant FROM fits
 GROUP BY ALL)"""


@query(f"""WITH {_CONSTANTS} SELECT cohort, fold, round(mean_constant, 4) AS mean_constant, round(median_constant, 4) AS median_constant
 FROM folds LEFT JOIN mean USING (cohort, fold) LEFT JOIN med USING (cohort, fold)""")
def weighted_median_loo_constants(spark, d):
    return _round(contrasts.fold_constants(_order_units(spark, d), ["cohort"]), ["mean_constant", "median_constant"])


SPECS = (("combined_vs_covariates", "signal_plus", "covariates"), ("combined_vs_signal", "signal_plus", "signal"), ("signal_vs_covariates", "signal", "covariates"))
_SPECS = "specs AS (SELECT * FROM (VALUES " + ", ".join(str(s) for s in SPECS) + ") t(contrast, candidate, reference))"


def _specs(spark) -> DataFrame:
    return spark.createDataFrame(list(SPECS), "contrast string, candidate string, reference string")


def _pairs(keys: str) -> str:
    return f"""pairs AS (SELECT s.contrast, {', '.join('a.' + k.strip() for k in keys.split(','))}, a.subject_id, a.measurement_id, abs(a.y_pred - a.y_true) - abs(b.y_pred - a.y_true) AS delta
 FROM specs s JOIN units a ON a.method = s.candidate JOIN units b ON b.method = s.reference AND a.subject_id = b.subject_id AND a.measurement_id = b.measurement_id AND """ + " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(",")) + ")"


_DELTAS = f"""{PRED}, {sql_units('cohort, method')}, {_SPECS}, {_pairs('cohort')}, deltas AS (SELECT cohort, contrast, subject_id, avg(delta) AS delta,
 count(*) AS n_units FROM pairs GROUP BY ALL), ctab AS (SELECT cohort, contrast, count(*) AS n_subjects, CAST(sum(n_units) AS BIGINT) AS n_measurements, avg(delta) AS delta
 FROM deltas GROUP BY ALL)"""


def _paired(spark, d) -> DataFrame:
    return contrasts.paired_units(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), _specs(spark), ["cohort"])


@query(f"WITH {_DELTAS} SELECT cohort, contrast, n_subjects, n_measurements, round(delta, 4) + 0.0 AS delta FROM ctab")
def paired_contrast(spark, d):
    return _round(contrasts.contrast_table(_paired(spark, d), ["cohort", "contrast"]), ["delta"])


@query(f"""WITH {PRED}, {sql_units('cohort, method')}, {sql_moments('cohort, method', 'units')}, {sql_metrics('cohort, method', 'moments')} SELECT a.cohort, b.method AS base,
 round(a.mae, 4) AS with_mae, round(b.mae, 4) AS base_mae, round(a.mae - b.mae, 4) + 0.0 AS delta_mae,
 round(a.rmse - b.rmse, 4) + 0.0 AS delta_rmse FROM metrics a JOIN metrics b ON a.cohort = b.cohort AND a.method = b.method || '_plus'""")
def incremental_effects(spark, d):
    metrics = scoring.balanced_metrics(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"])
    return _round(contrasts.incremental_effects(metrics, ["cohort"]), ["with_mae", "base_mae", "delta_mae", "delta_rmse"])


@query(f"""WITH {_DELTAS} SELECT cohort, round(-max(delta) FILTER (contrast = 'combined_vs_covariates'), 4) + 0.0 AS first_lift,
 round(-max(delta) FILTER (contrast = 'combined_vs_signal'), 4) + 0.0 AS second_lift, max(delta) FILTER (contrast = 'combined_vs_covariates') < 0 AND max(delta) FILTER (contrast = 'combined_vs_signal') < 0 AS better_than_both
 FROM ctab GROUP BY cohort""")
def complementarity(spark, d):
    tab = contrasts.contrast_table(_paired(spark, d), ["cohort", "contrast"])
    return _round(contrasts.complementarity(tab, ["cohort"], ("combined_vs_covariates", "combined_vs_signal")), ["first_lift", "second_lift"])


_CONSTANT_KINDS = ("mean_constant", "median_constant")


@query(f"""WITH {PRED}, {sql_units('cohort, fold, method', 'every')}, mo AS (SELECT * FROM every
 WHERE method = 'covariates'),
mw AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY cohort, subject_id) AS w FROM mo), mf AS (SELECT DISTINCT cohort, fold
 FROM mo),
ft AS (SELECT f.cohort, f.fold, o.y_true, o.w FROM mf f JOIN mw o ON f.cohort = o.cohort AND f.fold <> o.fold),
mg AS (SELECT cohort, fold, y_true, sum(w) AS w FROM ft GROUP BY ALL),
cu AS (SELECT *, sum(w) OVER (PARTITION BY cohort, fold ORDER BY y_true) AS c, sum(w) OVER (PARTITION BY cohort, fold) AS a
 FROM mg),
co AS (SELECT cohort, fold, 'median_constant' AS constant, min(y_true) AS value FROM cu WHERE c >= a / 2 - 1e-12 * a
 GROUP BY ALL
 UNION ALL SELECT cohort, fold, 'mean_constant', sum(y_true * w) / sum(w) FROM ft GROUP BY ALL),
pe AS (SELECT cohort, constant, subject_id, avg(abs(y_pred - y_true)) AS m, avg(abs(value - y_true)) AS k, avg(abs(y_pred - y_true) - abs(value - y_true)) AS delta,
 count(*) AS n
 FROM mo JOIN co USING (cohort, fold) GROUP BY ALL),
{sql_draws('cohort', 'pe', REPLICATES, 'constants')},
bm AS (SELECT cohort, constant, replicate, sum(delta * times) / sum(times) AS mean FROM pe JOIN drawn USING (cohort, subject_id)
 GROUP BY ALL),
ci AS (SELECT cohort, constant, round(quantile_cont(mean, 0.025), 4) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 4) + 0.0 AS ci_high,
 round(avg(CASE WHEN mean < 0 THEN 1.0 ELSE 0.0 END), 4) AS p_candidate_better FROM bm GROUP BY ALL),
ta AS (SELECT cohort, constant, count(*) AS n_subjects, CAST(sum(n) AS BIGINT) AS n_measurements,
 round(avg(m), 4) AS model_mae, round(avg(k), 4) AS constant_mae,
 round(avg(delta), 4) + 0.0 AS delta FROM pe GROUP BY cohort, constant)
SELECT * FROM ta JOIN ci USING (cohort, constant)""")
def constant_contrast(spark, d):
    """The model that knows the covariates alone against what the other folds' truths give as a constant."""
    rows = units(spark, d, False).where("method = 'covariates'")
    made = contrasts.model_against_constants(rows, ["cohort"], REPLICATES, seed="constants")
    return _round(made, ["model_mae", "constant_mae", "delta", "ci_low", "ci_high", "p_candidate_better"])


@query(f"""WITH {PRED}, {sql_units('cohort, method, seed')}, {_SPECS}, {_pairs('cohort, seed')},
 sd AS (SELECT cohort, contrast, seed, subject_id, avg(delta) AS delta FROM pairs GROUP BY ALL),
st AS (SELECT cohort, contrast, seed, avg(delta) AS delta, count(*) AS n_subjects FROM sd GROUP BY ALL)
SELECT cohort, contrast, round(avg(delta), 4) + 0.0 AS delta, round(coalesce(stddev_samp(delta), 0.0), 4) + 0.0 AS delta_seed_sd,
 count(*) AS n_seeds, max(n_subjects) AS n_subjects FROM st GROUP BY ALL""")
def seed_contrast_matrix(spark, d):
    rows = scoring.scoring_units(predictions(spark, d), ["cohort", "method", "seed"])
    pairs = contrasts.paired_units(rows, _specs(spark), ["cohort"], by_seed=True)
    return _round(contrasts.seed_contrasts(pairs, ["cohort", "contrast"]), ["delta", "delta_seed_sd"])


_SEEDED = """seeded AS (SELECT cohort, method, replicate AS seed, subject_id, measurement_id, y_true, y_pred * (1 + 0.01 * replicate) AS y_pred
 FROM units CROSS JOIN (SELECT unnest(range(3)) AS replicate) WHERE method = 'signal'
 UNION ALL SELECT cohort, method, s.seed, subject_id, measurement_id, y_true, y_pred FROM units
 CROSS JOIN (SELECT unnest(range(3)) AS seed) s WHERE method = 'covariates')"""


@query(f"""WITH {PRED}, {sql_units('cohort, method')}, {_SEEDED},
pairs AS (SELECT a.cohort, a.seed, a.subject_id, abs(a.y_pred - a.y_true) - abs(b.y_pred - a.y_true) AS delta
 FROM seeded a JOIN seeded b
 ON a.cohort = b.cohort AND a.seed = b.seed AND a.subject_id = b.subject_id AND a.measurement_id = b.measurement_id AND a.method = 'signal' AND b.method = 'covariates'),
sd AS (SELECT cohort, seed, subject_id, avg(delta) AS delta FROM pairs GROUP BY ALL),
st AS (SELECT cohort, seed, avg(delta) AS delta, count(*) AS n_subjects FROM sd GROUP BY cohort, seed),
tb AS (SELECT cohort, round(avg(delta), 4) + 0.0 AS delta, round(coalesce(stddev_samp(delta), 0.0), 4) + 0.0 AS delta_seed_sd,
 count(*) AS n_seeds, max(n_subjects) AS n_subjects FROM st GROUP BY cohort),
me AS (SELECT cohort, subject_id, avg(delta) AS delta FROM sd GROUP BY ALL), {sql_draws('cohort', 'me', REPLICATES, 'seed-contrast')},
rp AS (SELECT cohort, replicate, sum(delta * times) / sum(times) AS mean FROM me JOIN drawn USING (cohort, subject_id)
 GROUP BY ALL),
ci AS (SELECT cohort, round(quantile_cont(mean, 0.025), 4) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 4) + 0.0 AS ci_high,
 round(avg(CASE WHEN mean < 0 THEN 1.0 ELSE 0.0 END), 4) AS p_candidate_better FROM rp GROUP BY cohort)
SELECT cohort, 'seeded_vs_fixed' AS contrast, delta, delta_seed_sd, n_seeds, n_subjects, ci_low, ci_high, p_candidate_better
 FROM tb JOIN ci USING (cohort)""")
def seed_contrast_ci(spark, d):
    """A method of three seeds against one without seeds, whose units stand for every seed."""
    rows = scoring.scoring_units(predictions(spark, d), ["cohort", "method"])
    seeds = rows.where("method = 'signal'").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("y_pred", F.col("y_pred") * (1 + 0.01 * F.col("seed")))
    both = seeds.unionByName(rows.where("method = 'covariates'").withColumn("seed", F.lit(None).cast("int")))
    spec = spark.createDataFrame([("seeded_vs_fixed", "signal", "covariates")], "contrast string, candidate string, reference string")
    pairs = contrasts.paired_units(contrasts.over_seeds(both, ["covariates"], ["cohort"]), spec, ["cohort"], by_seed=True)
    made = contrasts.seed_contrasts_with_intervals(pairs, ["cohort"], ["cohort", "contrast"], REPLICATES)
    return _round(made, ["delta", "delta_seed_sd", "ci_low", "ci_high", "p_candidate_better"])


def _ci(names) -> str:
    return ", ".join(f"round(quantile_cont({m}, {q}), 4) + 0.0 AS {m}_ci_{n}" for m in names for n, q in (("low", 0.025), ("high", 0.975)))


_CI_METRICS = METRIC_NAMES


@query(f"""WITH {PRED}, {sql_units('cohort, method')}, {sql_moments('cohort, method', 'units')}, {sql_draws('cohort', 'moments', REPLICATES, 'boot')},
 md AS (SELECT * FROM moments JOIN drawn USING (cohort, subject_id)), {sql_metrics('cohort, method, replicate', 'md', 'many', 'times')} SELECT cohort, method, {_ci(_CI_METRICS)}
 FROM many GROUP BY cohort, method""")
def bootstrap_ci(spark, d):
    moments = written(scoring.subject_moments(scoring.scoring_units(predictions(spark, d), ["cohort", "method"]), ["cohort", "method"]), "moments")
    made = bootstrap.metric_intervals(moments, ["cohort"], ["cohort", "method"], REPLICATES, metrics=_CI_METRICS)
    return _round(made, [f"{m}_ci_{e}" for m in _CI_METRICS for e in ("low", "high")])


@query(f"""WITH {_DELTAS}, {sql_draws('cohort', 'deltas', REPLICATES, 'contrast')}, means AS (SELECT cohort, contrast, replicate, sum(delta * times) / sum(times) AS mean
 FROM deltas JOIN drawn USING (cohort, subject_id) GROUP BY ALL),
ci AS (SELECT cohort, contrast, round(quantile_cont(mean, 0.025), 4) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 4) + 0.0 AS ci_high,
 round(avg(CASE WHEN mean < 0 THEN 1.0 ELSE 0.0 END), 4) AS p_candidate_better FROM means GROUP BY ALL)
SELECT cohort, contrast, n_subjects, n_measurements, round(delta, 4) + 0.0 AS delta, ci_low, ci_high, p_candidate_better
 FROM ctab JOIN ci USING (cohort, contrast)""")
def paired_bootstrap_ci(spark, d):
    made = contrasts.contrasts_with_intervals(_paired(spark, d), ["cohort"], ["cohort", "contrast"], REPLICATES)
    return _round(made, ["delta", "ci_low", "ci_high", "p_candidate_better"])


_SEED_BOOT = f"""{_SEED_METRICS}, {sql_draws('cohort', 'moments', REPLICATES, 'seedboot')}, md AS (SELECT *
 FROM moments JOIN drawn USING (cohort, subject_id)), {sql_metrics('cohort, method, seed, replicate', 'md', 'many', 'times')},
 whole AS (SELECT cohort, method, replicate, {', '.join(f'CASE WHEN count({m}) = count(*) THEN avg({m}) END AS {m}' for m in _CI_METRICS)}
 FROM many GROUP BY cohort, method, replicate), sci AS (SELECT cohort, method, {_ci(_CI_METRICS)}
 FROM whole GROUP BY cohort, method)"""


def _seed_intervals(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = units(spark, d)
    moments = written(scoring.subject_moments(rows, ["cohort", "method", "seed"]), "moments")
    made = bootstrap.seed_mean_intervals(moments, ["cohort"], ["cohort", "method"], REPLICATES, seed="seedboot", metrics=_CI_METRICS)
    return moments, _round(made, [f"{m}_ci_{e}" for m in _CI_METRICS for e in ("low", "high")])


@query(f"WITH {_SEED_BOOT} SELECT * FROM sci")
def seed_bootstrap_ci(spark, d):
    return _seed_intervals(spark, d)[1]


@query(f"""WITH {_SEED_BOOT}, sm AS (SELECT cohort, method, {_SEED_MEANS}, max(n_subjects) AS n_subjects, max(n_measurements) AS n_measurements,
 count(*) AS n_seeds FROM metrics GROUP BY ALL) SELECT * FROM sm JOIN sci USING (cohort, method)""")
def benchmark_summary(spark, d):
    moments, intervals = _seed_intervals(spark, d)
    summary = scoring.seed_summary(scoring.metrics_of_moments(moments, ["cohort", "method", "seed"]), ["cohort", "method"])
    return _round(summary, [*METRIC_NAMES, *(f"{m}_seed_sd" for m in METRIC_NAMES)]).join(intervals, ["cohort", "method"])


#: Moments of subjects whose units are single lines: their sums are sums of cents, exact as decimals; spreads are shown as deviations and a slope.
_EXACT = ("abs_error", "error", "y", "p")


@query(f"""WITH {PRED}, lines AS (SELECT cohort, method, subject_id, y_true, y_pred FROM pred),
{sql_moments('cohort, method', 'lines')}, x AS (SELECT cohort, method, subject_id, {', '.join(f'CAST(sum(CAST({e} AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS {n}' for n, e in (('abs_error', 'abs(y_pred - y_true)'), ('error', 'y_pred - y_true'), ('y', 'y_true'), ('p', 'y_pred')))}
 FROM lines GROUP BY ALL),
n AS (SELECT cohort, subject_id, row_number() OVER (PARTITION BY cohort ORDER BY CAST(subject_id AS VARCHAR)) - 1 AS idx
 FROM (SELECT DISTINCT cohort, subject_id FROM moments))
SELECT cohort, method, subject_id, CAST(idx AS INTEGER) AS idx, {', '.join(f'x.{m} AS {m}' for m in _EXACT)}, round(sqrt(m.square_error), 2) AS rms_error, round(sqrt(var_y), 2) AS sd_y,
 round(sqrt(var_p), 2) AS sd_p, round(cov / nullif(sqrt(var_y * var_p), 0), 6) AS correlation, n_units
FROM moments m JOIN x USING (cohort, method, subject_id) JOIN n USING (cohort, subject_id)""")
def subject_moments(spark, d):
    lines = predictions(spark, d)
    moments = scoring.subject_moments(lines, ["cohort", "method"])
    index = bootstrap.indexed(moments, ["cohort"]).select("cohort", "subject_id", "idx")
    # means of doubles differ in their last digits from engine to engine; a mean of cents is shown as the double next to it
    cents = {m: (F.round(F.col(m) * F.col("n_units"), 3).cast("decimal(28, 3)").cast("double") / F.col("n_units")) for m in _EXACT}
    spreads = {"rms_error": F.round(F.sqrt("square_error"), 2), "sd_y": F.round(F.sqrt("var_y"), 2), "sd_p": F.round(F.sqrt("var_p"), 2), "correlation": F.round(F.col("cov") / F.nullif(F.sqrt(F.col("var_y") * F.col("var_p")), F.lit(0.0)), 6)}
    shown = moments.select("cohort", "method", "subject_id", *(c.alias(n) for n, c in {**cents, **spreads}.items()), "n_units")
    return shown.join(index, ["cohort", "subject_id"])
