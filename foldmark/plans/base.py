"""What the registered queries have in common: tables, the prediction view, and pieces of the comparison SQL.

Mapping: cohort = region key of the customer's nation, subject = customer, measurement = order, segment = line; three methods predict a line's price
from part price and quantity; a line's seed is its number modulo 3 and a subject's fold its key modulo 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bootstrap import DRAWS, LIMITS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that it is compared with."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Lines that are dealt to a task before each becomes a row of every method.
LINES = 1 << 18

METRIC_NAMES = ("mae", "rmse", "bias", "error_std", "r2", "correlation", "calibration_slope", "calibration_intercept")


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """(cohort, subject_id, acctbal, segment)"""
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("cohort"))
    return table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("cohort", F.col("c_custkey").alias("subject_id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(cohort, subject_id, measurement_id, segment_id, seed, fold, y_true, method, y_pred), a subject's rows in one task, LINES lines on average in a task.

    Units, moments and pairs are grouped in the task that the rows are dealt to, so their hash tables are as large as a task's rows. Shuffles sized by the
    lines' compressed bytes leave millions of them in a task, each three rows when the methods are made; so lines are dealt out by number, the methods last.
    """
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    priced = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-line.count() // LINES))  # Parquet's footers tell the number
    rows = priced.repartition(tasks, "o_custkey").join(subjects(spark, d).select("cohort", "subject_id"), F.col("o_custkey") == F.col("subject_id"))
    signal, covariates = F.col("p_retailprice") * F.col("l_quantity"), 1500.0 * F.col("l_quantity")
    made = F.explode(F.create_map(F.lit("signal"), signal, F.lit("covariates"), covariates, F.lit("signal_plus"), 0.5 * (signal + covariates))).alias("method", "y_pred")
    return rows.select("cohort", "subject_id", F.col("o_orderkey").alias("measurement_id"), F.col("l_linenumber").alias("segment_id"), (F.col("l_linenumber") % 3).alias("seed"), (F.col("subject_id") % 5).cast("int").alias("fold"), F.col("l_extendedprice").alias("y_true"), made)


PRED = """pred AS (SELECT n.n_regionkey AS cohort, o.o_custkey AS subject_id, o.o_orderkey AS measurement_id, l.l_linenumber AS segment_id, l.l_linenumber % 3 AS seed,
 CAST(o.o_custkey % 5 AS INTEGER) AS fold, l.l_extendedprice AS y_true, m.method,
 CASE m.method WHEN 'signal' THEN p.p_retailprice * l.l_quantity WHEN 'covariates' THEN 1500.0 * l.l_quantity ELSE 0.5 * (p.p_retailprice * l.l_quantity + 1500.0 * l.l_quantity) END AS y_pred
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
 JOIN part p ON l.l_partkey = p.p_partkey CROSS JOIN (VALUES ('signal'), ('covariates'), ('signal_plus')) m(method))"""
SUBJECTS = """subjects AS (SELECT n.n_regionkey AS cohort, c.c_custkey AS subject_id, c.c_acctbal AS acctbal, c.c_mktsegment AS segment
 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def sql_units(keys: str, name: str = "units") -> str:
    return f"""{name} AS (SELECT {keys}, subject_id, measurement_id, avg(y_true) AS y_true, avg(y_pred) AS y_pred,
 count(*) AS n_segments FROM pred GROUP BY ALL)"""


def sql_moments(keys: str, source: str, name: str = "moments") -> str:
    return f"""{name} AS (SELECT {keys}, subject_id, avg(abs(y_pred - y_true)) AS abs_error, avg((y_pred - y_true) * (y_pred - y_true)) AS square_error, avg(y_pred - y_true) AS error,
 avg(y_true) AS y, avg(y_pred) AS p, var_pop(y_true) AS var_y, var_pop(y_pred) AS var_p, covar_pop(y_true, y_pred) AS cov,
 count(*) AS n_units FROM {source} GROUP BY ALL)"""


def sql_metrics(keys: str, source: str, name: str = "metrics", weight: str | None = None) -> str:
    mean = lambda c: f"avg({c})" if weight is None else f"sum({c} * {weight}) / sum({weight})"
    means = ", ".join(f"{mean(c)} AS {c}" for c in ("abs_error", "square_error", "error", "y", "p"))
    second = {"vy": ("var_y", "y", "y"), "vp": ("var_p", "p", "p"), "cov": ("cov", "y", "p")}
    spreads = ", ".join((f"avg({v}) + covar_pop({a}, {b}) AS {n}" if weight is None else f"{mean(f'({v} + {a} * {b})')} - {mean(a)} * {mean(b)} AS {n}") for n, (v, a, b) in second.items())
    count = "count(*)" if weight is None else f"sum({weight})"
    return f"""{name} AS (SELECT {keys}, CAST(n_subjects AS BIGINT) AS n_subjects, CAST(n_measurements AS BIGINT) AS n_measurements, abs_error AS mae, sqrt(square_error) AS rmse, error AS bias, sqrt(greatest(0.0, square_error - error * error)) AS error_std,
 1 - square_error / nullif(vy, 0) AS r2, cov / sqrt(nullif(vy * vp, 0)) AS correlation, cov / nullif(vp, 0) AS calibration_slope, y - cov / nullif(vp, 0) * p AS calibration_intercept
 FROM (SELECT {keys}, {means}, {spreads}, {count} AS n_subjects, sum(n_units) AS n_measurements FROM {source} GROUP BY {keys}))"""


def sql_key(seed: str, *parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)]) + "), 1, 12))::BIGINT"


def sql_round(names, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def sql_draws(group: str, source: str, replicates: int, seed: str) -> str:
    """CTEs ids, keyed and drawn: how often each replicate draws each subject; a digest of a subject's stream serves DRAWS replicates."""
    digest = "md5(" + " || '|' || ".join([f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in [*group.split(", "), "subject_id", f"replicate // {DRAWS}"])]) + ")"
    width = 32 // DRAWS
    times = " + ".join(f"CAST(k >= {limit} AS INTEGER)" for limit in LIMITS)
    return f"""ids AS (SELECT DISTINCT {group}, subject_id FROM {source}),
 keyed AS (SELECT *, ('0x' || substr({digest}, 1 + {width} * (replicate % {DRAWS}), {width}))::BIGINT AS k
 FROM ids CROSS JOIN (SELECT unnest(range({replicates})) AS replicate)),
 drawn AS (SELECT {group}, replicate, subject_id, {times} AS times FROM keyed WHERE k >= {LIMITS[0]})"""
