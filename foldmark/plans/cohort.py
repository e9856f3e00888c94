"""Queries on cohort preparation: manifests, joins, sampling, splits, sessions, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import fingerprints, rounded
from ..operators import manifest, reports, rules, sampling, scoring, sessions, table_functions
from .base import SUBJECTS, query, sql_key, subjects, table

# ---- manifests


def raw_manifest(spark, d) -> DataFrame:
    """Lines as segments, with the untidy values that canonical_manifest() tidies."""
    line = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    who = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("c_custkey")
    sex = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "F").when(F.col("c_mktsegment") == "BUILDING", " male ").when(F.col("c_mktsegment") == "FURNITURE", "0").when(F.col("c_mktsegment") == "HOUSEHOLD", "x")
    pressure = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" / "), (F.col("l_linenumber") * 7).cast("string"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("segment_id"), k.cast("string").alias("subject_id"), F.when(F.col("l_linenumber") % 4 != 0, F.col("o_orderkey").cast("string")).alias("measurement_id"),
        F.concat(F.lit("p/"), F.col("l_orderkey"), F.when(F.col("l_linenumber") % 2 == 0, ".NPY").otherwise("")).alias("waveform_path"), F.lit("125").alias("sample_rate_hz"), F.col("l_quantity").cast("string").alias("n_samples"),
        X.number_pair(pressure, True).alias("sbp"), X.number_pair(pressure, False).alias("dbp"), sex.alias("sex"), F.when(k % 7 == 0, "n/a").otherwise((20 + k % 60).cast("string")).alias("age"),
        F.when(k % 3 != 0, 18.0 + k % 20).alias("bmi"), F.when(k % 11 == 0, 0).otherwise(150 + k % 50).alias("height_cm"), (50 + k % 60).alias("weight_kg"), F.when(F.col("l_linenumber") % 5 == 0, "FALSE").when(F.col("l_linenumber") % 5 == 1, "True").alias("valid_for_analysis"),
    )


_RAW = """raw AS (SELECT l.l_orderkey || '-' || l.l_linenumber AS segment_id, CAST(c.c_custkey AS VARCHAR) AS subject_id,
 CASE WHEN l.l_linenumber % 4 <> 0 THEN CAST(o.o_orderkey AS VARCHAR) END AS measurement_id,
 CASE WHEN l.l_linenumber % 2 = 0 THEN 'npy' ELSE 'text' END AS waveform_format, 125.0 AS sample_rate_hz, l.l_quantity AS n_samples, CAST(CAST(trunc(l.l_quantity) AS INTEGER) AS DOUBLE) AS sbp, CAST(l.l_linenumber * 7 AS DOUBLE) AS dbp,
 CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'female' WHEN 'BUILDING' THEN 'male' WHEN 'FURNITURE' THEN 'female' WHEN 'HOUSEHOLD' THEN 'x' END AS sex,
 CASE WHEN c.c_custkey % 7 <> 0 THEN CAST(20 + c.c_custkey % 60 AS DOUBLE) END AS age,
 CASE WHEN c.c_custkey % 3 <> 0 THEN 18.0 + c.c_custkey % 20 WHEN c.c_custkey % 11 <> 0 THEN (50 + c.c_custkey % 60) / pow((150 + c.c_custkey % 50) / 100.0, 2) END AS bmi,
 l.l_linenumber % 5 <> 0 AS valid FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 JOIN customer c ON o.o_custkey = c.c_custkey)"""


@query(f"""WITH {_RAW} SELECT segment_id, subject_id, coalesce(measurement_id, subject_id) AS measurement_id, waveform_format, n_samples, sbp, dbp, sex, age,
 round(bmi, 4) AS bmi, valid AS valid_for_analysis, round(n_samples / sample_rate_hz, 6) AS seconds, concat_ws(';',
 CASE WHEN sbp <= dbp THEN 'targets' END, CASE WHEN age IS NULL THEN 'age' END, CASE WHEN NOT valid THEN 'invalid' END) AS reasons
 FROM raw""")
def manifest_canonical(spark, d):
    rows = manifest.canonical_manifest(raw_manifest(spark, d))
    why = X.reasons(targets=F.col("sbp") <= F.col("dbp"), age=F.col("age").isNull(), invalid=~F.col("valid_for_analysis"))
    return rows.select("segment_id", "subject_id", "measurement_id", "waveform_format", "n_samples", "sbp", "dbp", "sex", "age", rounded("bmi").alias("bmi"), "valid_for_analysis", F.round(F.col("n_samples") / F.col("sample_rate_hz"), 6).alias("seconds"), why.alias("reasons"))


@query(f"""WITH {_RAW}, v AS (SELECT * FROM raw WHERE valid) SELECT rule, count(*) AS n FROM (
SELECT 'segment_unique' AS rule FROM v GROUP BY segment_id HAVING count(*) > 1 UNION ALL SELECT 'category_known'
 FROM v WHERE sex = 'x' UNION ALL SELECT 'two_samples' FROM v WHERE n_samples < 2 UNION ALL SELECT 'targets_ordered'
 FROM v WHERE sbp <= dbp) GROUP BY rule""")
def manifest_violations(spark, d):
    rows = manifest.valid_rows(manifest.canonical_manifest(raw_manifest(spark, d)))
    return rules.manifest_violations(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, d.lang, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side, abs(d.n_chars - length(d.text)) AS difference
 FROM documents d LEFT JOIN (SELECT DISTINCT ON (doc_id) * FROM labels ORDER BY doc_id) l ON d.doc_id = l.doc_id""")
def annotation_left_join(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    only = manifest.key_differences(docs, labels, "doc_id").where("side = 'left_only'")
    joined = docs.join(reports.first_rows(labels, ["doc_id"], ["doc_id"]), "doc_id", "left").join(only, "doc_id", "left")
    return joined.select("doc_id", "lang", "quality", "toxic", F.coalesce("side", F.lit("both")).alias("side"), F.abs(F.col("n_chars") - F.char_length("text")).alias("difference"))


@query("""SELECT c.c_custkey AS custkey, lpad(CAST(c.c_custkey AS VARCHAR), CAST(greatest(6, length(CAST(c.c_custkey AS VARCHAR))) AS INTEGER), '0') AS padded, regexp_replace(CAST(c.c_custkey AS VARCHAR) || '.0', '\\.0+$', '') AS token,
 CASE c.c_nationkey % 2 WHEN 0 THEN 'ear' ELSE 'finger' END AS site,
 trim(regexp_replace(lower(c.c_mktsegment || ' / ' || n.n_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, coalesce(n.n_name, c.c_name) AS shown, 'S' || c.c_custkey || '-' || substr(c.c_mktsegment, 1, 3) AS label
 FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def id_and_token_normalise(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    key = F.col("c_custkey").cast("string")
    site = F.when(F.col("c_nationkey") % 2 == 0, "ear").otherwise("finger")
    return rows.select(F.col("c_custkey").alias("custkey"), X.padded_id(key, 6).alias("padded"), X.plain_token(F.concat(key, F.lit(".0"))).alias("token"), site.alias("site"), X.slug(F.concat_ws(" / ", "c_mktsegment", "n_name")).alias("slug"), F.coalesce(X.first_of(rows, ["absent", "n_name"]), F.col("c_name")).alias("shown"), F.concat(F.lit("S"), key, F.lit("-"), F.substring("c_mktsegment", 1, 3)).alias("label"))


@query(f"""WITH {SUBJECTS}, f AS (SELECT cohort, concat_ws('/', CASE WHEN count(acctbal) > 0 THEN 'balance' END,
 CASE WHEN count(CASE WHEN cohort % 2 = 0 THEN segment END) > 0 THEN 'segment' END) AS fields
 FROM subjects GROUP BY cohort)
SELECT f.cohort, CASE WHEN fields = '' THEN 'none' ELSE fields END AS fields, coalesce(CASE r.r_name WHEN 'ASIA' THEN 'overlap' WHEN 'EUROPE' THEN 'partial' END, 'none_known') AS overlap
 FROM f JOIN region r ON f.cohort = r.r_regionkey""")
def field_availability(spark, d):
    rows = subjects(spark, d).withColumn("segment", F.when(F.col("cohort") % 2 == 0, F.col("segment")))
    fields = manifest.available_fields(rows, ["cohort"], {"acctbal": "balance", "segment": "segment"})
    named = fields.join(table(spark, d, "region"), F.col("cohort") == F.col("r_regionkey"))
    registry = spark.createDataFrame([("ASIA", "overlap"), ("EUROPE", "partial")], "r_name string, overlap string")
    return manifest.lookup(named, F.broadcast(registry), ["r_name"], "overlap", "none_known").select("cohort", "fields", "overlap")  # two rows


@query(f"""WITH {SUBJECTS}, o AS (SELECT s.cohort, s.subject_id, o.o_orderkey AS measurement_id, l.l_linenumber AS line
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN subjects s ON o.o_custkey = s.subject_id),
m AS (SELECT cohort, subject_id, measurement_id, count(*) AS r FROM o GROUP BY ALL), s AS (SELECT cohort, subject_id,
 count(*) AS ms, sum(r) AS sr FROM m GROUP BY ALL), t AS (SELECT cohort, sum(sr) / count(*) AS sc
 FROM s GROUP BY cohort)
SELECT m.cohort, m.subject_id, m.measurement_id, r AS n_rows, round(1.0 / sr, 8) AS subject_weight,
 round(sc / (r * ms), 8) AS measurement_weight FROM m JOIN s USING (cohort, subject_id) JOIN t USING (cohort)""")
def balanced_weights(spark, d):
    line, orders = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(subjects(spark, d), F.col("o_custkey") == F.col("subject_id")).select("cohort", "subject_id", F.col("o_orderkey").alias("measurement_id"))
    made = scoring.balanced_weights(rows, ["cohort"])
    return made.groupBy("cohort", "subject_id", "measurement_id").agg(F.count("*").alias("n_rows"), F.round(F.max("subject_weight"), 8).alias("subject_weight"), F.round(F.max("measurement_weight"), 8).alias("measurement_weight"))


@query("""SELECT l_orderkey, l_returnflag, min(l_extendedprice) AS price, arg_min(l_quantity, struct_pack(a := l_extendedprice, b := l_quantity)) AS quantity
 FROM lineitem GROUP BY ALL""")
def label_units_dedup(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return reports.first_rows(rows, ["l_orderkey", "l_returnflag"], ["price", "quantity"])


# ---- sampling and splits


def _subject_rows(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(subjects(spark, d), F.col("o_custkey") == F.col("subject_id")).select("cohort", "subject_id", "acctbal", "segment", "o_orderkey", "o_totalprice")


def binned_subjects(spark, d) -> DataFrame:
    """(cohort, subject_id, segment, o_totalprice median, n_rows, acctbal, price_bin, acct_bin, stratum)"""
    tab = sampling.subject_table(_subject_rows(spark, d), ["cohort"], ["o_totalprice", "acctbal"], "segment", "o_orderkey")
    edges = sampling.quantile_edges(tab, ["cohort"], ["o_totalprice", "acctbal"], 4)
    out = tab.join(edges, "cohort").withColumn("price_bin", sampling.bin_of(F.col("o_totalprice"), F.col("edges_o_totalprice"))).withColumn("acct_bin", sampling.bin_of(F.col("acctbal"), F.col("edges_acctbal")))
    return out.drop("edges_o_totalprice", "edges_acctbal").withColumn("short", F.concat_ws("|", "segment", "price_bin")).withColumn("stratum", F.concat_ws("|", "segment", "price_bin", "acct_bin"))


_BINNED = f"""{SUBJECTS}, st AS (SELECT s.cohort, s.subject_id, any_value(s.segment) AS segment, quantile_cont(o.o_totalprice, 0.5) AS o_totalprice, any_value(s.acctbal) AS acctbal,
 count(*) AS n_rows FROM orders o JOIN subjects s ON o.o_custkey = s.subject_id GROUP BY s.cohort, s.subject_id),
ed AS (SELECT cohort, list_distinct(quantile_cont(o_totalprice, [0.25, 0.5, 0.75])) AS ep, list_distinct(quantile_cont(acctbal, [0.25, 0.5, 0.75])) AS ea
 FROM st GROUP BY cohort),
binned AS (SELECT *, segment || '|' || price_bin AS short, segment || '|' || price_bin || '|' || acct_bin AS stratum
 FROM (SELECT st.*, CAST(len(list_filter(ep, lambda e: e < o_totalprice)) AS INTEGER) AS price_bin, CAST(len(list_filter(ea, lambda e: e < acctbal)) AS INTEGER) AS acct_bin
 FROM st JOIN ed USING (cohort)))"""


@query(f"WITH {_BINNED} SELECT cohort, subject_id, segment, round(o_totalprice, 4) AS o_totalprice, n_rows, price_bin, acct_bin, stratum FROM binned")
def subject_table_bins(spark, d):
    return binned_subjects(spark, d).select("cohort", "subject_id", "segment", rounded("o_totalprice").alias("o_totalprice"), "n_rows", "price_bin", "acct_bin", "stratum")


@query(f"""WITH {_BINNED}, el AS (SELECT subject_id, stratum FROM binned WHERE n_rows >= 2), sz AS (SELECT stratum, count(*) AS n FROM el GROUP BY stratum),
al AS (SELECT stratum, n, n * (120.0::DOUBLE / (SELECT sum(n) FROM sz)::DOUBLE) AS ideal, (SELECT count(*) FROM sz) AS strata FROM sz),
a0 AS (SELECT *, CASE WHEN floor(ideal) = 0 AND strata <= 120 THEN 1 ELSE CAST(floor(ideal) AS BIGINT) END AS first FROM al),
ov AS (SELECT CAST(sum(first) - 120 AS BIGINT) AS over FROM a0),
mv AS (SELECT stratum, -1 AS change, ideal - first + step AS rank FROM a0, ov, unnest(range(greatest(0, least(first - 1, over)))) u(step) WHERE over > 0
 UNION ALL SELECT stratum, 1, first - ideal FROM a0, ov WHERE over < 0 AND first < n),
ch AS (SELECT stratum, sum(change) AS change FROM (SELECT *, row_number() OVER (ORDER BY rank, stratum) AS p FROM mv) WHERE p <= (SELECT abs(over) FROM ov) GROUP BY stratum),
qu AS (SELECT a0.stratum, first + coalesce(change, 0) AS quota FROM a0 LEFT JOIN ch USING (stratum)),
pl AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {sql_key('20260715', 'subject_id')}, subject_id) AS p FROM el)
SELECT subject_id, stratum FROM pl JOIN qu USING (stratum) WHERE p <= quota""")
def stratified_sample(spark, d):
    rows = binned_subjects(spark, d)
    return sampling.stratified_sample(rows, "stratum", 120, "20260715", F.col("n_rows") >= 2).select("subject_id", "stratum")


_FOLDED = f"""{_BINNED}, pl AS (SELECT *, row_number() OVER (ORDER BY stratum, {sql_key('11', 'subject_id')}, subject_id) AS place
 FROM binned), tf AS (SELECT *, CAST((place - 1) % 5 AS INTEGER) AS test_fold FROM pl),
ea2 AS (SELECT tf.*, CAST(f.fold AS INTEGER) AS fold FROM tf CROSS JOIN range(5) f(fold)), vp AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY short, ('0x' || substr(md5(CAST(11 + fold AS VARCHAR) || '|' || CAST(subject_id AS VARCHAR)), 1, 12))::BIGINT, subject_id) AS p
 FROM ea2 WHERE fold <> test_fold),
splits AS (SELECT subject_id, fold, CASE WHEN (p + 4) // 5 > (p + 3) // 5 THEN 'validation' ELSE 'train' END AS role
 FROM vp UNION ALL SELECT subject_id, fold, 'test' FROM ea2 WHERE fold = test_fold)"""


def _splits(spark, d) -> DataFrame:
    return sampling.split_manifest(binned_subjects(spark, d), "stratum", "short", 5, 11)


@query(f"WITH {_FOLDED} SELECT subject_id, fold, role, 11 AS split_seed, 'stratum' AS outer_method, 'short' AS validation_method FROM splits")
def splits_manifest(spark, d):
    return _splits(spark, d).drop("dataset_fingerprint")


#: Strata from full to short, of which benchmark_splits takes the first that the subjects allow.
_LABELS = ("stratum", "short", "segment")
_PICK = lambda m: f"CASE {m} " + " ".join(f"WHEN '{x}' THEN {x}" for x in _LABELS) + " ELSE '' END"


@query(f"""WITH {_BINNED}, o AS (SELECT CASE {' '.join(f"WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM binned GROUP BY {x})) >= 5 THEN '{x}'" for x in _LABELS)} ELSE 'none' END AS om),
pl AS (SELECT *, row_number() OVER (ORDER BY {_PICK('om')}, {sql_key('11', 'subject_id')}, subject_id) AS place FROM binned, o), tf AS (SELECT *, CAST((place - 1) % 5 AS INTEGER) AS test_fold FROM pl),
lc AS ({' UNION ALL '.join(f"SELECT '{x}' AS l, {k} AS rank, {x} AS v, test_fold, count(*) AS n FROM tf GROUP BY ALL" for k, x in enumerate(_LABELS))}),
ok AS (SELECT l, rank FROM (SELECT *, sum(n) OVER (PARTITION BY l, v) AS total FROM lc) GROUP BY l, rank HAVING min(total) >= 2 AND coalesce(min(CASE WHEN total > n THEN total - n END), 2) >= 2),
im AS (SELECT coalesce((SELECT l FROM ok ORDER BY rank LIMIT 1), 'none') AS im), ea2 AS (SELECT tf.*, im, CAST(f.fold AS INTEGER) AS fold FROM tf, im, range(5) f(fold)),
vp AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {_PICK('im')}, ('0x' || substr(md5(CAST(11 + fold AS VARCHAR) || '|' || CAST(subject_id AS VARCHAR)), 1, 12))::BIGINT, subject_id) AS p FROM ea2 WHERE fold <> test_fold)
SELECT subject_id, fold, CASE WHEN (p + 4) // 5 > (p + 3) // 5 THEN 'validation' ELSE 'train' END AS role, om AS outer_method, im AS validation_method FROM vp
 UNION ALL SELECT subject_id, fold, 'test', om, im FROM ea2 WHERE fold = test_fold""")
def benchmark_splits(spark, d):
    """Splits whose strata are the fullest that the subjects allow."""
    made = sampling.benchmark_splits(binned_subjects(spark, d), list(_LABELS), 5, 11)
    return made.select("subject_id", "fold", "role", "outer_method", "validation_method")


@query(f"""WITH {_FOLDED}, tr AS (SELECT subject_id FROM splits WHERE fold = 0 AND role = 'train'),
 va AS (SELECT subject_id FROM splits WHERE fold = 0 AND role = 'validation') SELECT c.c_mktsegment AS segment,
 count(*) FILTER (c_custkey IN (SELECT subject_id FROM tr)) AS n_train, count(*) FILTER (c_custkey IN (SELECT subject_id
 FROM tr UNION SELECT subject_id FROM va)) AS n_fit, count(*) FILTER (c_custkey NOT IN (SELECT subject_id
 FROM splits)) AS n_unsplit FROM customer c GROUP BY ALL""")
def semi_anti_roles(spark, d):
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"))
    splits = _splits(spark, d)
    train, validation = (sampling.rows_for_role(who, splits, 0, r) for r in ("train", "validation"))
    fit = train.unionByName(validation).dropDuplicates(["subject_id"])
    counted = lambda df, n: df.groupBy("segment").agg(F.count("*").alias(n))
    out = who.select("segment").distinct()
    for df, n in ((train, "n_train"), (fit, "n_fit"), (who.join(splits, "subject_id", "left_anti"), "n_unsplit")):
        out = out.join(counted(df, n), "segment", "left").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))
    return out


@query(f"""WITH {SUBJECTS}, g AS (SELECT s.cohort, s.subject_id, count(*) AS n_rows FROM orders o
 JOIN subjects s ON o.o_custkey = s.subject_id GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY n_rows DESC, subject_id) - 1 AS p, least(3,
 count(*) OVER (PARTITION BY cohort)) AS k FROM g)
SELECT cohort, subject_id, n_rows, CAST(CASE WHEN (p // k) % 2 = 0 THEN p % k ELSE k - 1 - p % k END AS INTEGER) AS inner_fold
 FROM p""")
def group_folds(spark, d):
    return sampling.group_folds(_subject_rows(spark, d), ["cohort"], "subject_id", 3)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {sql_key('cap|1', 'o_orderkey')}, o_orderkey) AS p
 FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE p <= 5""")
def seeded_cap(spark, d):
    return sampling.capped(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 5, "cap", 1)


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY {sql_key('turn', 'o_orderkey')}, o_orderkey) AS turn
 FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY turn, o_orderpriority, o_orderkey) AS p
 FROM t) SELECT o_custkey, o_orderpriority, o_orderkey FROM p WHERE p <= 6""")
def balanced_cap(spark, d):
    return sampling.round_robin_capped(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], "o_orderpriority", ["o_orderkey"], 6, "turn")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, o_orderkey
 FROM p WHERE n <= 4 OR p IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1)""")
def even_spaced_pick(spark, d):
    return sampling.evenly_spaced(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)


@query("""WITH s AS (SELECT o_custkey AS subject_id, quantile_cont(o_totalprice, 0.5) AS median_price,
 count(*) FILTER (o_orderstatus <> 'P') AS eligible, list_sort(list(o_orderkey) FILTER (o_orderstatus <> 'P')) AS ids
 FROM orders GROUP BY o_custkey) SELECT subject_id, round(median_price, 4) AS median_price, eligible, CAST(ids AS VARCHAR) AS ids
 FROM s WHERE eligible >= 2""")
def subject_scan_summary(spark, d):
    made = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject_id")).agg(F.percentile("o_totalprice", F.lit(0.5)).alias("m"), F.count_if(F.col("o_orderstatus") != "P").alias("eligible"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")))).alias("k"))
    return made.where("eligible >= 2").select("subject_id", rounded("m").alias("median_price"), "eligible", F.concat(F.lit("["), F.concat_ws(", ", F.col("k").cast("array<string>")), F.lit("]")).alias("ids"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p,
 count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, count(*) AS n_lines, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity
 FROM p JOIN lineitem ON l_orderkey = o_orderkey WHERE n <= 2 OR p IN (0, n - 1) GROUP BY o_custkey""")
def selected_segments(spark, d):
    picked = sampling.evenly_spaced(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 2)
    stored = picked.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list("o_orderkey"))).alias("chosen"))
    chosen = stored.select("o_custkey", F.explode(F.from_json("chosen", "array<bigint>")).alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity").join(chosen, "l_orderkey").groupBy("o_custkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# ---- fingerprints

_SPELT = "octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR)"
_FP = f"""nt AS (SELECT *, printf('%.11e', c_acctbal) AS e FROM customer),
nn AS (SELECT *, CASE WHEN c_acctbal = 0 THEN '0' ELSE regexp_replace(regexp_replace(split_part(e, 'e', 1), '0+$', ''), '[.]$', '')
 || CASE WHEN CAST(split_part(e, 'e', 2) AS INTEGER) <> 0 THEN 'e' || CAST(split_part(e, 'e', 2) AS INTEGER) ELSE '' END END AS bal FROM nt),
dg AS (SELECT sha256({_SPELT.format('c_custkey')} || '|' || {_SPELT.format('c_mktsegment')} || '|' || {_SPELT.format('bal')}) AS d FROM nn),
dn AS (SELECT d, d || '*' || count(*) AS x FROM dg GROUP BY d),
bk AS (SELECT substr(d, 1, 2) AS b, sha256(string_agg(x, ',' ORDER BY x)) AS d FROM dn GROUP BY 1),
fp AS (SELECT sha256(string_agg(b || ':' || d, ',' ORDER BY b)) AS fingerprint FROM bk)"""


@query(f"WITH {_FP} SELECT fingerprint FROM fp")
def fingerprint(spark, d):
    return fingerprints.fingerprint(table(spark, d, "customer"), F.col("c_custkey"), F.col("c_mktsegment"), X.number_text("c_acctbal"))


@query(f"WITH {_FOLDED}, {_FP} SELECT subject_id, fold, role, fingerprint AS dataset_fingerprint FROM splits CROSS JOIN fp")
def refresh_fingerprint(spark, d):
    made = fingerprint(spark, d).first()[0]  # one row
    return sampling.refreshed(_splits(spark, d), made).select("subject_id", "fold", "role", "dataset_fingerprint")


# ---- ordered records


def _ordered_events(spark, d) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return events.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


_EVENTS = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(f"""WITH {_EVENTS}, types AS (SELECT min(event_type) AS t FROM events),
mk AS (SELECT *, event_type = (SELECT t FROM types) AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY n) <> (SELECT t
 FROM types), true) AS onset FROM ev),
b AS (SELECT user_id, min(n) AS lo, max(n) AS hi FROM mk GROUP BY user_id),
s0 AS (SELECT user_id, lo AS s FROM b UNION SELECT m.user_id, m.n - 2 FROM mk m JOIN b USING (user_id)
 WHERE onset AND m.n - 2 >= lo),
l AS (SELECT user_id, max(s) AS last FROM s0 GROUP BY user_id),
st AS (SELECT user_id, s FROM s0 UNION SELECT user_id, unnest(range(last, greatest(last, hi) + 1, 7))
 FROM l JOIN b USING (user_id)),
j AS (SELECT m.user_id, m.event_id, m.n, count(*) AS session_index, max(s) AS s FROM mk m JOIN st ON m.user_id = st.user_id AND st.s <= m.n
 GROUP BY ALL)
SELECT user_id, event_id, CAST(session_index AS INTEGER) AS session_index, CAST(n - s + 1 AS INTEGER) AS session_position,
 user_id || '-session-' || CASE WHEN session_index < 10 THEN '0' ELSE '' END || session_index AS session_id
 FROM j""")
def session_derivation(spark, d):
    rows = _ordered_events(spark, d)
    token = rows.agg(F.min("event_type")).first()[0]
    marked = sessions.onsets(rows, ["user_id"], "n", F.col("event_type") == token)
    return sessions.derived_sessions(marked, ["user_id"], "n", 7, 3).select("user_id", "event_id", "session_index", "session_position", "session_id")


@query(f"""WITH {_EVENTS}, types AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events),
 w AS (SELECT *, last_value(CASE WHEN event_type = (SELECT b FROM types) THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_value, first_value(CASE WHEN event_type = (SELECT b
 FROM types) THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_value
 FROM ev) SELECT user_id, event_id, previous_value, next_value FROM w WHERE event_type = (SELECT a
 FROM types)""")
def nearest_prev_next(spark, d):
    rows = _ordered_events(spark, d)
    here, mark = rows.agg(F.min("event_type"), F.max("event_type")).first()
    return sessions.nearest(rows, ["user_id"], ["n"], F.col("event_type") == here, F.col("event_type") == mark, "value").select("user_id", "event_id", "previous_value", "next_value")


@query(f"""WITH {_EVENTS}, a AS (SELECT user_id, n, value, min(value) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lv
 FROM ev), b AS (SELECT *, max(CASE WHEN lv IS NULL OR value < lv THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS li
 FROM a),
c AS (SELECT *, min(CASE WHEN n - li >= 8 THEN n END) OVER (PARTITION BY user_id) AS st FROM b),
 s AS (SELECT * FROM c WHERE st IS NULL OR n <= st), e AS (SELECT user_id, arg_min(n, struct_pack(v := value, n := n)) AS best_epoch, min(value) AS best_score, max(n) AS stopped_epoch
 FROM s GROUP BY user_id),
g AS (SELECT user_id % 10 AS grp, arg_min(user_id, struct_pack(s := best_score, u := user_id)) AS chosen
 FROM e GROUP BY 1)
SELECT e.user_id, CAST(best_epoch AS INTEGER) AS best_epoch, round(best_score, 6) AS best_score, CAST(stopped_epoch AS INTEGER) AS stopped_epoch, e.user_id = g.chosen AS chosen
 FROM e JOIN g ON e.user_id % 10 = g.grp""")
def epoch_selection(spark, d):
    epochs = sessions.selected_epochs(_ordered_events(spark, d), ["user_id"], "n", "value", 8).withColumn("grp", F.col("user_id") % 10)
    rates = sessions.selected_rate(epochs, ["grp"], "user_id").select("grp", F.col("user_id").alias("rate"))
    return epochs.join(rates, "grp").select("user_id", "best_epoch", F.round("best_score", 6).alias("best_score"), "stopped_epoch", (F.col("user_id") == F.col("rate")).alias("chosen"))


@query("""WITH g AS (SELECT user_id, event_id, epoch(ts) AS sec, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 3600 THEN 0 ELSE 1 END AS opens
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts), event_id)), n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS session_index FROM g)
SELECT user_id, event_id, CAST(session_index AS BIGINT) AS session_index, row_number() OVER (PARTITION BY user_id, session_index ORDER BY sec, event_id) AS session_position FROM n""")
def gap_sessions(spark, d):
    """Sessions that end at a gap of an hour, by the registered table function."""
    table_functions.register(spark)
    table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at")).createOrReplaceTempView("events_at")
    made = spark.sql("SELECT * FROM gap_sessions(TABLE(SELECT user_id, event_id, at FROM events_at) PARTITION BY user_id ORDER BY (at, event_id), 'at', 3600)")
    return made.select("user_id", "event_id", "session_index", "session_position")
