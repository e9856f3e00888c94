"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule decides.

A rule fits its host and all subdomains of it where the URL's path starts with the rule's; of several the longest decides. The
labelled URLs are those that the rules decide (block is 1), each once, and the trees learn from a bounded sample of them (a hash of the URL
chooses): lengths, depth, shares of digits and signs, entropy, counts of parameters, and how often URLs with the same suffix (last label, last two
labels, first folder) are blocked, smoothed. One half of the sample gives these shares, the other half trains the trees, so no URL's own label is in
its features. A URL that no rule fits is blocked where the trees give BLOCK_FROM or more.

Edge cases: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by the trees on empty features; without labelled URLs of
both kinds everything else gets the one label there is, or allow; rows with a null page_id are kept; repeated rows get equal
results; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from urllib.parse import parse_qsl

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, trees

#: (action, host and path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LABELLED, BLOCK_FROM = 20_000, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty where there is none."""
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (url and others) with host, path, rule and action, the last two null where no rule fits."""
    parts = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried last and wins
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return parts.withColumn("rule", rule).withColumn("action", action)


def suffixes(host: str, path: str) -> list[str]:
    labels = host.split(".")
    folder = path.split("/")[1] if path.count("/") > 1 else ""
    return [f"1:{labels[-1]}", f"2:{'.'.join(labels[-2:])}", f"f:{folder}", f"h:{labels[0] if len(labels) > 2 else ''}"]


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def features_of(url: str, host: str, path: str, shares: dict[str, float], prior: float) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    digits, signs = sum(c.isdigit() for c in url), sum(not c.isalnum() for c in url)
    size = max(1, len(url))
    return [len(url), len(host), len(path), host.count("."), path.count("/"), digits / size, sum(c.isdigit() for c in host) / max(1, len(host)), signs / size, host.count("-"), _entropy(url), _entropy(host), len(parse_qsl(query, keep_blank_values=True)), len(query), float("#" in url), float(url.startswith("https")), float("@" in url), max(map(len, host.split("."))), *(shares.get(s, prior) for s in suffixes(host, path))]


def _suffix_rows(batches):
    for batch in batches:
        rows = [(s, label) for h, p, label in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "label")), strict=True) for s in suffixes(h, p)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["suffix", "label"])


def judged(pages: DataFrame, rules=RULES, id_column: str = "page_id", labelled: int = LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each page; score is the trees' probability of block."""
    rows = ruled(pages.select(F.col(id_column).cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), rules)
    label = F.when(F.col("action") == "block", 1.0).when(F.col("action") == "allow", 0.0)
    decided = common.written(rows.where("action is not null").select("url", "host", "path", label.alias("label")).distinct(), "decided-urls")
    known = common.written(common.bounded(decided, labelled, F.col("url")).withColumn("half", F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2))), "labelled-urls")
    prior = known.agg(F.avg("label")).first()[0]
    prior = 0.0 if prior is None else float(prior)
    counted = known.where("half = 0").mapInArrow(_suffix_rows, "suffix string, label double").groupBy("suffix").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    shares = {x["suffix"]: (x["bad"] + 2 * prior) / (x["n"] + 2) for x in counted.collect()}  # four for each labelled URL at most

    def run(batches):
        for batch in batches:
            made = [features_of(u or "", h, p, shares, prior) for u, h, p in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[float(x) for x in m] for m in made], pa.list_(pa.float64()))], [*batch.schema.names, "features"])

    model = trees.fit(common.written(known.where("half = 1").drop("half").mapInArrow(run, "url string, host string, path string, label double, features array<double>").select("features", "label"), "train-urls"))
    made = rows.mapInArrow(run, "page_id long, url string, host string, path string, rule string, action string, features array<double>")
    scored = trees.probability(model, made, prior)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("raw") >= BLOCK_FROM, "block").otherwise("allow")).alias("verdict"), F.col("raw").alias("score"))
