"""Array-valued records (segment_id, rate, samples): statistics and steps as SQL on arrays, and a user's encoder as one Arrow job."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import carried, exact_quantiles, numbered_from


def _is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _sum(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))


def _power_sums(x: Column) -> Column:
    """struct<n, first, s1 .. s4>: sums of powers of the differences to the first value, in one pass; so large levels cost no precision."""
    first = F.get(x, F.lit(0)).cast("double")
    zero = F.struct(F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"), F.lit(0.0).alias("s3"), F.lit(0.0).alias("s4"))
    pairs = F.arrays_zip(x.alias("v"), F.array_repeat(first, F.size(x)).alias("f"))

    def add(s: Column, p: Column) -> Column:
        d = p["v"] - p["f"]
        return F.struct((s["s1"] + d).alias("s1"), (s["s2"] + d * d).alias("s2"), (s["s3"] + d * d * d).alias("s3"), (s["s4"] + d * d * d * d).alias("s4"))

    return F.aggregate(pairs, zero, add, lambda s: F.struct(F.size(x).cast("double").alias("n"), first.alias("first"), s["s1"].alias("s1"), s["s2"].alias("s2"), s["s3"].alias("s3"), s["s4"].alias("s4")))


def moments_of(x: Column) -> Column:
    """struct<n, mean, variance, m3, m4>: number, mean and central moments of an array, each null for an empty one."""
    # an array of one struct: what is made of it is computed once, not wherever it is used
    def central(p: Column) -> Column:
        n = F.nullif(p["n"], F.lit(0.0))
        a, b, c, d = (p[k] / n for k in ("s1", "s2", "s3", "s4"))
        return F.struct(p["n"].alias("n"), (p["first"] + a).alias("mean"), F.greatest(F.lit(0.0), b - a * a).alias("variance"), (c - 3 * a * b + 2 * a * a * a).alias("m3"), (d - 4 * a * c + 6 * a * a * b - 3 * a * a * a * a).alias("m4"))

    return F.get(F.transform(F.array(_power_sums(x)), central), F.lit(0))


def differences(x: Column) -> Column:
    """x[i + 1] - x[i]; empty for fewer than two."""
    n = F.size(x)
    return F.when(n > 1, F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(1))), F.slice(x, 1, F.greatest(n - 1, F.lit(1))), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def quantile_of(x: Column, q: float) -> Column:
    """The linear quantile of an array, sorted once."""
    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * q
        low = F.floor(place).cast("int")
        return F.get(s, low) + (place - low) * (F.coalesce(F.get(s, low + 1), F.get(s, low)) - F.get(s, low))

    return F.get(F.transform(F.array(F.array_sort(x)), at), F.lit(0))


def statistics(x: Column) -> dict[str, Column]:
    """Mean, population deviation, range, quartile range, and bias-corrected skewness and excess kurtosis (null where undefined)."""
    def shape(m: Column) -> Column:
        n, s = m["n"], F.sqrt(m["variance"])
        some = F.when(s > 1e-12, s)
        skew = F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * m["m3"] / (some * some * some))
        excess = m["m4"] / (some * some * some * some) - 3
        kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * excess + 6))
        return F.struct(m["mean"].alias("mean"), s.alias("std"), skew.alias("skew"), kurt.alias("kurtosis"))

    made = F.get(F.transform(F.array(moments_of(x)), shape), F.lit(0))
    return {"mean": made["mean"], "std": made["std"], "range": F.array_max(x) - F.array_min(x), "iqr": quantile_of(x, 0.75) - quantile_of(x, 0.25), "skew": made["skew"], "kurtosis": made["kurtosis"]}


def quality(x: Column) -> dict[str, Column]:
    """Share of finite samples, share of equal neighbours, and the reasons against a record."""
    finite = F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    steps = differences(finite)
    share = F.size(finite) / F.when(F.size(x) > 0, F.size(x))
    flat = F.size(F.filter(steps, lambda v: v == 0)) / F.when(F.size(steps) > 0, F.size(steps))
    why = F.concat_ws(";", F.when(F.size(x) < 2, "too_short"), F.when(share < 1, "not_finite"), F.when(F.array_max(finite) == F.array_min(finite), "constant"))
    return {"finite_share": share, "flat_share": flat, "reasons": why}


def normalised(x: Column, epsilon: float = 1e-7) -> Column:
    """(x - mean) / (deviation + epsilon), the two taken once."""
    m = F.get(F.transform(F.array(moments_of(x)), lambda p: F.struct(p["mean"].alias("mean"), (F.sqrt(p["variance"]) + epsilon).alias("scale"))), F.lit(0))
    return F.get(F.transform(F.array(F.struct(x.alias("x"), m.alias("m"))), lambda p: F.transform(p["x"], lambda v: (v - p["m"]["mean"]) / p["m"]["scale"])), F.lit(0))


def without_last(x: Column, when: Column) -> Column:
    return F.when(when & (F.size(x) > 0), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x)


def zero_padded(x: Column, length: int) -> Column:
    """Zeros on both sides, the smaller half left; longer records are null."""
    gap = F.lit(length) - F.size(x)
    left = F.floor(gap / 2).cast("int")
    return F.when(gap >= 0, F.concat(F.array_repeat(F.lit(0.0), left), x, F.array_repeat(F.lit(0.0), gap - left)))


def stage_trace(length: Column, rate: Column, target_rate: int, padded: int) -> Column:
    """array<struct<stage,length,rate,padding_required>> of the steps raw, resampled, padded; arithmetic only."""
    resampled = F.ceil(length * target_rate / rate).cast("int")
    step = lambda name, n, r, p: F.struct(F.lit(name).alias("stage"), n.cast("int").alias("length"), r.cast("int").alias("rate"), p.alias("padding_required"))
    no = F.lit(False)
    return F.array(step("raw", length, rate, no), step("resampled", resampled, F.lit(target_rate), no), step("padded", F.greatest(resampled, F.lit(padded)), F.lit(target_rate), resampled < padded))


def any_padded(steps: Column) -> Column:
    return F.exists(steps, lambda s: s["padding_required"])


def encoded(rows: DataFrame, encoder, size: int, batch: int = 256, keep: tuple[str, ...] = ("segment_id",)) -> DataFrame:
    """(keep, features array<double>) by a user's encoder(list of arrays, list of rates) -> (n, size); raises where its result is not that, or not finite."""
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), "features array<double>"])

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                made = np.asarray(encoder([np.asarray(s, float) for s in part["samples"]], part["rate"].tolist()), float)
                if made.shape != (len(part), size) or not np.isfinite(made).all():
                    raise ValueError(f"encoder gave {made.shape}, wanted {(len(part), size)} finite values")
                yield part[list(keep)].assign(features=list(made))

    return rows.select(*keep, "rate", "samples").mapInPandas(run, schema)


def row_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, std, range, iqr, skew, kurtosis) as statistics() has them, of records whose samples are rows: merged moments and ranges of values, so
    a record of any length runs in many tasks. Samples that are not finite are left out.
    """
    x = F.col(value).cast("double")
    known = rows.where(_is_finite(x)).withColumn("_x", x)
    sums = known.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), (F.max("_x") - F.min("_x")).alias("range"), F.skewness("_x").alias("_g1"), F.kurtosis("_x").alias("_g2"))
    quartiles = exact_quantiles(known, keys, "_x", [0.25, 0.75]).select(*keys, (F.col("quantiles")[1] - F.col("quantiles")[0]).alias("iqr"))
    n, some = F.col("n"), F.col("std") > 1e-12
    skew = F.when((n > 2) & some, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.col("_g1"))
    kurt = F.when((n > 3) & some, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("_g2") + 6))
    return sums.join(quartiles, keys).select(*keys, n.cast("long").alias("n"), "mean", "std", "range", "iqr", skew.alias("skew"), kurt.alias("kurtosis"))


def row_quality(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n, finite_share, flat_share, mean_step, reasons) as quality() has them, of records whose samples are rows in an order; steps are between
    neighbouring finite samples.
    """
    x = F.col(value).cast("double")
    marked = carried(rows.withColumn("_x", F.when(_is_finite(x), x)), keys, order, F.col("_x"), "_before").withColumn("_step", F.col("_x") - F.col("_before"))
    out = marked.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("_x") / F.count("*")).alias("finite_share"), (F.count_if(F.col("_step") == 0) / F.nullif(F.count("_step"), F.lit(0))).alias("flat_share"), F.avg(F.abs("_step")).alias("mean_step"), (F.min("_x") == F.max("_x")).alias("_constant"))
    why = F.concat_ws(";", F.when(F.col("n") < 2, "too_short"), F.when(F.col("finite_share") < 1, "not_finite"), F.when(F.col("_constant"), "constant"))
    return out.withColumn("reasons", why).drop("_constant")


def derivatives(rows: DataFrame, keys: list[str], order: list[str], value: str, rate: float) -> DataFrame:
    """The rows with `slope`, the difference to the sample before times the rate, and `curve`, the difference of slopes times the rate; null where there is none."""
    first = carried(rows, keys, order, F.col(value), "_b").withColumn("slope", (F.col(value) - F.col("_b")) * F.lit(float(rate)))
    return carried(first, keys, order, F.col("slope"), "_s").withColumn("curve", (F.col("slope") - F.col("_s")) * F.lit(float(rate))).drop("_b", "_s")


def segments(rows: DataFrame, keys: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """(keys, segment, samples): records cut into arrays of `length` samples in their order, the last one shorter; so no array holds a whole record."""
    placed = numbered_from(rows, keys, order, "_place").withColumn("segment", F.floor(F.col("_place") / length).cast("long"))
    return placed.groupBy(*keys, "segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", F.col(value).alias("_v")))), lambda x: x["_v"]).alias("samples"))  # `length` at most


def peaks(rows: DataFrame, keys: list[str], order: list[str], value: str, least: Column | None = None) -> DataFrame:
    """The rows that are peaks, with `place` (from 0 in the record): higher than the row before, not lower than the row after, and with `least` at least that high.

    rows: a record's samples as rows in an order; the first and last of a record are no peaks. Records of any length run in many tasks.
    """
    placed = numbered_from(rows, keys, order, "place")
    both = carried(carried(placed, keys, order, F.col(value), "_before"), keys, order, F.col(value), "_after", later=True)
    high = F.lit(True) if least is None else F.col(value) >= least
    return both.where((F.col(value) > F.col("_before")) & (F.col(value) >= F.col("_after")) & high).drop("_before", "_after")


def peak_intervals(found: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """(keys, n_peaks, interval_mean, interval_sd, interval_rmssd, per_minute) of peaks(): seconds between neighbours, their sample deviation, the root mean
    square of the differences of neighbouring intervals, and peaks a minute; null where there are too few peaks.
    """
    step = carried(found, keys, ["place"], F.col("place"), "_last").withColumn("_interval", (F.col("place") - F.col("_last")) / F.lit(float(rate)))
    change = carried(step, keys, ["place"], F.col("_interval"), "_previous").withColumn("_change", F.col("_interval") - F.col("_previous"))
    out = change.groupBy(*keys).agg(F.count("*").alias("n_peaks"), F.avg("_interval").alias("interval_mean"), F.stddev_samp("_interval").alias("interval_sd"), F.sqrt(F.avg(F.col("_change") * F.col("_change"))).alias("interval_rmssd"))
    return out.withColumn("per_minute", 60 / F.nullif(F.col("interval_mean"), F.lit(0.0)))


def band_peak(placed: DataFrame, keys: list[str], place: str, value: str, rate: float, frequencies: list[float]) -> DataFrame:
    """(keys, n, peak_hz, peak_power): the frequency of the given ones at which a record's Fourier sum is largest (the lowest of equal ones), and its power.

    All sums are aggregates of one partially aggregated grouping, so no record is collected and no row is multiplied; frequencies are a short list. The level
    of a record is taken out by its own Fourier sum of ones.
    """
    x, angle = F.col(value), lambda f: F.col(place) * F.lit(2 * math.pi * f / rate)
    sums = [g(angle(f)) * v for f in frequencies for g in (F.cos, F.sin) for v in (x, F.lit(1.0))]
    found = placed.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("_mean"), *(F.sum(s).alias(f"_s{k}") for k, s in enumerate(sums)))
    part = lambda k: F.col(f"_s{k}") - F.col("_mean") * F.col(f"_s{k + 1}")
    power = [(part(4 * k) * part(4 * k) + part(4 * k + 2) * part(4 * k + 2)) / F.col("n") for k in range(len(frequencies))]
    best = F.array_max(F.array(*(F.struct(p.alias("p"), F.lit(-float(f)).alias("f")) for p, f in zip(power, frequencies, strict=True))))
    return found.select(*keys, "n", (-best["f"]).alias("peak_hz"), best["p"].alias("peak_power"))
