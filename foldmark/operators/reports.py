"""Descriptive reports: summaries, associations, spreads, histograms, report rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..sources.shared import written
from .scans import exact_quantiles, running


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def distribution(rows: DataFrame, keys: list[str], value: str, category: str) -> DataFrame:
    """n, mean, least, median, greatest of a value, and counts of categories as columns of a map-free report."""
    made = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.countDistinct(category).alias("n_categories"), F.count_if(F.col(value).isNull()).alias("n_missing"))
    median = exact_quantiles(rows, keys, value, [0.5])
    return made.join(median.select(*keys, F.col("quantiles")[0].alias("median")), keys, "left")


def average_ranks(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks with ties at their mean. Equal values are counted first, and the counts run in many tasks where a group has many different values."""
    counted = running(rows.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, [value], F.col("_n"), "_before")
    return rows.join(counted.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out)), [*keys, value])


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): null for fewer than three rows or a constant side."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = average_ranks(average_ranks(known, keys, x, "_rx"), keys, y, "_ry")
    rho = safe_ratio(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, rho).alias("rho"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + k * d) or tiny), (1 + k / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation by Student's t with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def with_p_values(table: DataFrame) -> DataFrame:
    """A result table (..., n, rho) with `p`; it has a row for each report line."""
    def run(batches):
        for pdf in batches:
            yield pdf.assign(p=[correlation_p(None if r != r or r is None else float(r), int(n)) for r, n in zip(pdf["rho"], pdf["n"], strict=True)])

    return table.mapInPandas(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields), "p double"]))


def group_difference(rows: DataFrame, keys: list[str], value: str, group: str, first: str, second: str) -> DataFrame:
    """Mean of the first group minus mean of the second."""
    return rows.groupBy(*keys).agg((F.avg(F.when(F.col(group) == first, F.col(value))) - F.avg(F.when(F.col(group) == second, F.col(value)))).alias("difference"), F.count_if(F.col(group) == first).alias("n_first"), F.count_if(F.col(group) == second).alias("n_second"))


def prediction_spread(units: DataFrame, keys: list[str]) -> DataFrame:
    """Sample deviations of subjects' mean predictions and truths, and their ratio."""
    subject = units.groupBy(*keys, "subject_id").agg(F.avg("y_true").alias("y"), F.avg("y_pred").alias("p"))
    out = subject.groupBy(*keys).agg(F.stddev_samp("p").alias("prediction_sd"), F.stddev_samp("y").alias("truth_sd"), F.count("*").alias("n_subjects"))
    return out.withColumn("ratio", safe_ratio(F.col("prediction_sd"), F.col("truth_sd")))


def agreement(units: DataFrame, keys: list[str]) -> DataFrame:
    """Bias with its limits at 1.96 sample deviations of the differences."""
    d = F.col("y_pred") - F.col("y_true")
    out = units.groupBy(*keys).agg(F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), F.count("*").alias("n"), F.avg((F.col("y_pred") + F.col("y_true")) / 2).alias("mean_level"))
    return out.select(*keys, "bias", (F.col("bias") - 1.96 * F.col("sd")).alias("lower"), (F.col("bias") + 1.96 * F.col("sd")).alias("upper"), "mean_level", "n")


def trend(units: DataFrame, keys: list[str]) -> DataFrame:
    """The unweighted line of prediction on truth."""
    return units.groupBy(*keys).agg(F.regr_slope("y_pred", "y_true").alias("slope"), F.regr_intercept("y_pred", "y_true").alias("intercept"))


def histogram(rows: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int, weight: Column | None = None) -> DataFrame:
    """(keys, bin from 1, weight, density): values beyond the ends are in the first and last bin."""
    at = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1, F.lit(1)), F.lit(bins)).cast("int")
    made = rows.where(F.col(value).isNotNull()).groupBy(*keys, at.alias("bin")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(*keys))
    return made.withColumn("density", F.col("weight") / total / ((high - low) / bins))


def method_label(method: Column, fields: Column) -> Column:
    """A display label: the method, with the fields that a combined one adds."""
    return F.when(method.endswith("_plus"), F.concat(F.regexp_replace(method, "_plus$", ""), F.lit(" + "), fields)).when(method == "covariates", F.concat(F.lit("only "), fields)).otherwise(method)


def error_bars(value: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Half widths of an interval, never negative."""
    return F.greatest(F.lit(0.0), value - low), F.greatest(F.lit(0.0), high - value)


def improving(contrasts: DataFrame, keys: list[str]) -> DataFrame:
    """How many contrasts improve, and how many with their whole interval below 0."""
    return contrasts.groupBy(*keys).agg(F.count_if(F.col("delta") < 0).alias("n_improved"), F.count_if(F.col("ci_high") < 0).alias("n_certain"), F.count("*").alias("n"))


def cohort_summary(rows: DataFrame, keys: list[str], numbers: list[str], categories: list[str]) -> DataFrame:
    """Counts, and mean, population deviation, least, greatest and share missing of numbers; numbers of categories."""
    parts = [F.count("*").alias("n_rows"), F.countDistinct("subject_id").alias("n_subjects"), F.countDistinct("measurement_id").alias("n_measurements")]
    for c in numbers:
        parts += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing")]
    return rows.groupBy(*keys).agg(*parts, *(F.countDistinct(c).alias(f"n_{c}") for c in categories))


def manifest_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of the keys: counts, label units, rates, durations in seconds, targets over label units, shares missing, subjects by sex.

    rows: subject_id, measurement_id, segment_id, sample_rate_hz, n_samples, sbp, dbp, age, sex, bmi, and where they have them label_duration_seconds (else a
    segment's duration), label_scope (else one fixed word) and source (the first by name counts). A label unit is a subject's measurement, of which the first
    segment counts; a subject's sex is that of its first segment with any. The rows are made once, for counts, units and medians read them some ten times.
    """
    used = {*keys, "subject_id", "measurement_id", "segment_id", "sample_rate_hz", "n_samples", "sbp", "dbp", "age", "sex", "bmi", "label_duration_seconds", "label_scope", "source"}
    rows = written(rows.select(*(c for c in rows.columns if c in used)), "segments")
    has = set(rows.columns)
    scope = F.concat_ws(",", F.array_sort(F.collect_set(F.col("label_scope").cast("string")))) if "label_scope" in has else F.first(F.lit("segment_or_measurement_label"))
    source = F.min("source") if "source" in has else F.first(F.lit(None).cast("string"))
    duration = F.col("n_samples") / F.col("sample_rate_hz")
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    whole = rows.groupBy(*keys).agg(
        F.countDistinct("subject_id").alias("subjects"), F.countDistinct("measurement_id").alias("measurements"), F.count("*").alias("segments"),
        F.count("*").alias("input_windows"), scope.alias("label_scope"), source.alias("source"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_set("sample_rate_hz")), lambda x: x.cast("string"))).alias("sample_rates_hz"),
        F.min(duration).alias("duration_min"), F.max(duration).alias("duration_max"),
        share(F.col("age").isNull(), "age_missing"), share(F.coalesce(F.lower("sex") == "unknown", F.lit(True)), "sex_missing"), share(F.col("bmi").isNull(), "bmi_missing"),
    )
    units = rows.groupBy(*keys, "subject_id", "measurement_id").agg(F.min(F.struct("segment_id", "sbp", "dbp")).alias("u")).select(*keys, "u.sbp", "u.dbp")
    spread = [f(c).alias(f"{c}_{n}") for c in ("sbp", "dbp") for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))]
    labels = units.groupBy(*keys).agg(F.count("*").alias("label_units"), *spread)
    sex = rows.groupBy(*keys, "subject_id").agg(F.lower(F.min_by("sex", F.when(F.col("sex").isNotNull(), F.col("segment_id")))).alias("s"))
    people = sex.groupBy(*keys).agg(F.count_if(F.col("s") == "female").alias("female_subjects"), F.count_if(F.col("s") == "male").alias("male_subjects"))
    median = exact_quantiles(rows.withColumn("_seconds", duration), keys, "_seconds", [0.5])
    whole = whole.join(median.select(*keys, F.col("quantiles")[0].alias("duration_median")), keys, "left")
    given = F.col("label_duration_seconds").cast("string").try_cast("double") if "label_duration_seconds" in has else duration
    labelled = exact_quantiles(rows.withColumn("_seconds", given), keys, "_seconds", [0.5])
    whole = whole.join(labelled.select(*keys, F.col("quantiles")[0].alias("label_duration_median")), keys, "left")
    return whole.join(labels, keys).join(people, keys)


def canonical_covariates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, subject_id, age, sex, bmi, bmi_values): one row for each subject from its rows' age, sex and bmi.

    Age and sex are one value for a subject, else it raises; sex is "unknown" without any. bmi is the median of the subject's different values.
    """
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    token = F.nullif(F.lower(F.trim("sex")), F.lit(""))
    one = rows.groupBy(*keys, "subject_id").agg(F.min(number("age")).alias("age"), F.max(number("age")).alias("_age"), F.min(token).alias("sex"), F.max(token).alias("_sex"), F.array_sort(F.collect_set(number("bmi"))).alias("_bmi"))
    bad = one.where((F.col("_age") - F.col("age") > 1e-10) | (F.col("_sex") != F.col("sex"))).limit(3).collect()
    if bad:
        raise ValueError(f"age or sex varies within subjects {[r['subject_id'] for r in bad]}")
    n = F.size("_bmi")
    middle = (F.get("_bmi", F.floor((n - 1) / 2).cast("int")) + F.get("_bmi", F.floor(n / 2).cast("int"))) / 2
    return one.select(*keys, "subject_id", "age", F.coalesce("sex", F.lit("unknown")).alias("sex"), F.when(n > 0, middle).alias("bmi"), n.alias("bmi_values"))


def covariate_distribution(subjects: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of the keys from canonical_covariates(): subjects, age and bmi (number observed, mean, least, median, greatest), how many subjects have
    several different bmi values, and how many are female, male and neither.
    """
    parts = [F.count_distinct("subject_id").alias("n_subjects")]
    for c in ("age", "bmi"):
        parts += [F.count(c).alias(f"{c}_observed"), F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    sex = F.lower(F.col("sex"))
    parts += [F.count_if(F.col("bmi_values") > 1).alias("bmi_several"), F.count_if(sex == "female").alias("female"), F.count_if(sex == "male").alias("male"), F.count_if(F.coalesce(~sex.isin("female", "male"), F.lit(True))).alias("neither")]
    out = subjects.groupBy(*keys).agg(*parts)
    for c in ("age", "bmi"):
        out = out.join(exact_quantiles(subjects, keys, c, [0.5]).select(*keys, F.col("quantiles")[0].alias(f"{c}_median")), keys, "left")
    return out


def display_label(condition: Column, model: Column, fields: Column, names: dict[str, str], whole: str = "age/sex/BMI", covariates: tuple[str, ...] = ("demographics",)) -> Column:
    """A method's label: by `names` from the condition to a pattern with {model} and {mark}; the mark is there where a condition that uses covariates has other
    fields than the whole ones. A condition without a pattern raises.
    """
    uses = F.lit(False)
    for c in covariates:
        uses = uses | condition.contains(c)
    mark = F.when(uses & (F.trim(F.coalesce(fields, F.lit(""))) != whole), "†").otherwise("")
    out = F.raise_error(F.concat(F.lit("no label for condition "), F.coalesce(condition, F.lit("null"))))
    for name, pattern in names.items():
        filled = []
        for k, piece in enumerate(pattern.replace("{mark}", "\0m\0").replace("{model}", "\0n\0").split("\0")):
            filled.append((mark if piece == "m" else model) if k % 2 else F.lit(piece))
        out = F.when(condition == name, F.concat(*filled)).otherwise(out)
    return out


def heatmap_label(condition: Column, model: Column, names: dict[str, str], whole: str = "age/sex/BMI") -> Column:
    """The label without a mark: cohorts with different fields share one row of a heat map."""
    return display_label(condition, model, F.lit(whole), names, whole)


def metric_text(value: Column, deviation: Column, seeded: Column, digits: int = 2) -> Column:
    """A metric as text, for seeded methods with its deviation over seeds on a second line; null without a value."""
    shown = lambda x: F.format_string(f"%.{digits}f", x.cast("double"))
    return F.when(value.isNotNull(), F.when(seeded & deviation.isNotNull(), F.concat(shown(value), F.lit("\n±"), shown(deviation))).otherwise(shown(value)))


def information_sources(metrics: DataFrame, constants: DataFrame, lifts: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """One row for each of the keys: each method's MAE, the contrast with a constant, both lifts and whether the combination beats both; each part is aggregated before the joins."""
    wide = metrics.groupBy(*keys).pivot("method", methods).agg(F.first("mae"))
    wide = wide.select(*keys, *(F.col(f"`{m}`").alias(f"{m}_mae") for m in methods))
    return wide.join(constants.select(*keys, F.col("delta").alias("constant_delta")), keys, "left").join(lifts.select(*keys, "first_lift", "second_lift", "better_than_both"), keys, "left")
