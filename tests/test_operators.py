"""Operators on tiny frames, against hand results and plain re-derivations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.functions import SEX_TOKENS, category, number_pair, number_text, plain_token, slug
from foldmark.functions.fingerprints import fingerprint
from foldmark.operators import bootstrap, contrasts, manifest, reports, ridge, rules, sampling, scans, scoring, sessions, table_functions, transforms, waveform


def units(spark):
    rows = [("s1", "m1", 100.0, 104.0), ("s1", "m1", 100.0, 108.0), ("s1", "m2", 110.0, 110.0), ("s2", "m3", 120.0, 110.0)]
    return spark.createDataFrame([("c", "base", *r) for r in rows], "cohort string, method string, subject_id string, measurement_id string, y_true double, y_pred double")


def test_balanced_metrics_count_each_subject_once(spark):
    made = scoring.balanced_metrics(scoring.scoring_units(units(spark), ["cohort", "method"]), ["cohort", "method"]).first()
    assert (made["mae"], made["bias"], made["n_subjects"], made["n_measurements"]) == (6.5, -3.5, 2, 3)
    assert made["rmse"] == pytest.approx(math.sqrt(59))


def test_undefined_metrics_are_null(spark):
    rows = spark.createDataFrame([("a", "m", 5.0, 1.0), ("b", "n", 5.0, 1.0)], "subject_id string, measurement_id string, y_true double, y_pred double")
    made = scoring.balanced_metrics(rows.withColumn("k", F.lit(1)), ["k"]).first()
    assert made["r2"] is None and made["correlation"] is None and made["calibration_slope"] is None and made["mae"] == 4.0


def test_repartitioning_changes_nothing(spark):
    made = [scoring.balanced_metrics(scoring.scoring_units(units(spark).repartition(n), ["cohort", "method"]), ["cohort", "method"]).collect() for n in (1, 4, 32)]
    assert made[0] == made[1] == made[2]


def test_lower_weighted_median(spark):
    rows = spark.createDataFrame([(1, float(v), 1.0) for v in (1, 2, 3, 4)] + [(2, 1.0, 1.0), (2, 9.0, 3.0), (3, None, 1.0)], "k int, v double, w double")
    assert {x["k"]: x["median"] for x in scoring.lower_weighted_median(rows, ["k"], "v", "w").collect()} == {1: 2.0, 2: 9.0}


def test_interval_of_equal_deltas_is_a_point(spark):
    rows = spark.createDataFrame([("c", f"s{k}", -2.0) for k in range(7)], "cohort string, subject_id string, delta double")
    made = bootstrap.mean_intervals(rows, ["cohort"], ["cohort"], 50).first()
    assert (made["ci_low"], made["ci_high"], made["p_below_zero"]) == (-2.0, -2.0, 1.0)


def test_draws_are_poisson():
    times = bootstrap.times_drawn([f"boot|c|s{k}" for k in range(300)], 51)
    assert times.shape == (300, 51) and abs(times.mean() - 1) < 0.03 and abs(times.var() - 1) < 0.05 and abs((times == 0).mean() - math.exp(-1)) < 0.015
    assert (bootstrap.times_drawn(["boot|c|s7"], 20) == times[7, :20]).all()


def test_replicate_sums_use_the_same_draws_for_every_method(spark):
    rows = [("c", m, f"s{k}", float(k), float(m == "b")) for k in range(150) for m in "ab"] + [("d", "a", "s1", 4.0, 5.0), ("d", "a", "s2", None, 5.0)]
    frame = spark.createDataFrame(rows, "cohort string, method string, subject_id string, x double, y double")
    made = {(r["cohort"], r["method"], r["replicate"]): (r["times"], r["x"], r["y"]) for r in bootstrap.replicate_sums(frame, ["cohort"], ["cohort", "method"], ["x", "y"], 30).collect()}
    times = bootstrap.times_drawn([f"boot|c|s{k}" for k in range(150)], 30)
    for m in "ab":
        for k in range(30):
            assert made["c", m, k] == pytest.approx((times[:, k].sum(), (times[:, k] * np.arange(150)).sum(), (m == "b") * times[:, k].sum()))
    alone = bootstrap.times_drawn(["boot|d|s1"], 30)[0]
    assert {k: v for k, v in made.items() if k[0] == "d"} == {("d", "a", k): (t, 4 * t, 5 * t) for k, t in enumerate(alone.tolist()) if t}
    assert bootstrap.replicate_sums(frame.where("false"), ["cohort"], ["cohort", "method"], ["x", "y"], 30).count() == 0


def test_many_replicates_multiply_no_rows(spark):
    frame = spark.range(200).select(F.lit("c").alias("cohort"), F.col("id").alias("subject_id"), F.rand(1).alias("delta"))
    made = bootstrap.mean_intervals(frame, ["cohort"], ["cohort"], 10_000)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "md5" not in plan
    row = made.first()
    sd = float(np.std([r["delta"] for r in frame.collect()])) / math.sqrt(200)
    assert row["ci_high"] - row["ci_low"] == pytest.approx(2 * 1.96 * sd, rel=0.1)


@pytest.mark.parametrize("small", [3, 1 << 16])
def test_exact_quantiles_are_those_of_percentile(spark, small, monkeypatch):
    """Ties, nulls, skewed and far values, one value, no value; with ranges refined to three rows, and at once."""
    monkeypatch.setattr(scans, "PARTS", 8)
    r = np.random.default_rng(3)
    rows = [("a", float(x)) for x in r.normal(size=300)] + [("b", float(x)) for x in r.integers(0, 4, 200)] + [("c", 7.0), ("d", None), (None, 2.0), (None, 3.0)]
    rows += [("e", float(x)) for x in 10.0 ** r.integers(-300, 300, 60)] + [("a", None), ("f", -0.0), ("f", 0.0), ("g", 1e308), ("g", -1e308), ("g", 5.0)]
    frame, shares = spark.createDataFrame(rows, "k string, v double"), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {x["k"]: x["quantiles"] for x in scans.exact_quantiles(frame, ["k"], "v", shares, small=small).collect()}
    want = {x["k"]: x["q"] for x in frame.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect() if x["q"]}
    assert got == want and "d" not in got


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_running_totals_inside_heavy_groups(spark, most):
    r = np.random.default_rng(4)
    rows = [(k, f"{i:05d}" if i else None, int(w)) for k, n in (("a", 900), (None, 60), ("c", 1), ("d", 4)) for i, w in enumerate(r.integers(0, 9, n))]
    frame = spark.createDataFrame(rows, "k string, o string, w int").repartition(3)
    got = {(x["k"], x["o"]): (x["before"], x["w"]) for x in scans.running(frame, ["k"], ["o"], F.col("w"), "before", most).collect()}
    want, total = {}, {}
    for k, o, w in rows:  # the rows come in their order
        want[k, o] = (total.get(k, 0), w)
        total[k] = total.get(k, 0) + w
    assert got == want
    assert sorted(x["n"] for x in scans.numbered_from(frame, [], ["k", "o"], "n", most).collect()) == list(range(965))
    if most == 5:
        cut = scans.ranges(frame, ["k"], ["o"], most)
        sizes = [x["count"] for x in cut.groupBy("k", "_range").count().collect()]
        assert len(sizes) > 60 and max(sizes) < 60


def test_best_alpha_takes_the_largest_of_ties(spark):
    rows = spark.createDataFrame([(0, 1.0, 3.0), (0, 10.0, 3.0), (0, 100.0, 4.0)], "outer int, alpha double, mae double")
    assert ridge.best_alpha(rows, ["outer"]).first()["alpha"] == 10.0


def direct_ridge(x, y, w, alpha):
    """(intercept, coefficients) of a weighted Ridge on features as they are, weights of mean 1."""
    w = w * len(w) / w.sum()
    xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    c = np.linalg.solve((x - xm).T @ ((x - xm) * w[:, None]) + alpha * np.eye(x.shape[1]), (x - xm).T @ ((y - ym) * w))
    return ym - xm @ c, c


def weighted_lower_median(v, w):
    order = np.argsort(v, kind="stable")
    return v[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2 * (1 - 1e-12))]


def direct_transform(x, w):
    """(median, mean, scale, gaps) of a pool, and the function that makes its features of any rows."""
    seen = np.isfinite(x)
    gaps = np.flatnonzero(~seen.all(axis=0))
    median = np.array([weighted_lower_median(c[s], w[s]) for c, s in zip(x.T, seen.T, strict=True)])
    fill = lambda v: np.column_stack([np.where(np.isfinite(v), v, median), (~np.isfinite(v[:, gaps])).astype(float)])
    mean = np.average(fill(x), axis=0, weights=w)
    scale = np.sqrt(np.average((fill(x) - mean) ** 2, axis=0, weights=w))
    scale[scale <= np.finfo(float).eps] = 1.0
    return lambda v: (fill(v) - mean) / scale


def test_ridge_path_is_the_direct_fit():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(60, 4)) * [1, 5, 0.1, 2] + 3, rng.normal(size=(60, 2)) + 50, rng.uniform(0.5, 2, 60)
    b, c, width = ridge.solve_path(ridge._packed(x, y - 50, w), (0.1, 10.0), 2)
    assert width == 4
    mean = np.average(x, axis=0, weights=w)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    for i, a in enumerate((0.1, 10.0)):
        for t in range(2):
            level, direct = direct_ridge((x - mean) / scale, y[:, t], w, a)
            assert np.allclose(c[i, t], direct / scale) and b[i, t] + 50 == pytest.approx(level - (mean / scale) @ direct)


def test_nested_predictions_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(2)
    n = 150
    x = rng.normal(size=(n, 3)) * [1.0, 4.0, 0.2] + [0, 9, 0]
    x[rng.random(n) < 0.2, 1] = np.nan
    y = np.column_stack([np.nan_to_num(x[:, 1]) + rng.normal(size=n), x[:, 2] * 7 + rng.normal(size=n)])
    subject, measurement = np.arange(n) % 30, np.arange(n) // 2
    rows = [(int(s), int(m), int(i), int(s % 5), [None if np.isnan(v) else float(v) for v in r], float(t[0]), float(t[1])) for i, (s, m, r, t) in enumerate(zip(subject, measurement, x, y, strict=True))]
    df = spark.createDataFrame(rows, "subject_id int, measurement_id int, row int, fold int, features array<double>, y double, z double")
    made, chosen, tuning = ridge.nested(df, ("y", "z"))
    per = {}
    for s, m in zip(subject.tolist(), measurement.tolist(), strict=True):
        per.setdefault(s, {}).setdefault(m, 0)
        per[s][m] += 1
    w = np.array([1 / (per[s][m] * len(per[s])) for s, m in zip(subject.tolist(), measurement.tolist(), strict=True)])
    inner = {}
    for fold in range(5):
        groups = sorted((s for s in set(subject.tolist()) if s % 5 == fold), key=lambda s: (-int((subject == s).sum()), s))
        inner |= {g: (p % 3 if (p // 3) % 2 == 0 else 2 - p % 3) for p, g in enumerate(groups)}
    which = np.array([inner[int(s)] for s in subject])

    def macro(guess, rows_, t):
        units_ = {}
        for i, g in zip(rows_, guess, strict=True):
            units_.setdefault((subject[i], measurement[i]), []).append((g, y[i, t]))
        gaps = {}
        for (s, _), v in units_.items():
            gaps.setdefault(s, []).append(abs(np.mean([a for a, _ in v]) - np.mean([b for _, b in v])))
        return np.mean([np.mean(v) for v in gaps.values()])

    picked = {(r["outer"], r["target"]): r for r in chosen.collect()}
    scores = {(r["outer"], r["inner_fold"], r["target"], r["alpha"]): r for r in tuning.collect()}
    got = {}
    for r in made.collect():
        got.setdefault((r["fold"], r["target"]), []).append(r["y_pred"])
    for fold in range(5):
        pool = np.flatnonzero(subject % 5 != fold)
        for t, name in enumerate(("y", "z")):
            best = {}
            for a in ridge.ALPHAS:
                guess = np.full(n, np.nan)
                for k in range(3):
                    fit, held = pool[which[pool] != k], pool[which[pool] == k]
                    make = direct_transform(x[fit], w[fit])
                    b, c = direct_ridge(make(x[fit]), y[fit, t], w[fit], a)
                    guess[held] = b + make(x[held]) @ c
                    found = scores[(fold, k, name, a)]
                    assert found["validation_mae"] == pytest.approx(macro(guess[held], held, t))
                    assert found["n_validation_subjects"] == len(set(subject[held])) and found["n_fit_subjects"] == len(set(subject[fit]))
                best[a] = macro(guess[pool], pool, t)
            alpha = max(a for a in best if best[a] <= min(best.values()) + 1e-12)
            assert picked[(fold, name)]["alpha"] == alpha and picked[(fold, name)]["mae"] == pytest.approx(best[alpha]) and picked[(fold, name)]["input_dimension"] == 4
            make = direct_transform(x[pool], w[pool])
            b, c = direct_ridge(make(x[pool]), y[pool, t], w[pool], alpha)
            tested = np.flatnonzero(subject % 5 == fold)
            assert sorted(got[(fold, name)]) == pytest.approx(sorted(b + make(x[tested]) @ c))


def plain_allocation(sizes, limit):
    """One subject at a time, from the stratum furthest above its share or to the one furthest below."""
    total = sum(sizes.values())
    if limit >= total:
        return dict(sizes)
    ideal = {k: n * (limit / total) for k, n in sizes.items()}
    out = {k: int(x) or (1 if len(sizes) <= limit else 0) for k, x in ideal.items()}
    while sum(out.values()) > limit:
        out[min((k for k in out if out[k] > 1), key=lambda k: (ideal[k] - out[k], k))] -= 1
    while sum(out.values()) < limit:
        out[min((k for k in out if out[k] < sizes[k]), key=lambda k: (out[k] - ideal[k], k))] += 1
    return out


def test_allocation_adds_up_and_respects_sizes(spark):
    r = np.random.default_rng(8)
    for sizes, limits in (({"a": 50, "b": 3, "c": 1, "d": 46}, (1, 4, 10, 37, 99, 100, 500)), ({f"s{k:03d}": int(n) for k, n in enumerate(r.geometric(0.2, 60))} | {"big": 900}, (20, 61, 75, 300))):
        frame = spark.createDataFrame([(f"{k}-{i}", k) for k, n in sizes.items() for i in range(n)], "subject_id string, g string")
        for limit in limits:
            got = {x["stratum"]: x["quota"] for x in sampling.allocation(frame, "g", limit).collect()}
            assert got == plain_allocation(sizes, limit) and sum(got.values()) == min(limit, sum(sizes.values()))


def test_stratified_sample_says_what_is_wrong(spark):
    who = spark.createDataFrame([(k, "ab"[k % 3 == 0], k) for k in range(30)], "subject_id int, g string, n int")
    made = sampling.stratified_sample(who, "g", 9, "s", F.col("n") >= 12)
    assert made.columns == who.columns and made.groupBy("g").count().orderBy("g").collect() == [("a", 6), ("b", 3)] and made.agg(F.min("n")).first()[0] >= 12
    with pytest.raises(ValueError, match="18 are eligible"):
        sampling.stratified_sample(who, "g", 19, "s", F.col("n") >= 12)
    with pytest.raises(ValueError, match="repeat"):
        sampling.stratified_sample(who.unionByName(who.limit(1)), "g", 9, "s")


def test_gaps_of_every_kind(spark):
    """NaN is a gap as null is; infinities are filled without an indicator; a constant of any level has scale 1."""
    rows = [(1, 1.0, 1.0, 1e9 + 0.1, 1.0), (2, float("nan"), float("inf"), 1e9 + 0.1, 1.0), (3, 3.0, 5.0, 1e9 + 0.1, 2.0), (4, None, 7.0, 1e9 + 0.1, 1.0)]
    frame = spark.createDataFrame(rows, "id int, x double, y double, z double, w double").withColumn("k", F.lit(0))
    fit = {r["feature"]: r for r in transforms.fit_numeric(frame, ["k"], ["x", "y", "z"], "w").collect()}
    x, y, z = fit["x"], fit["y"], fit["z"]
    assert (x["median"], x["has_gap"], x["mean"], x["gap_mean"]) == (3.0, True, 2.6, 0.4) and x["scale"] == pytest.approx(0.8)
    assert (y["median"], y["has_gap"]) == (5.0, False) and y["mean"] == pytest.approx((1 + 5 + 10 + 7) / 5)
    assert z["scale"] == 1.0 and z["mean"] == pytest.approx(1e9 + 0.1)
    made = {(r["id"], r["feature"]): r for r in transforms.apply_numeric(frame, transforms.fit_numeric(frame, ["k"], ["x", "y", "z"], "w"), ["k"], ["id"], ["x", "y", "z"]).collect()}
    assert made[2, "x"]["value"] == pytest.approx(0.5) and made[2, "x"]["indicator"] == pytest.approx((1 - 0.4) / math.sqrt(0.24)) and made[2, "y"]["indicator"] is None
    assert all(math.isfinite(r["value"]) for r in made.values())


def test_small_spread_at_a_large_level_counts(spark):
    rows = [(f"s{k % 3}", f"m{k}", 1e6 + 0.001 * k, 1e6 + 0.001 * k) for k in range(9)]
    frame = spark.createDataFrame(rows, "subject_id string, measurement_id string, y_true double, y_pred double").withColumn("k", F.lit(1))
    made = scoring.balanced_metrics(frame, ["k"]).first()
    assert made["r2"] == pytest.approx(1) and made["correlation"] == pytest.approx(1) and made["calibration_slope"] == pytest.approx(1)
    moments = scoring.subject_moments(frame, ["k"])
    many = bootstrap.replicate_metrics(moments, ["k"], ["k"], 20).collect()
    assert [r["correlation"] for r in many if r["correlation"] is not None] == pytest.approx([1.0] * len([r for r in many if r["correlation"] is not None]))


@pytest.mark.parametrize("most", [4, 1 << 20])
def test_nearest_values_inside_heavy_groups(spark, most):
    r = np.random.default_rng(6)
    rows = [(k, i, None if r.random() < 0.8 else float(i)) for k, n in (("a", 400), (None, 30), ("c", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k string, o int, v double").repartition(3)
    both = scans.carried(scans.carried(frame, ["k"], ["o"], F.col("v"), "back", most=most), ["k"], ["o"], F.col("v"), "ahead", later=True, here=True, most=most)
    for x in both.collect():
        own = [(o, v) for k, o, v in rows if k == x["k"] and v is not None]
        assert x["back"] == max((v for o, v in own if o < x["o"]), default=None) and x["ahead"] == min((v for o, v in own if o >= x["o"]), default=None)


def test_peaks_and_band(spark):
    n, rate = 600, 50.0
    rows = [("p", k, math.sin(2 * math.pi * 1.25 * k / rate) + 3) for k in range(n)] + [("flat", k, 1.0) for k in range(9)] + [("one", 0, 1.0)]
    frame = spark.createDataFrame(rows, "id string, o int, v double")
    found = waveform.peaks(frame, ["id"], ["o"], "v")
    made = waveform.peak_intervals(found, ["id"], rate).collect()
    assert [r["id"] for r in made] == ["p"] and made[0]["n_peaks"] == 15 and made[0]["interval_mean"] == pytest.approx(0.8) and made[0]["per_minute"] == pytest.approx(75)
    band = {r["id"]: r for r in waveform.band_peak(frame, ["id"], "o", "v", rate, [0.5, 1.0, 1.25, 1.5, 3.0]).collect()}
    assert band["p"]["peak_hz"] == 1.25 and band["p"]["peak_power"] == pytest.approx(n / 4, rel=1e-3)
    assert waveform.peaks(frame, ["id"], ["o"], "v", F.lit(9.0)).count() == 0


def test_splits_are_disjoint_and_cover(spark):
    who = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(57)], "subject_id int, g string")
    splits = sampling.split_manifest(who, "g", "g", 5, 3).cache()
    assert rules.split_violations(splits, who, 5).isEmpty()
    sizes = {r["fold"]: (r["v"], r["n"]) for r in splits.groupBy("fold").agg(F.count_if(F.col("role") == "validation").alias("v"), F.count_if(F.col("role") != "test").alias("n")).collect()}
    assert all(v == -(-n // 5) for v, n in sizes.values())
    broken = splits.unionByName(splits.limit(1))
    assert {r["rule"] for r in rules.split_violations(broken, who, 5).collect()} >= {"once_in_fold"}


@pytest.mark.parametrize(("n", "onsets", "expected"), [(60, [15], [60]), (100, [15, 57], [42, 54, 4]), (120, [], [54, 54, 12]), (110, [15], [54, 54, 2])])
def test_sessions(spark, n, onsets, expected):
    rows = spark.createDataFrame([("s", k, k in onsets) for k in range(1, n + 1)], "subject_id string, n int, onset boolean")
    made = sessions.derived_sessions(rows, ["subject_id"], "n", 54, 15).groupBy("session_index").count().orderBy("session_index")
    assert [r["count"] for r in made.collect()] == (expected if n != 60 else [54, 6])


def test_patience(spark):
    rows = spark.createDataFrame([("r", k + 1, v) for k, v in enumerate((5.0, 4.0, 4.0, 4.5, 4.2, 3.0))], "run string, epoch int, score double")
    made = sessions.selected_epochs(rows, ["run"], "epoch", "score", 3).first()
    assert (made["best_epoch"], made["stopped_epoch"]) == (2, 5)


def test_transform_of_gaps(spark):
    rows = spark.createDataFrame([(0, k, v, 1.0) for k, v in enumerate((1.0, 3.0, None))], "pool int, k int, a double, w double")
    made = {r["k"]: (r["value"], r["indicator"]) for r in transforms.apply_numeric(rows, transforms.fit_numeric(rows, ["pool"], ["a"], "w"), ["pool"], ["k"], ["a"]).collect()}
    x = np.array([1.0, 3.0, 1.0])
    assert [made[k][0] for k in range(3)] == pytest.approx(((x - x.mean()) / x.std()).tolist())
    assert made[2][1] == pytest.approx((1 - 1 / 3) / math.sqrt(2 / 9))


def test_columns(spark):
    row = spark.createDataFrame([(" F ", " Xy", None, "120.5 / 80", "120", "1.0")], "a string, b string, c string, d string, e string, f string")
    got = row.select(category("a", SEX_TOKENS), category("b", SEX_TOKENS), category("c", SEX_TOKENS), number_pair(F.col("d"), True), number_pair(F.col("e"), True), plain_token(F.col("f")), slug(F.lit("A b/C"))).first()
    assert tuple(got) == ("female", "xy", None, 120.5, None, "1", "a_b_c")


def test_manifest_rules(spark):
    good = {"dataset": "d", "source": "s", "subject_id": "1", "segment_id": "a", "waveform_path": "p.npy", "sample_rate_hz": "125", "n_samples": "10", "sbp": "120", "dbp": "80", "sex": "F", "height_cm": "0", "weight_kg": "70"}
    cases = {"targets_ordered": {"dbp": "130"}, "rate_positive": {"sample_rate_hz": "0"}, "two_samples": {"n_samples": "1"}, "category_known": {"sex": "y"}, "numbers_present": {"sbp": "bad"}, "subject_present": {"subject_id": None}, "path_present": {"waveform_path": None}}
    for rule, change in cases.items():
        rows = spark.createDataFrame([{**good, **change}], ", ".join(f"{k} string" for k in good))
        tidy = manifest.canonical_manifest(rows)
        assert {r["rule"] for r in rules.manifest_violations(tidy).collect()} == {rule}
        with pytest.raises(ValueError, match=rule):
            rules.strict(rules.manifest_violations(tidy))
    tidy = manifest.canonical_manifest(spark.createDataFrame([good], ", ".join(f"{k} string" for k in good))).first()
    assert (tidy["measurement_id"], tidy["waveform_format"], tidy["bmi"], tidy["sex"], tidy["valid_for_analysis"]) == ("1", "npy", None, "female", True)


def test_fingerprint_ignores_order(spark):
    rows = spark.createDataFrame([(k, str(k)) for k in range(40)], "a int, b string")
    made = {fingerprint(rows.repartition(n), F.col("a"), F.col("b")).first()[0] for n in (1, 3, 9)}
    assert len(made) == 1
    other = [spark.createDataFrame(x, "a string, b string") for x in ([("a|b", "c")], [("a", "b|c")], [("a|b", "c")] * 2, [("", None)], [(None, "")])]
    assert len({fingerprint(x, F.col("a"), F.col("b")).first()[0] for x in other}) == 5
    many = spark.range(20_000)
    assert fingerprint(many, F.col("id")).first()[0] != fingerprint(many.where("id > 0"), F.col("id")).first()[0]


def test_number_text(spark):
    row = spark.createDataFrame([(0.1 + 0.2, 1e-7, 123456.0, -0.0, float("nan"), None, 1 / 3)], "a double, b double, c double, d double, e double, f double, g double")
    assert tuple(row.select(*(number_text(c) for c in "abcdefg")).first()) == ("3e-1", "1e-7", "1.23456e5", "0", "", "", "3.33333333333e-1")


def test_p_values():
    assert reports.correlation_p(0.5, 12) == pytest.approx(0.0978, abs=1e-4)
    assert reports.correlation_p(0.0, 12) == pytest.approx(1.0) and reports.correlation_p(None, 5) is None


def test_contrast_and_unmatched(spark):
    rows = [("c", m, s, u, 10.0, p) for m, p in (("a", 11.0), ("b", 13.0)) for s, u in (("s", "1"), ("s", "2"), ("t", "3")) if not (m == "b" and u == "3")]
    made = spark.createDataFrame(rows, "cohort string, method string, subject_id string, measurement_id string, y_true double, y_pred double")
    specs = spark.createDataFrame([("x", "a", "b")], "contrast string, candidate string, reference string")
    with pytest.raises(ValueError, match="t/3: reference"):
        contrasts.paired_units(made, specs, ["cohort"])
    got = contrasts.contrast_table(contrasts.paired_units(made, specs, ["cohort"], strict=False), ["cohort", "contrast"]).first()
    assert (got["delta"], got["n_subjects"], got["n_measurements"]) == (-2.0, 1, 2)
    assert [r["missing"] for r in contrasts.unmatched_units(made, specs, ["cohort"]).collect()] == ["reference"]
    other = made.where("measurement_id <> '3'").withColumn("y_true", F.when(F.expr("method = 'b' and measurement_id = '2'"), 11.0).otherwise(F.col("y_true")))
    assert [r["missing"] for r in contrasts.unmatched_units(other, specs, ["cohort"]).collect()] == ["truth"]


def test_seed_contrasts_reuse_a_method_without_seeds(spark):
    rows = [("c", "a", s, f"m{s}", seed, 10.0, 12.0 + seed) for s in "pqr" for seed in (0, 1)] + [("c", "b", s, f"m{s}", None, 10.0, 11.0) for s in "pqr"]
    made = spark.createDataFrame(rows, "cohort string, method string, subject_id string, measurement_id string, seed int, y_true double, y_pred double")
    specs = spark.createDataFrame([("x", "a", "b")], "contrast string, candidate string, reference string")
    pairs = contrasts.paired_units(contrasts.over_seeds(made, ["b"], ["cohort"]), specs, ["cohort"], by_seed=True)
    got = contrasts.seed_contrasts_with_intervals(pairs, ["cohort"], ["cohort", "contrast"], 30).first()
    assert (got["delta"], got["n_seeds"], got["ci_low"], got["ci_high"], got["p_candidate_better"]) == (1.5, 2, 1.5, 1.5, 0.0)
    assert got["delta_seed_sd"] == pytest.approx(math.sqrt(0.5))
    with pytest.raises(ValueError, match="every seed"):
        contrasts.seed_contrasts_with_intervals(pairs.where("not (subject_id = 'p' and seed = 1)"), ["cohort"], ["cohort", "contrast"], 30)


def test_between_within_means_over_all_subjects(spark):
    made = scoring.between_within(units(spark).groupBy("cohort", "subject_id", "measurement_id").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred")), ["cohort"]).first()
    # s1: truths 100, 110, guesses 106, 110; s2 has one unit
    assert (made["n_subjects"], made["n_measurements"], made["n_repeated"]) == (2, 3, 1)
    assert (made["overall_mae"], made["between_mae"], made["within_mae"]) == ((3 + 10) / 2, (3 + 10) / 2, (3 + 0) / 2)
    assert (made["true_within_sd"], made["pred_within_sd"], made["within_ratio"]) == (2.5, 1.0, 0.4)


def test_model_against_constants(spark):
    rows = [("c", f, f"s{f}", f"m{f}{k}", float(10 * f + k), 0.0) for f in range(3) for k in range(2)]
    made = spark.createDataFrame(rows, "cohort string, fold int, subject_id string, measurement_id string, y_true double, y_pred double")
    got = {r["constant"]: r for r in contrasts.model_against_constants(made, ["cohort"], 20).collect()}
    means = {0: (10 + 11 + 20 + 21) / 4, 1: (0 + 1 + 20 + 21) / 4, 2: (0 + 1 + 10 + 11) / 4}
    medians = {0: 11.0, 1: 1.0, 2: 1.0}
    for name, constant in (("mean_constant", means), ("median_constant", medians)):
        mae = np.mean([np.mean([abs(constant[f] - 10 * f - k) for k in range(2)]) for f in range(3)])
        assert got[name]["constant_mae"] == pytest.approx(mae) and got[name]["model_mae"] == pytest.approx(10.5) and got[name]["delta"] == pytest.approx(10.5 - mae)


def test_array_statistics(spark):
    rng = np.random.default_rng(3)
    records = [rng.normal(size=n) * 3 + 1e6 for n in (1, 2, 3, 50, 4000)] + [np.full(9, 7.0)]
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(records)] + [(99, [])], "k int, x array<double>")
    stats = waveform.statistics(F.col("x"))
    got = {r["k"]: r for r in df.select("k", *(c.alias(n) for n, c in stats.items()), waveform.normalised(F.col("x")).alias("z")).collect()}
    assert got[99]["mean"] is None and got[99]["z"] == []
    for k, r in enumerate(records):
        n, s = len(r), r.std()
        assert got[k]["mean"] == pytest.approx(r.mean()) and got[k]["std"] == pytest.approx(s, abs=1e-5) and got[k]["iqr"] == pytest.approx(np.subtract(*np.percentile(r, [75, 25])), abs=1e-6)
        if n > 3 and s > 0:
            g1, g2 = ((r - r.mean()) ** 3).mean() / s**3, ((r - r.mean()) ** 4).mean() / s**4 - 3
            assert got[k]["skew"] == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * g1, abs=1e-5)
            assert got[k]["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), abs=1e-5)
            assert np.allclose(got[k]["z"], (r - r.mean()) / (s + 1e-7), atol=1e-5)


def test_padding(spark):
    row = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert row.select(waveform.zero_padded(F.col("x"), 5), waveform.zero_padded(F.col("x"), 1), waveform.without_last(F.col("x"), F.lit(True))).first() == ([0.0, 1.0, 2.0, 0.0, 0.0], None, [1.0])


def test_sessions_that_can_not_be_derived(spark):
    rows = spark.createDataFrame([("s", k, k in (15, 69)) for k in range(1, 101)] + [("t", k, k == 15) for k in range(1, 61)], "subject_id string, n int, onset boolean")
    made = sessions.derived_sessions(rows, ["subject_id"], "n", 54, 15)
    assert {r["subject_id"]: r["reason"] for r in sessions.session_errors(made, ["subject_id"], 54, 15).collect()} == {}
    late = spark.createDataFrame([("s", k, k in (15, 90, 110)) for k in range(1, 121)] + [("u", k, k == 5) for k in range(1, 30)], "subject_id string, n int, onset boolean")
    made = sessions.derived_sessions(late, ["subject_id"], "n", 54, 15)
    assert {r["subject_id"]: r["reason"] for r in sessions.session_errors(made, ["subject_id"], 54, 15).collect()} == {"s": "session_too_long", "u": "onset_out_of_place"}
    with pytest.raises(ValueError, match="session_too_long"):
        sessions.checked_sessions(made.where("subject_id = 's'"), ["subject_id"], 54, 15)
    assert {r["session_id"] for r in made.where("subject_id = 'u'").collect()} == {"u-session-01"}


def test_split_labels_fall_back(spark):
    rows = [(k, "abcd"[k % 4] + f"|{k % 40}", "abcd"[k % 4], "x") for k in range(80)]
    who = spark.createDataFrame(rows, "subject_id int, full string, mid string, short string")
    made = sampling.benchmark_splits(who, ["full", "mid", "short"], 5, 3).cache()
    assert {(r["outer_method"], r["validation_method"]) for r in made.collect()} == {("mid", "mid")} and rules.split_violations(made, who, 5).isEmpty()
    few = who.where("subject_id < 5").withColumn("short", F.col("subject_id").cast("string"))
    assert sampling.benchmark_splits(few, ["full", "mid", "short"], 5, 3).first()["outer_method"] == "none"
    for folds, match in ((1, "two folds"), (6, "fewer subjects")):
        with pytest.raises(ValueError, match=match):
            sampling.benchmark_splits(few, ["full"], folds)


def test_canonical_covariates_and_summary(spark):
    schema = "c string, subject_id string, measurement_id string, segment_id string, sample_rate_hz double, n_samples double, sbp double, dbp double, age double, sex string, bmi double"
    rows = [("c", "s", "m", "b", 50.0, 100.0, 120.0, 80.0, 40.0, "Female", 20.0), ("c", "s", "m", "a", 50.0, 50.0, 110.0, 70.0, None, None, 22.0), ("c", "s", "n", "d", 125.0, 125.0, 100.0, 60.0, 40.0, " female ", 27.0), ("c", "t", "o", "e", 125.0, 250.0, 130.0, 90.0, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r["subject_id"]: tuple(r)[2:] for r in reports.canonical_covariates(df, ["c"]).collect()}
    assert got == {"s": (40.0, "female", 22.0, 3), "t": (None, "unknown", None, 0)}
    with pytest.raises(ValueError, match="varies"):
        reports.canonical_covariates(df.withColumn("age", F.when(F.col("segment_id") == "b", 41.0).otherwise(F.col("age"))), ["c"])
    one = reports.manifest_summary(df, ["c"]).first()
    assert (one["subjects"], one["measurements"], one["segments"], one["label_units"], one["female_subjects"], one["male_subjects"]) == (2, 3, 4, 3, 1, 0)
    assert (one["sample_rates_hz"], one["duration_median"], one["duration_min"], one["duration_max"]) == ("50.0,125.0", 1.5, 1.0, 2.0)
    assert one["sbp_mean"] == pytest.approx((110 + 100 + 130) / 3) and one["age_missing"] == 0.5 and one["sex_missing"] == 0.5


def test_rules_on_sets(spark):
    a, b = spark.createDataFrame([("s",), ("t",)], "subject_id string"), spark.createDataFrame([("t",), ("u",)], "subject_id string")
    assert [r["key"] for r in rules.subjects_apart(a, b).collect()] == ["t"] and rules.subjects_apart(a, b.where("subject_id = 'u'")).isEmpty()
    rows = spark.createDataFrame([("k", 0.0, "v1"), ("k", 1.5, "v2"), ("l", 0.0, "v1"), ("l", 1.0, "v1")], "k string, fold double, version string")
    assert {(r["rule"], r["key"]) for r in rules.whole_folds(rows, ["k"], 2).collect()} == {("folds_whole", "k")}
    assert [r["detail"] for r in rules.one_value(rows, {"version": "v1"}, ["k", "fold"]).collect()] == ["v2"]
    with pytest.raises(ValueError, match="1 or more"):
        manifest.first_rows(a, ["subject_id"], 0)
    assert [r[0] for r in manifest.first_rows(a, ["subject_id"], 1).collect()] == ["s"]


def test_caps(spark):
    rows = spark.createDataFrame([("s", "ab"[k % 2] if k < 6 else "c", k) for k in range(10)], "subject_id string, m string, k int")
    got = sampling.round_robin_capped(rows, ["subject_id"], "m", ["k"], 6, "x").groupBy("m").count().collect()
    assert {r["m"]: r["count"] for r in got} == {"a": 2, "b": 2, "c": 2}
    assert sampling.capped(rows, ["subject_id"], ["k"], 3, "x").count() == 3
    one, two = ({r["k"] for r in sampling.capped(rows, ["subject_id"], ["k"], 3, "x", e).collect()} for e in (1, 2))
    assert one != two


def test_record_and_label_rules(spark):
    rows = spark.createDataFrame([("s", 1, 30), ("s", 2, 30), ("t", 1, 25)], "subject_id string, k int, rate int")
    assert {r["rule"] for r in rules.record_violations(rows, "subject_id", 2, ["rate"]).collect()} == {"record_count", "uniform_rate"}
    units_ = spark.createDataFrame([("s", "m", 2, "single_seed"), ("s", "n", 1, "single_seed")], "subject_id string, measurement_id string, n_seeds int, aggregation_mode string")
    assert [r["key"] for r in rules.label_violations(units_).collect()] == ["s|m"]
    allowed = spark.createDataFrame([("a", "x")], "model string, condition string")
    assert rules.condition_violations(spark.createDataFrame([("a", "x"), ("a", "y")], "model string, condition string"), allowed, ["model", "condition"]).count() == 1
    one = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert {r["key"] for r in rules.exactly_one(one, ["k"], spark.createDataFrame([(1,), (2,), (3,)], "k int")).collect()} == {"1", "3"}


def test_measurement_key_and_path(spark):
    row = spark.createDataFrame([("s", None, "a/b/PPG"), ("s", "m", "a/x")], "subject_id string, measurement_id string, path string")
    assert [tuple(r) for r in row.select(manifest.measurement_key(F.lit(False)), manifest.measurement_key(F.lit(True)), manifest.raw_field_only("path", "PPG")).collect()] == [("s", "s", True), ("m", "s", False)]


def test_checked_join(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeats"):
        manifest.checked_left_join(left, right, "k")
    assert manifest.checked_left_join(left, right.limit(1), "k").count() == 2
    assert {(r["k"], r["side"]) for r in manifest.key_differences(left, right, "k").collect()} == {(2, "left_only")}


def test_ridge_diagnostics_take_all_rows(spark, tmp_path):
    from foldmark.plans import QUERIES

    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(size=3)], k % 7) for k in range(2_500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sum(r["n_rows"] for r in QUERIES["ridge_diagnostics"](spark, str(tmp_path)).collect()) == len(rows)


def test_record_sizes_are_counted_without_arrays(spark):
    from foldmark.plans import QUERIES

    for name in ("nested_step_flag", "sample_count_distribution"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "count(1)" in plan and "collect_list" not in plan


def test_rows_of_samples_have_the_statistics_of_arrays(spark):
    """Records as rows against the same records as arrays, with gaps, constants and records too short for a shape."""
    r = np.random.default_rng(9)
    rows = [("a", i, float(x)) for i, x in enumerate(r.normal(size=200) ** 3)] + [("b", i, 2.5) for i in range(7)] + [("c", 0, 1.0), ("c", 1, 4.0), ("d", 0, 3.0)]
    frame = spark.createDataFrame(rows, "id string, o int, v double")
    arrays = frame.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("x"))
    want = {x["id"]: x for x in arrays.select("id", *(c.alias(n) for n, c in waveform.statistics(F.col("x")).items())).collect()}
    for x in waveform.row_statistics(frame, ["id"], "v").collect():
        for n in ("mean", "std", "range", "iqr", "skew", "kurtosis"):
            assert x[n] == (want[x["id"]][n] if want[x["id"]][n] is None else pytest.approx(want[x["id"]][n], abs=1e-9)), (x["id"], n)
    broken = frame.unionByName(spark.createDataFrame([("a", 900, float("nan")), ("a", 901, None), ("d", 1, float("inf")), ("e", 0, None)], "id string, o int, v double"))
    arrays = broken.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("x"))
    want = {x["id"]: x for x in arrays.select("id", *(c.alias(n) for n, c in waveform.quality(F.col("x")).items())).collect()}
    for x in waveform.row_quality(broken, ["id"], ["o"], "v").collect():
        assert (x["finite_share"], x["flat_share"], x["reasons"]) == tuple(want[x["id"]][n] for n in ("finite_share", "flat_share", "reasons")), x["id"]


def test_segments_and_derivatives(spark):
    frame = spark.createDataFrame([("a", k, float(k * k)) for k in range(10)] + [("b", 0, 1.0)], "id string, o int, v double").repartition(3)
    made = {(x["id"], x["segment"]): x["samples"] for x in waveform.segments(frame, ["id"], ["o"], "v", 4).collect()}
    assert made == {("a", 0): [0.0, 1.0, 4.0, 9.0], ("a", 1): [16.0, 25.0, 36.0, 49.0], ("a", 2): [64.0, 81.0], ("b", 0): [1.0]}
    rows = {(x["id"], x["o"]): (x["slope"], x["curve"]) for x in waveform.derivatives(frame, ["id"], ["o"], "v", 10.0).collect()}
    assert rows["a", 0] == (None, None) and rows["a", 1] == (10.0, None) and rows["a", 5] == (90.0, 200.0) and rows["b", 0] == (None, None)


def test_table_functions_in_sql(spark):
    table_functions.register(spark)
    spark.createDataFrame([("u", 1, 0.0), ("u", 2, 5.0), ("u", 3, 50.0), ("v", 4, 7.0), ("v", 5, None)], "who string, id int, at double").createOrReplaceTempView("visits")
    made = spark.sql("SELECT * FROM gap_sessions(TABLE(visits) PARTITION BY who ORDER BY (at NULLS LAST, id), 'at', 10)")
    assert sorted((r["id"], r["session_index"], r["session_position"]) for r in made.collect()) == [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 1, 1), (5, 2, 1)]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM gap_sessions(TABLE(visits) PARTITION BY who ORDER BY (at), 'nope', 10)").collect()
    made = spark.sql("SELECT t.* FROM (SELECT '1.5 x  3' AS s UNION ALL SELECT NULL) r, LATERAL numbers_of(r.s) t ORDER BY place")
    assert [tuple(r) for r in made.collect()] == [(0, 1.5), (1, None), (2, 3.0)]


def test_labels_and_metric_text(spark):
    names = {"frozen": "Frozen {model}", "frozen_demographics": "Frozen {model} + Demo{mark}", "demographics": "Demo only{mark}"}
    rows = spark.createDataFrame([("frozen", "net", "none", 1.234, 0.5), ("frozen_demographics", "net", "age/sex", 2.0, None), ("demographics", "-", "age/sex/BMI", None, 1.0)], "c string, m string, f string, v double, s double")
    made = rows.select(reports.display_label(F.col("c"), F.col("m"), F.col("f"), names).alias("a"), reports.heatmap_label(F.col("c"), F.col("m"), names).alias("b"), reports.metric_text(F.col("v"), F.col("s"), F.col("c").startswith("frozen")).alias("t")).collect()
    assert [tuple(r) for r in made] == [("Frozen net", "Frozen net", "1.23\n±0.50"), ("Frozen net + Demo†", "Frozen net + Demo", "2.00"), ("Demo only", "Demo only", None)]
    with pytest.raises(Exception, match="no label"):
        rows.select(reports.display_label(F.col("c"), F.col("m"), F.col("f"), {"frozen": "x"})).collect()


def test_matrix_of_contrasts_is_complete_or_raises(spark):
    rows = spark.createDataFrame([("c", m, s, f"s{k}", "m", 10.0, 10.0 + k + (m == "b") + s) for m in "ab" for s in (1, 2) for k in range(6)], "cohort string, method string, seed int, subject_id string, measurement_id string, y_true double, y_pred double")
    specs = spark.createDataFrame([("x", "b", "a")], "contrast string, candidate string, reference string")
    made = contrasts.complete_contrasts(rows, specs, ["cohort"], {"cohort": ["c"], "contrast": ["x"]}, 50).first()
    assert made["delta"] == 1.0 and made["ci_low"] == made["ci_high"] == 1.0 and made["n_seeds"] == 2
    with pytest.raises(ValueError, match="missing"):
        contrasts.complete_contrasts(rows, specs, ["cohort"], {"cohort": ["c", "d"], "contrast": ["x"]}, 5)
    with pytest.raises(ValueError, match="unexpected"):
        contrasts.complete_contrasts(rows, specs, ["cohort"], {"cohort": ["c"], "contrast": ["y"]}, 5)
    faults = contrasts.missing_entries(rows.select("cohort", "seed"), {"cohort": ["c"], "seed": [1, 2, 3]})
    assert sorted((r["seed"], r["fault"]) for r in faults.collect()) == [(1, "repeated"), (2, "repeated"), (3, "missing")]
    summary = bootstrap.benchmark_summary(rows, ["cohort"], ["cohort", "method"], 50).where("method = 'a'").first()
    assert summary["mae"] == pytest.approx(4.0) and summary["mae_seed_sd"] == pytest.approx(math.sqrt(0.5)) and summary["mae_ci_low"] < 4 < summary["mae_ci_high"] and summary["n_seeds"] == 2
    with pytest.raises(ValueError, match="different units"):
        bootstrap.benchmark_summary(rows.where("seed = 1 or subject_id <> 's0'"), ["cohort"], ["cohort", "method"], 5)
