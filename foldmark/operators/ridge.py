"""Fold-wise weighted Ridge from additive moments.

A row's weight depends on its own subject only, so the weighted cross products of every cell (fold, inner fold) are taken in one
pass, once for each row, and every training pool is a sum of cells. What a pool's own transform does to the features (gaps filled with the pool's
weighted median, an indicator for each feature with gaps, z-scores) is linear in a row's values and gap flags, so it is applied to the
moments. Weights are scaled to mean 1 in each pool, so that a penalty means the same in pools of any size. A D x D system is solved for each
pool, all penalties from one eigen-decomposition. Moments are taken about the overall means, which keeps their precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring
from .sampling import group_folds

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
_EPSILON = float(np.finfo(float).eps)


def weighted(rows: DataFrame) -> DataFrame:
    """With `w`: 1 / (rows of the measurement x measurements of the subject)."""
    measured = rows.groupBy("subject_id", "measurement_id").agg(F.count("*").alias("_rows"))
    subject = measured.groupBy("subject_id").agg(F.count("*").alias("_measurements"))
    weights = measured.join(subject, "subject_id").select("subject_id", "measurement_id", (1 / (F.col("_rows") * F.col("_measurements"))).alias("w"))
    return rows.join(weights, ["subject_id", "measurement_id"])


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _packed(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of rows and weighted cross products of (1, z, y), flat."""
    t = np.column_stack((np.ones(len(z)), z, y))
    return np.concatenate(([len(z)], ((t * w[:, None]).T @ t).ravel()))


def cell_moments(rows: DataFrame, cells: list[str], values: str = "z", targets: str = "ys", weight: str = "w") -> DataFrame:
    """(cells, moments array<double>): number of rows and cross products of (1, values, targets) of each cell; partial sums in tasks, then one sum by element."""
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in cells), "moments array<double>"])

    def partial(batches):
        for pdf in batches:
            for key, part in pdf.groupby(cells, sort=False, dropna=False):
                m = _packed(np.stack(part[values].to_numpy()).astype(float), np.stack(part[targets].to_numpy()).astype(float), part[weight].to_numpy(float))
                yield pd.DataFrame([[*(key if isinstance(key, tuple) else (key,)), m]], columns=[*cells, "moments"])

    return summed(rows.select(*cells, values, targets, weight).mapInPandas(partial, schema), cells)


def summed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, moments): moments of cells added up by element."""
    parts = cells.select(*keys, F.posexplode("moments").alias("i", "m")).groupBy(*keys, "i").agg(F.sum("m").alias("m"))
    return parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_m")).select(*keys, F.col("_m.m").alias("moments"))


def solve_path(moments: np.ndarray, alphas, n_targets: int = 1, medians: np.ndarray | None = None, gaps: tuple[int, ...] = (), plain: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(intercepts, coefficients, features): the Ridge path of a pool; (alphas, targets) and (alphas, targets, values), and how many features it had.

    Values are the features, 0 where they have a gap, then the flags of the features that have gaps in any pool (`gaps`); medians fill the
    gaps of these. The last `plain` features are not scaled. A feature of no spread has no coefficient.
    """
    n, size = moments[0], int(round((len(moments) - 1) ** 0.5))
    m = moments[1:].reshape(size, size)
    m = m * (n / m[0, 0])  # weights of mean 1
    d = size - 1 - n_targets - len(gaps)
    flagged = [k for k in range(len(gaps)) if m[1 + d + k, 0] > 0]  # features with gaps in this pool
    made = np.zeros((d + len(flagged), d + len(gaps)))
    made[:d, :d] = np.eye(d)
    for k, j in enumerate(gaps):
        made[j, d + k] = 0.0 if medians is None or not np.isfinite(medians[k]) else medians[k]
    for k, flag in enumerate(flagged):
        made[d + k, d + flag] = 1.0
    total, mean = m[0, 0], m[0, 1:] / m[0, 0]
    centred = m[1:, 1:] - total * np.outer(mean, mean)
    values = slice(0, d + len(gaps))
    gram, cross = made @ centred[values, values] @ made.T, made @ centred[values, d + len(gaps) :]
    spread = np.sqrt(np.maximum(np.diag(gram) / total, 0.0))
    scale = np.where(spread <= _EPSILON, 1.0, spread)
    scale[d - plain : d] = 1.0
    eigen, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    turned = vectors.T @ (cross / scale[:, None])
    found = np.stack([(vectors @ (turned / (np.maximum(eigen, 0.0) + a)[:, None])) / scale[:, None] for a in alphas])  # alphas, features, targets
    coefficients = np.einsum("aft,fv->atv", found, made)
    return mean[d + len(gaps) :] - coefficients @ mean[values], coefficients, d + len(flagged)


def best_alpha(scores: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(keys, alpha, mae): the smallest score; of those within the tolerance the largest alpha."""
    least = scores.groupBy(*keys).agg(F.min("mae").alias("_least"))
    return scores.join(least, keys).where(F.col("mae") <= F.col("_least") + tolerance).groupBy(*keys).agg(F.max("alpha").alias("alpha"), F.max("_least").alias("mae"))


def _predictions(rows: DataFrame, keep: list[str], models: dict, names: list[str]) -> DataFrame:
    """(keep, outer, held, alpha, target, y_true, y_pred): each row by the models whose outer fold and inner fold say so.

    models: {(outer, held or None): (alphas, intercepts, coefficients)}, as many as folds x inner folds; `names` are the targets'.
    """
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), "outer int, held int, alpha double, target string, y_true double, y_pred double"])

    def run(batches):
        for pdf in batches:
            for (outer, held), (alphas, b, c) in models.items():
                part = pdf[(pdf["fold"] == outer) if held is None else (pdf["fold"] != outer) & (pdf["inner_fold"] == held)]
                if not len(part):
                    continue
                guess = np.einsum("nv,atv->atn", np.stack(part["z"].to_numpy()).astype(float), c) + b[:, :, None]
                truth = np.stack(part["ys"].to_numpy()).astype(float)
                for i, a in enumerate(alphas):
                    for t, name in enumerate(names):
                        if np.isfinite(c[i, t]).all():
                            yield part[keep].assign(outer=outer, held=-1 if held is None else held, alpha=a, target=name, y_true=truth[:, t], y_pred=guess[i, t])

    return rows.mapInPandas(run, schema)


def nested(rows: DataFrame, targets: tuple[str, ...] = ("y",), inner: int = 3, alphas=ALPHAS, plain: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, selection, tuning): out-of-fold predictions of all outer folds in one job, the choice for each fold and target, the inner scores.

    rows: subject_id, measurement_id, fold (in which the subject is a test subject), features (null, NaN and infinity are gaps), the targets. Of each
    outer fold the other folds are the pool; subjects are dealt to inner folds by size within their fold, the penalty is
    chosen by the macro MAE of the pool's inner out-of-fold predictions, and the pool is refitted. The last `plain` features stay unscaled.
    """
    spark = rows.sparkSession
    parts = rows.select(F.posexplode("features").alias("dim", "x")).groupBy("dim").agg(F.avg(F.when(_finite(F.col("x")), F.col("x"))).alias("mean"), F.max((~_finite(F.col("x"))).cast("int")).alias("gap")).orderBy("dim").collect()  # a row for each feature
    shift, gaps = [p["mean"] or 0.0 for p in parts], tuple(p["dim"] for p in parts if p["gap"])
    level = rows.agg(*(F.avg(t).alias(t) for t in targets)).first()
    x = F.zip_with("features", F.array(*map(F.lit, shift)), lambda a, s: F.when(_finite(a), a - s).otherwise(0.0))
    flags = [(~_finite(F.get("features", F.lit(j)))).cast("double") for j in gaps]
    dealt = group_folds(rows, ["fold"], "subject_id", inner).select("subject_id", "inner_fold")
    base = weighted(rows).join(dealt, "subject_id")
    ready = base.select("subject_id", "measurement_id", "fold", "inner_fold", "w", "features", F.concat(x, F.array(*flags).cast("array<double>")).alias("z"), F.array(*((F.col(t) - F.lit(float(level[t] or 0.0))).cast("double") for t in targets)).alias("ys"))
    # a row for each cell: folds x inner folds of D x D moments
    cells = {(r["fold"], r["inner_fold"]): np.asarray(r["moments"]) for r in cell_moments(ready, ["fold", "inner_fold"]).collect()}
    folds, inners = sorted({f for f, _ in cells}), sorted({i for _, i in cells})
    pools = {(o, h): [m for (f, i), m in cells.items() if f != o and i != h] for o in folds for h in (*inners, None)}
    medians = _pool_medians(ready, gaps, shift, list(pools)) if gaps else {}
    models, widths = {}, {}
    for pool, members in pools.items():
        if members:
            b, c, widths[pool] = solve_path(np.sum(members, axis=0), alphas, len(targets), medians.get(pool), gaps, plain)
            models[pool] = (tuple(alphas), b, c)
    keep = ["subject_id", "measurement_id", "fold", "inner_fold"]
    tried = _predictions(ready, keep, {p: m for p, m in models.items() if p[1] is not None}, list(targets))
    selection = best_alpha(scoring.macro_mae(tried, ["outer", "target", "alpha"]), ["outer", "target"])
    scores = scoring.macro_mae(tried, ["outer", "held", "target", "alpha"]).withColumnsRenamed({"held": "inner_fold", "mae": "validation_mae"})
    counted = ready.groupBy("fold", "inner_fold").agg(F.count_distinct("subject_id").alias("n"), F.count("*").alias("rows"))
    of_pool = F.broadcast(spark.createDataFrame([(o,) for o in folds], "outer int"))  # a row for each fold
    inside = counted.join(of_pool, F.col("fold") != F.col("outer"))
    sizes = inside.groupBy("outer").agg(F.sum("n").alias("n_subjects"), F.sum("rows").alias("n_rows"))
    held = inside.groupBy("outer", "inner_fold").agg(F.sum("n").alias("n_validation_subjects"))
    tuning = scores.join(held, ["outer", "inner_fold"]).join(sizes, "outer").withColumn("n_fit_subjects", F.col("n_subjects") - F.col("n_validation_subjects")).drop("n_subjects", "n_rows")
    finals = {(o, h): m for (o, h), m in models.items() if h is None}
    add = F.element_at(F.create_map(*(x for t in targets for x in (F.lit(t), F.lit(float(level[t] or 0.0))))), F.col("target"))
    tested = _predictions(ready, keep, finals, list(targets)).join(F.broadcast(selection.select("outer", "target", "alpha")), ["outer", "target", "alpha"])
    predictions = tested.select("subject_id", "measurement_id", "fold", "target", "alpha", (F.col("y_true") + add).alias("y_true"), (F.col("y_pred") + add).alias("y_pred"))
    width = F.broadcast(spark.createDataFrame([(o, n) for (o, h), n in widths.items() if h is None], "outer int, input_dimension int"))
    return predictions, selection.join(sizes, "outer").join(width, "outer"), tuning


def _pool_medians(ready: DataFrame, gaps: tuple[int, ...], shift: list[float], pools: list[tuple]) -> dict:
    """{pool: medians about the shift}: the lower weighted median of each feature with gaps, over the rows of the pool that have it."""
    pairs = F.array(*(F.struct(F.lit(j).alias("dim"), (F.get("features", F.lit(j)) - shift[j]).alias("x")) for j in gaps))
    values = ready.select("fold", "inner_fold", "w", F.explode(pairs).alias("p")).where(_finite(F.col("p.x"))).groupBy("fold", "inner_fold", "p.dim", "p.x").agg(F.sum("w").alias("w"))
    few = F.broadcast(ready.sparkSession.createDataFrame([(o, -1 if h is None else h) for o, h in pools], "outer int, held int"))  # folds x inner folds
    member = values.join(few, (values["fold"] != few["outer"]) & (values["inner_fold"] != few["held"]))
    out = {}
    for r in scoring.lower_weighted_median(member, ["outer", "held", "dim"], "x", "w").collect():  # a row for each pool and feature with gaps
        out.setdefault((r["outer"], None if r["held"] == -1 else r["held"]), np.full(len(gaps), np.nan))[gaps.index(r["dim"])] = r["median"]
    return out


def benchmark(rows: DataFrame, labels: dict[str, str], cap: int | None = None, seed: str = "cap", **options) -> tuple[DataFrame, DataFrame]:
    """(predictions, diagnostics) of the nested Ridge with literal label columns and identity decoding.

    cap: at most so many rows of a subject are fitted and predicted. Diagnostics: rows, subjects, chosen penalty and spread of each fold and target.
    """
    from .sampling import capped

    used = rows if cap is None else capped(rows, ["subject_id"], ["measurement_id"], cap, seed)
    made, chosen, _ = nested(used, **options)
    constant = {**{k: F.lit(v) for k, v in labels.items()}, "decoder_mean": F.lit(0.0), "decoder_sd": F.lit(1.0), "estimator_output": F.col("y_pred")}
    spread = made.groupBy("fold", "target").agg(F.count("*").alias("n_rows"), F.countDistinct("subject_id").alias("n_subjects"), F.stddev_samp("y_pred").alias("prediction_sd"), F.stddev_samp("y_true").alias("truth_sd"))
    return made.withColumns(constant), spread.join(chosen.select(F.col("outer").alias("fold"), "target", "alpha", "mae", "input_dimension"), ["fold", "target"])
