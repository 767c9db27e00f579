"""Search of embedding parameters by cross-validation over time: one plan for the whole grid."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from .arrays import ArrayFunc, by_key
from .embedding import check_lags
from .simplex import LEAST
from .smap import local_weight
from .splits import Fold, sliding_folds

Split = Callable[[int], Sequence[Fold]]


class Simplex:
    """The default predictor of a scan: E + 1 nearest neighbours, exponentially weighted."""

    def forecasts(self, pairs: DataFrame, by: list[str], most: int, targets: int = 1) -> DataFrame:
        w = Window.partitionBy(*by, "qt").orderBy("d", "lt")
        near = pairs.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= most + 1) & (F.col("rank") <= F.col("E") + 1))
        near = near.withColumn("w", F.exp(-F.col("d") / F.greatest(F.min("d").over(Window.partitionBy(*by, "qt")), F.lit(LEAST))))
        pred = [(F.sum(F.col("w") * F.col(f"y{i}")) / F.sum("w")).alias(f"pred{i}") for i in range(targets)]
        return near.groupBy(*by, "qt").agg(*pred, *_observed(targets))


class SMap:
    """Local regressions in a scan; systems of any size are solved by a kernel on batches of moments. A singular system has no forecast (null)."""

    def __init__(self, theta: float, alpha: float = 1e-10):
        if theta < 0:
            raise ValueError("theta must be non-negative")
        self.theta, self.alpha = theta, alpha

    def forecasts(self, pairs: DataFrame, by: list[str], most: int, targets: int = 1) -> DataFrame:
        mean = F.avg("d").over(Window.partitionBy(*by, "qt"))
        p = pairs.withColumn("_mean", mean)
        p = p.withColumn("w", local_weight(F.col("d"), F.col("_mean"), F.lit(float(self.theta))))
        a = [F.lit(1.0), *[F.col("lc")[j] for j in range(most)]]
        sums = [F.sum(F.col("w") * a[i] * a[j]) for i in range(most + 1) for j in range(i, most + 1)]
        rows = p.groupBy(*by, "qt").agg(F.array(*sums).alias("m"), *[F.array(*[F.sum(F.col("w") * x * F.col(f"y{i}")) for x in a]).alias(f"v{i}") for i in range(targets)], F.first("qc").alias("qc"), *_observed(targets))
        alpha, names = self.alpha, [*by, "qt"]

        def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            i, j = np.triu_indices(most + 1)
            for f in frames:
                pred = np.full((len(f), targets), np.nan)
                for e in f.E.unique():
                    rows_of = np.flatnonzero(f.E.to_numpy() == e)
                    big = np.zeros((len(rows_of), most + 1, most + 1))
                    big[:, i, j] = big[:, j, i] = np.stack(f.m.to_numpy()[rows_of])
                    big = big[:, : e + 1, : e + 1]
                    big[:, range(1, e + 1), range(1, e + 1)] += alpha * np.maximum(np.trace(big, axis1=1, axis2=2), 1e-12)[:, None]
                    v = np.stack([np.stack(f[f"v{k}"].to_numpy()[rows_of])[:, : e + 1] for k in range(targets)], axis=2)
                    q = np.stack([np.r_[1.0, x[:e]] for x in f.qc.to_numpy()[rows_of]])
                    pred[rows_of] = np.einsum("nc,nct->nt", q, solved(big, v))
                yield f[[*names, *obs]].assign(**{f"pred{k}": pred[:, k] for k in range(targets)})[out]

        types, obs = dict(rows.dtypes), [f"obs{k}" for k in range(targets)]
        out = [*names, *[f"pred{k}" for k in range(targets)], *obs]
        return rows.mapInPandas(kernel, ", ".join(f"`{n}` {types.get(n, 'double')}" for n in out))


def solved(systems: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of a batch of systems; those of a singular one are not numbers."""
    try:
        return np.linalg.solve(systems, right)
    except np.linalg.LinAlgError:
        out = np.full(right.shape, np.nan)
        for k in range(len(systems)):
            try:
                out[k] = np.linalg.solve(systems[k], right[k])
            except np.linalg.LinAlgError:
                continue
        return out


def _observed(targets: int) -> list:
    return [F.first(f"truth{i}").alias(f"obs{i}") for i in range(targets)]


def default_split(raw: int) -> Split:
    return lambda n: sliding_folds(n, max(raw // 5, 2), max(raw // 10, 1))


def grid(lengths: Sequence[int], E: Sequence[int], tau: Sequence[int], split: Split | None) -> list[tuple]:
    """(n, E, tau, fold, max_lag, train and validation bounds) of every cell; folds that train on fewer than E + 1 points are left out and the others renumbered."""
    for e in E:
        for lag in tau:
            check_lags(lag, e)
    rows = []
    for n in lengths:
        for e in E:
            most = (e - 1) * max(tau)
            if n - most < 2:
                continue
            folds = [f for f in (split or default_split(n))(n - most) if f.train_end - f.train_start >= e + 1]
            if any(f.val_end - f.val_start != folds[0].val_end - folds[0].val_start for f in folds):
                raise ValueError("all validation ranges must have the same size")
            rows += [(n, e, lag, i, most, *f) for lag in tau for i, f in enumerate(folds)]
    return rows


def scan(series: DataFrame, E: Sequence[int], tau: Sequence[int], keys: Sequence[str] = (), x: str = "x", y: str | Sequence[str] | None = None, split: Split | None = None, predict: Simplex | SMap | ArrayFunc | None = None, metric: metrics.Metric = metrics.rho) -> DataFrame:
    """keys, E, tau, fold, score: validation scores of every cell and fold.

    All lags of a dimension use the same last n - (E - 1) * max(tau) positions. The
    target is y (x by default) at the same position; shift y beforehand for a
    horizon. Of several targets, correlations are averaged and other metrics are
    of all their values together. predict is Simplex, SMap, an object with a
    forecasts method like theirs, or a function (X, Y, Q) -> predictions of the
    arrays of one cell and fold. Cells without folds have no rows. Only the series' distinct lengths
    and the grid reach the driver; the grid is broadcast (cells x folds rows).
    """
    spark, keys = series.sparkSession, list(keys)
    w = Window.partitionBy(*keys).orderBy("t")
    counts = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    cells = grid([r.n for r in counts.select("n").distinct().collect()], E, tau, split)
    most, deepest = max(E), (max(E) - 1) * max(tau)
    lags = F.array(*[F.lag(x, j).over(w) if j else F.col(x) for j in range(deepest + 1)])
    targets = [x] if y is None else [y] if isinstance(y, str) else list(y)
    if not targets:
        raise ValueError("a search needs a target")
    k = range(len(targets))
    rows = series.select(*keys, "t", *[F.col(targets[i]).alias(f"y{i}") for i in k], lags.alias("lags"))
    rows = rows.join(counts, keys) if keys else rows.crossJoin(F.broadcast(counts))
    g = F.broadcast(spark.createDataFrame(cells, "n long, E int, tau int, fold int, max_lag int, a long, b long, c long, d long"))
    coords = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.when(j < F.col("E"), F.get("lags", j * F.col("tau"))).otherwise(F.lit(0.0)))
    by = [*keys, "E", "tau", "fold"]
    at = F.col("t") - F.col("max_lag")
    cut = rows.join(g, "n").withColumn("xs", coords)
    lib = cut.where((at >= F.col("a")) & (at < F.col("b"))).select(*by, F.col("t").alias("lt"), *[f"y{i}" for i in k], F.col("xs").alias("lc"))
    qry = cut.where((at >= F.col("c")) & (at < F.col("d"))).select(*by, F.col("t").alias("qt"), *[F.col(f"y{i}").alias(f"truth{i}") for i in k], F.col("xs").alias("qc"))
    if callable(predict) and not hasattr(predict, "forecasts"):
        states = lambda c: [F.when(F.col("E") > j, F.col(c)[j]).alias(f"x{j}") for j in range(most)]
        library = lib.select(*by, F.col("lt").alias("t"), *[f"y{i}" for i in k], *states("lc"))
        query = qry.select(*by, F.col("qt").alias("t"), *[F.col(f"truth{i}").alias(f"obs{i}") for i in k], *states("qc"))
        pred = by_key(predict, library, query, by, [f"x{j}" for j in range(most)], [f"y{i}" for i in k], [f"obs{i}" for i in k])
        return _scored(pred, by, metric, len(targets))
    squares = None
    for j in range(most):
        one = (F.col("qc")[j] - F.col("lc")[j]) * (F.col("qc")[j] - F.col("lc")[j])
        squares = one if squares is None else squares + one
    both = qry.join(lib, by).withColumn("d", F.sqrt(squares))
    return _scored((predict or Simplex()).forecasts(both, by, most, len(targets)), by, metric, len(targets))


def _scored(pred: DataFrame, by: list[str], metric: metrics.Metric, targets: int) -> DataFrame:
    """by, score from pred0 ... and obs0 ...."""
    each = [(F.col(f"pred{i}"), F.col(f"obs{i}")) for i in range(targets)]
    if metric is metrics.rho or targets == 1:
        return pred.groupBy(*by).agg((sum((metric(p, o) for p, o in each[1:]), metric(*each[0])) / targets if targets > 1 else metric(*each[0])).alias("score"))
    long = pred.select(*by, F.inline(F.array(*[F.struct(p.alias("pred"), o.alias("obs")) for p, o in each])))
    return long.groupBy(*by).agg(metric(F.col("pred"), F.col("obs")).alias("score"))


def summary(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, E, tau, n, mean, adjusted (mean less the standard error; a single fold has none)."""
    s = scores.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(*keys, "E", "tau")
    out = s.agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("_sd"))
    return out.withColumn("adjusted", F.col("mean") - F.coalesce(F.col("_sd") / F.sqrt("n"), F.lit(0.0))).drop("_sd")


#: Decimals to which cells are compared: float sums differ beyond them with the order of rows.
TIE_DECIMALS = 9


def select(scores: DataFrame, keys: Sequence[str] = (), E: Sequence[int] | None = None, tau: Sequence[int] | None = None) -> DataFrame:
    """keys, E, tau, mean of the best cell by mean less standard error; ties go to what stands first in the lists E, then tau (without lists: the smaller)."""
    first = [F.array_position(F.array(*[F.lit(v) for v in order]), F.col(c)) if order else F.col(c) for c, order in (("E", E), ("tau", tau))]
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("adjusted", TIE_DECIMALS)), *first)
    return summary(scores, keys).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "E", "tau", "mean")


def selected(scores: DataFrame) -> tuple[int, int, float]:
    """(E, tau, mean) of a search without keys; raises where nothing was scored."""
    best = select(scores).first()
    if best is None:
        raise ValueError("no cell has a score")
    return best.E, best.tau, best.mean
