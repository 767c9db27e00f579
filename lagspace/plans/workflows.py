"""Whole analyses in one call. Every function returns a DataFrame; only single parameters are collected on the way."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import arrays, ccm, crossval, spectral, splits
from ..operators.embedding import coordinates, lagged_embed, with_target
from ..operators.simplex import loo, simplex
from ..operators.smap import smap


def aligned(series: DataFrame, e: int, tau: int, tp: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Embedded states with the target tp steps ahead (y0) and the series' length n; rows without a target are left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else F.lit(series.count())
    s = with_target(series.withColumn("n", n), tp, keys)
    return lagged_embed(s, tau, e, keys, keep=["y0", "n"]).where("y0 IS NOT NULL")


def split(embedded: DataFrame, e: int, tau: int, ratio: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Library and queries in time; the last (e - 1) * tau library rows, whose states reach into the queries' past, are dropped."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must be between 0 and 1")
    at = F.floor(F.col("n") * ratio)
    return embedded.where(F.col("t") < at - (e - 1) * tau).drop("n"), embedded.where(F.col("t") >= at).drop("n").withColumnRenamed("y0", "truth")


def forecast(series: DataFrame, E: Sequence[int], tau: Sequence[int], tp: int = 1, ratio: float = 0.7) -> DataFrame:
    """rho, rmse, mae, E, tau: search the embedding, forecast the last part of the series from the first, score."""
    ahead = with_target(series, tp).where("y0 IS NOT NULL")
    e, lag, _ = crossval.selected(crossval.scan(ahead, E, tau, y="y0"))
    lib, qry = split(aligned(series, e, lag, tp), e, lag, ratio)
    p = simplex(lib, qry, keep=["truth"])
    c = (F.col("pred0"), F.col("truth"))
    return p.agg(metrics.rho(*c).alias("rho"), metrics.rmse(*c).alias("rmse"), metrics.mae(*c).alias("mae")).withColumn("E", F.lit(e)).withColumn("tau", F.lit(lag))


def loo_diagnostic(series: DataFrame, e: int, tau: int, tp: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rho of leave-one-out forecasts with a Theiler window of (e - 1) * tau."""
    s = aligned(series, e, tau, tp, keys).drop("n")
    both = loo(s, (e - 1) * tau, keys).join(s.select(*keys, "t", "y0"), [*keys, "t"])
    return both.groupBy(*keys).agg(metrics.rho(F.col("pred0"), F.col("y0")).alias("rho"))


def nonlinearity(series: DataFrame, e: int, tau: int, thetas: Sequence[float] = (0, 0.1, 0.3, 1, 2, 4, 8), tp: int = 1, ratio: float = 0.7) -> DataFrame:
    """theta, rho: a rise with theta shows that the dynamics depend on the state."""
    lib, qry = split(aligned(series, e, tau, tp), e, tau, ratio)
    p = smap(lib, qry, list(thetas), keep=["truth"])
    return p.groupBy("theta").agg(metrics.rho(F.col("pred0"), F.col("truth")).alias("rho"))


def dimension_curve(series: DataFrame, E: Sequence[int], tau: int = 1, tp: int = 1) -> DataFrame:
    """E, mean, adjusted: validation scores by dimension."""
    ahead = with_target(series, tp).where("y0 IS NOT NULL")
    return crossval.summary(crossval.scan(ahead, E, [tau], y="y0")).select("E", "mean", "adjusted")


def lag_range(series: DataFrame, max_lag: int) -> list[int]:
    """Lags to search: 1 up to the first whose autocorrelation is below 1/e (1 at least)."""
    return list(range(1, max(1, spectral.first_below(spectral.autocorrelation(series, max_lag)).first().tau) + 1))


def expanding_errors(series: DataFrame, E: Sequence[int], tau: Sequence[int], initial: int, validation: int, tp: int = 1) -> DataFrame:
    """E, tau, mean: root mean squared errors over expanding folds (smaller is better)."""
    ahead = with_target(series, tp).where("y0 IS NOT NULL")
    folds = lambda n: splits.expanding_folds(n, initial, validation)
    return crossval.summary(crossval.scan(ahead, E, tau, y="y0", split=folds, metric=metrics.rmse)).select("E", "tau", "mean")


def noise_floor(series: DataFrame, E: Sequence[int], tau: Sequence[int], seed: int = 0, order: Sequence[int] | None = None) -> DataFrame:
    """E, tau, mean of the same search on a series permuted by chance, or by order."""
    n = series.count()
    return crossval.summary(crossval.scan(ccm.shuffled(series, "x", n, seed, order), E, tau)).select("E", "tau", "mean")


def both_directions(series: DataFrame, a: str, b: str, lib_sizes: Sequence[int], library_pool: Sequence[int], prediction_pool: Sequence[int], e: int, tau: int = 1, n_samples: int = 20, theta: float | None = None) -> DataFrame:
    """cause, effect, lib_size, rho for "a drives b" and "b drives a"."""
    parts = []
    for cause, effect in ((a, b), (b, a)):
        samples = ccm.run(series, effect, cause, lib_sizes, library_pool, prediction_pool, e, tau, n_samples, theta)
        parts.append(ccm.ccm(samples).select(F.lit(cause).alias("cause"), F.lit(effect).alias("effect"), "lib_size", "rho"))
    return parts[0].unionByName(parts[1])


def causal_bands(series: DataFrame, effect: str, cause: str, lib_sizes: Sequence[int], library_pool: Sequence[int], prediction_pool: Sequence[int], e: int, tau: int = 1, n_samples: int = 100) -> DataFrame:
    """lib_size, low, median, high, floor: quantiles of the samples, and the median for a shuffled cause."""
    args = (lib_sizes, library_pool, prediction_pool, e, tau, n_samples)
    found = ccm.bands(ccm.run(series, effect, cause, *args))
    floor = ccm.ccm(ccm.run(ccm.shuffled(series, cause, series.count()), effect, cause, *args), F.median)
    return found.join(floor.withColumnRenamed("rho", "floor"), "lib_size")


def array_predictor(fn: arrays.ArrayFunc, library: DataFrame, query: DataFrame, keys: Sequence[str], targets: Sequence[str] = ("y0",)) -> DataFrame:
    """keys, t, pred0 ... by a function (X, Y, Q) -> predictions of one key's arrays."""
    return arrays.by_key(fn, library, query, keys, coordinates(library), targets)
