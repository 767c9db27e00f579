"""Convergent cross mapping: does a series' reconstructed state tell the values of another?

"cause drives effect" is tested by embedding the effect and forecasting the cause
from it, with libraries of growing size drawn from a pool with replacement.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import rho
from .arrays import ArrayFunc, by_key
from .embedding import coordinates, lagged_embed
from .simplex import simplex
from .smap import smap

Sampler = Callable[[np.ndarray, int], np.ndarray]


def sampler(seed: int | None = 42) -> Sampler:
    """Draws with replacement from a pool; one stream of random numbers per sampler."""
    rng = np.random.default_rng(seed)
    return lambda pool, size: rng.choice(pool, size=size, replace=True)


def library_sizes(largest: int, smallest: int = 10, count: int = 10) -> list[int]:
    """Whole sizes, evenly spaced on a log scale (small ones may repeat)."""
    return np.logspace(np.log10(smallest), np.log10(largest), count).astype(int).tolist()


def draws(spark: SparkSession, lib_sizes: Sequence[int], n_samples: int, pool: Sequence[int], sample: Sampler | None = None) -> DataFrame:
    """lib_size, sample, slot, idx: library members by position; sizes outer, samples inner. What is drawn is bounded by the sizes asked for, not by the data."""
    if n_samples <= 0:
        raise ValueError("n_samples must be positive")
    if any(s <= 0 for s in lib_sizes) or not len(lib_sizes):
        raise ValueError("lib_sizes must be positive")
    if not len(pool):
        raise ValueError("the library pool is empty")
    sample, members = sample or sampler(), np.asarray(pool)
    rows = [(int(size), k, i, int(v)) for size in lib_sizes for k in range(n_samples) for i, v in enumerate(sample(members, size))]
    return spark.createDataFrame(rows, "lib_size int, sample int, slot long, idx long")


def bootstrap(effect: DataFrame, cause: DataFrame, drawn: DataFrame, prediction_pool: DataFrame, theta: float | None = None, alpha: float = 1e-10, predict: ArrayFunc | None = None) -> DataFrame:
    """lib_size, sample, rho. effect: t, x0 ... (embedded); cause: t, y0; prediction_pool: t.

    A point that was drawn twice is two neighbours. With theta, forecasts are by
    S-Map, with predict by that function of a sample's arrays, else by simplex
    projection. Each (size, sample) is a key of the pairs,
    so samples spread over tasks.
    """
    by = ["lib_size", "sample"]
    points = effect.join(cause, "t")
    library = drawn.join(points, drawn.idx == points.t).drop("idx")
    pool = points.join(prediction_pool.select("t").distinct(), "t", "left_semi").withColumnRenamed("y0", "truth")
    keys = drawn.select(*by).distinct().withColumn("_all", F.lit(1))
    query = pool.withColumn("_all", F.lit(1)).join(F.broadcast(keys), "_all").drop("_all")
    coords = coordinates(effect)
    if predict is not None:
        pred = by_key(predict, library, query, by, coords, ["y0"], ["truth"])
    elif theta is None:
        pred = simplex(library, query, by, coords=coords, keep=["truth"])
    else:
        pred = smap(library, query, theta, alpha, by, coords=coords, keep=["truth"])
    return pred.groupBy(*by).agg(rho(F.col("pred0"), F.col("truth")).alias("rho"))


def ccm(samples: DataFrame, aggregate: Callable[[Column], Column] = F.avg) -> DataFrame:
    """lib_size, rho: samples reduced by size."""
    if not callable(aggregate):
        raise ValueError("aggregate_func must be callable")
    return samples.groupBy("lib_size").agg(aggregate(F.col("rho")).alias("rho"))


def bands(samples: DataFrame, levels: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """lib_size, low, median, high: exact quantiles, linearly interpolated."""
    q = F.percentile("rho", F.array(*[F.lit(float(v)) for v in levels]))
    return samples.groupBy("lib_size").agg(q.alias("q")).select("lib_size", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "median", "high"))])


def run(series: DataFrame, effect: str, cause: str, lib_sizes: Sequence[int], library_pool: Sequence[int], prediction_pool: Sequence[int], e: int, tau: int = 1, n_samples: int = 100, theta: float | None = None, alpha: float = 1e-10, sample: Sampler | None = None) -> DataFrame:
    """lib_size, sample, rho of "cause drives effect" for a series t with both columns. Pools are positions t."""
    spark = series.sparkSession
    embedded = lagged_embed(series, tau, e, x=effect)
    pool = spark.createDataFrame([(int(t),) for t in prediction_pool], "t long")
    drawn = draws(spark, lib_sizes, n_samples, library_pool, sample)
    return bootstrap(embedded, series.select("t", F.col(cause).alias("y0")), drawn, pool, theta, alpha)


def with_simplex(series: DataFrame, effect: str, cause: str, lib_sizes: Sequence[int], library_pool: Sequence[int], prediction_pool: Sequence[int], e: int, tau: int = 1, n_samples: int = 100, aggregate: Callable[[Column], Column] = F.avg, sample: Sampler | None = None) -> DataFrame:
    return ccm(run(series, effect, cause, lib_sizes, library_pool, prediction_pool, e, tau, n_samples, sample=sample), aggregate)


def with_smap(series: DataFrame, effect: str, cause: str, lib_sizes: Sequence[int], library_pool: Sequence[int], prediction_pool: Sequence[int], theta: float, e: int, tau: int = 1, alpha: float = 1e-10, n_samples: int = 100, aggregate: Callable[[Column], Column] = F.avg, sample: Sampler | None = None) -> DataFrame:
    return ccm(run(series, effect, cause, lib_sizes, library_pool, prediction_pool, e, tau, n_samples, theta, alpha, sample), aggregate)


def shuffled(series: DataFrame, column: str, n: int, seed: int = 0, order: Sequence[int] | None = None) -> DataFrame:
    """The series with one column's values permuted over the positions 0 ... n - 1 (by order if given): the noise floor."""
    order = np.random.default_rng(seed).permutation(n).tolist() if order is None else order
    moves = series.sparkSession.createDataFrame(list(enumerate(order)), "t long, _from long")
    values = series.select(F.col("t").alias("_from"), F.col(column).alias("_v"))
    return series.join(moves, "t").join(values, "_from").drop(column, "_from").withColumnRenamed("_v", column)
