"""Scores of forecasts: aggregates with partial sums on the map side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A metric is (prediction, observation) -> aggregate.
Metric = Callable[[Column, Column], Column]


def rho(p: Column, o: Column) -> Column:
    """Pearson correlation; 0 where either side doesn't vary, or there is nothing to compare."""
    return F.coalesce(F.try_divide(F.covar_pop(p, o), F.stddev_pop(p) * F.stddev_pop(o)), F.lit(0.0))


def rmse(p: Column, o: Column) -> Column:
    return F.sqrt(F.avg((p - o) * (p - o)))


def mae(p: Column, o: Column) -> Column:
    return F.avg(F.abs(p - o))


def compared(pred: DataFrame, obs: DataFrame, keys: Sequence[str] = (), dims: int = 1) -> DataFrame:
    """keys, t, dim, pred, obs in long form, from pred0 ... and obs0 ... frames; both must have the same numbers of columns, and the same times: one that a side lacks fails the query when it runs."""
    p = [c for c in pred.columns if c.startswith("pred") and c[4:].isdigit()]
    o = [c for c in obs.columns if c.startswith("obs") and c[3:].isdigit()]
    if len(p) != dims or len(o) != dims:
        raise ValueError(f"Shape mismatch: {len(p)} predicted and {len(o)} observed columns, {dims} expected")
    both = pred.withColumn("_p", F.lit(True)).join(obs.withColumn("_o", F.lit(True)), [*keys, "t"], "full_outer")
    # The check stands in the rows themselves, so that no optimisation leaves it out.
    alone = F.when(F.col("_p").isNull() | F.col("_o").isNull(), F.raise_error(F.lit("Shape mismatch: predictions and observations have different times")).cast("int"))
    both = both.where(F.coalesce(alone, F.lit(0)) == 0).drop("_p", "_o")
    return both.select(*keys, "t", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"pred{i}").alias("pred"), F.col(f"obs{i}").alias("obs")) for i in range(dims)])).alias("c")).select(*keys, "t", "c.*")


def rhos(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, dim, rho."""
    return long.groupBy(*keys, "dim").agg(rho(F.col("pred"), F.col("obs")).alias("rho"))


def mean_rho(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, mean_rho: the mean of the correlations of the dimensions."""
    return rhos(long, keys).groupBy(*keys).agg(F.avg("rho").alias("mean_rho"))


def errors(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rmse, mae over all times and dimensions."""
    return long.groupBy(*keys).agg(rmse(F.col("pred"), F.col("obs")).alias("rmse"), mae(F.col("pred"), F.col("obs")).alias("mae"))
