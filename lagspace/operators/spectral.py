"""Autocorrelation by direct sums over lagged pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lags that keyed series take by windows in one pass; more are joined, as each is a column of the plan.
WINDOWED = 64


def autocorrelation(series: DataFrame, max_lag: int, step: int = 1, keys: Sequence[str] = (), x: str = "x") -> DataFrame:
    """keys, lag, acf for lags 0, step, ... below max_lag and the length (biased: divided by n times the population variance). A constant series has null.

    Keyed series are shuffled once on their keys: a window over the key gives each row its lagged values.
    """
    if max_lag <= 0 or step <= 0:
        raise ValueError("max_lag and step must be positive")
    keys = list(keys)
    every = Window.partitionBy(*keys)
    base = series.select(*keys, "t", F.col(x).alias("x"))
    if keys:
        c = base.withColumn("c", F.col("x") - F.avg("x").over(every)).withColumn("n", F.count(F.lit(1)).over(every)).withColumn("var", F.var_pop("x").over(every))
    else:
        stats = base.agg(F.avg("x").alias("_m"), F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("var"))
        c = base.crossJoin(F.broadcast(stats)).withColumn("c", F.col("x") - F.col("_m")).drop("_m")
    steps = range(0, max_lag, step)
    if keys and len(steps) <= WINDOWED:
        at = Window.partitionBy(*keys).orderBy("t")
        lagged = c.dropna(subset=keys).select(*keys, "n", "var", *[(F.col("c") * F.lag("c", k).over(at)).alias(f"_{k}") for k in steps])
        sums = lagged.groupBy(*keys, "n", "var").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in steps])
        out = sums.select(*keys, "n", "var", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("s")) for k in steps])).alias("_s")).select(*keys, "n", "var", "_s.*")
        return _scaled(out, keys)
    # Each value is sent to the positions it is the lag of; both sides share the partitioning by position. They are never broadcast: the planner knows nothing of the lags' number.
    lags = c.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(max_lag - 1), F.lit(step))).alias("lag"), "t", F.col("c").alias("lagged"))
    lags = lags.withColumn("t", F.col("t") + F.col("lag"))
    both = c.join(lags.hint("merge"), [*keys, "t"])
    return _scaled(both.groupBy(*keys, "lag", "n", "var").agg(F.sum(F.col("c") * F.col("lagged")).alias("s")), keys)


def _scaled(out: DataFrame, keys: Sequence[str]) -> DataFrame:
    return out.where(F.col("lag") < F.col("n")).select(*keys, F.col("lag").cast("long").alias("lag"), F.try_divide(F.col("s"), F.col("n") * F.col("var")).alias("acf"))


def first_below(acf: DataFrame, level: float = 0.36787944117144233, keys: Sequence[str] = ()) -> DataFrame:
    """keys, tau: the first lag whose autocorrelation is below a level (1/e), or 0 if none is."""
    return acf.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("acf") < level, F.col("lag"))), F.lit(0)).cast("long").alias("tau"))
