"""Time-delay embedding: state vectors of a series, targets and their alignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_lags(tau: int, e: int) -> None:
    if tau <= 0 or e <= 0:
        raise ValueError("tau and e must be positive")


def lagged_embed(series: DataFrame, tau: int, e: int, keys: Sequence[str] = (), x: str = "x", prefix: str = "x", keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """keys, t, x0 ... x{e-1} with x{j} = x at t - j*tau, for t >= (e-1)*tau; ``keep`` columns come along.

    The head goes by position, so a missing value isn't taken for a missing row.
    A key that is too short has no rows; with strict, it raises.
    """
    check_lags(tau, e)
    if x not in series.columns:
        raise ValueError(f"a 1D series column is needed: {x}")
    if strict:
        shortest = series.groupBy(*keys).count().agg(F.min("count")).first()[0]
        if shortest is None or (e - 1) * tau >= shortest:
            raise ValueError(f"(e - 1) * tau = {(e - 1) * tau} needs longer series than {shortest}")
    w = Window.partitionBy(*keys).orderBy("t")
    lags = [F.col(x).alias(f"{prefix}0"), *[F.lag(x, j * tau).over(w).alias(f"{prefix}{j}") for j in range(1, e)]]
    return series.select(*keys, "t", *[c for c in keep], *lags).where(F.col("t") >= (e - 1) * tau)


def with_target(series: DataFrame, tp: int, keys: Sequence[str] = (), y: str = "x", name: str = "y0") -> DataFrame:
    """The series with a target column: y at t + tp (null beyond the end; tp may be negative or 0)."""
    if tp == 0:
        return series.withColumn(name, F.col(y))
    w = Window.partitionBy(*keys).orderBy("t")
    return series.withColumn(name, F.lead(y, tp).over(w) if tp > 0 else F.lag(y, -tp).over(w))


def concat_embeddings(parts: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """A multivariate state: the coordinates of several embeddings side by side, x0, x1, ..., where all have the time."""
    renamed, n = [], 0
    for part in parts:
        own = [c for c in part.columns if c not in (*keys, "t")]
        renamed.append(part.select(*keys, "t", *[F.col(c).alias(f"x{n + i}") for i, c in enumerate(own)]))
        n += len(own)
    return reduce(lambda a, b: a.join(b, [*keys, "t"]), renamed)


def coordinates(df: DataFrame, prefix: str = "x") -> list[str]:
    """The coordinate columns x0, x1, ... of an embedded frame, in order."""
    found = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix) :]))
