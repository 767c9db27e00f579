"""Simplex projection: forecasts by exponentially weighted nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .embedding import coordinates
from .neighbors import enough, pairs, ranked

#: The nearest distance counts as this much at least.
LEAST = 1e-6


def weighted(near: DataFrame, k: int, keys: Sequence[str], targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """keys, t, pred0 ... from ranked pairs. Queries with fewer than k neighbours have no row.

    The weights' least distance is taken over the partitioning of the ranks, so
    ranking, weighting and averaging share one shuffle.
    """
    least = F.greatest(F.min("d").over(Window.partitionBy(*keys, "qt")), F.lit(LEAST))
    w = near.withColumn("w", F.exp(-F.col("d") / least))
    preds = [(F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias(f"pred{i}") for i, y in enumerate(targets)]
    out = w.groupBy(*keys, "qt").agg(F.count(F.lit(1)).alias("_n"), *preds, *[F.first(f"q_{c}").alias(c) for c in keep])
    return out.where(F.col("_n") == k).drop("_n").withColumnRenamed("qt", "t")


def simplex(library: DataFrame, query: DataFrame, keys: Sequence[str] = (), targets: Sequence[str] = ("y0",), coords: Sequence[str] | None = None, mask: str | None = None, keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """keys, t, pred0 ...: forecasts of the queries from their E + 1 nearest library points.

    mask: a boolean library column; only true rows are points. keep: query columns
    (such as the truth) that come along. strict: raise if a key's library has too
    few points; otherwise its queries have no rows.
    """
    coords = list(coords or coordinates(library))
    missing = [c for c in (*coords, *targets) if c not in library.columns]
    if missing:
        raise ValueError(f"library and targets must have the same length and columns; missing: {missing}")
    if mask is not None:
        library = library.where(F.col(mask))
    k = len(coords) + 1
    if strict:
        enough(library, k, keys)
    return weighted(ranked(pairs(library, query, coords, keys, carry=targets), k, keys), k, keys, targets, keep)


def loo(library: DataFrame, theiler_window: int, keys: Sequence[str] = (), targets: Sequence[str] = ("y0",), coords: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """keys, t, pred0 ...: each point forecast from the others, without those nearer in time than or as near as the Theiler window.

    A key needs n - (2W + 1) >= E + 1 points, else it has no rows (or raises).
    """
    if theiler_window < 0:
        raise ValueError("theiler_window must be non-negative")
    coords = list(coords or coordinates(library))
    k = len(coords) + 1
    least = k + 2 * theiler_window + 1
    if strict:
        enough(library, least, keys, "Not enough points for the Theiler window")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else F.lit(library.count())
    able = library.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")
    apart = F.abs(F.col("qt") - F.col("lt")) > theiler_window
    found = pairs(able, able.select(*keys, "t", *coords), coords, keys, on=apart, carry=targets)
    return weighted(ranked(found, k, keys), k, keys, targets)
