"""S-Map: locally weighted linear forecasts with a small ridge.

Pairs are reduced to one row of weighted moments per query, combined on the map
side; the (E + 1)-square systems are then solved in closed form for one or two
coordinates and by a batched kernel beyond. With theta = 0 the moments are the same for
all queries of a key, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding import coordinates
from .neighbors import enough, pairs

LEAST_MEAN, LEAST_TRACE = 1e-6, 1e-12


def local_weight(d: Column, mean: Column, theta: Column) -> Column:
    return F.exp(-theta * d / F.greatest(mean, F.lit(LEAST_MEAN)))


def _moments(w: Column, x: Sequence[Column], y: Sequence[Column]) -> list[Column]:
    a = [F.lit(1.0), *x]
    out = [F.sum(w * a[i] * a[j]).alias(f"m{i}_{j}") for i in range(len(a)) for j in range(i, len(a))]
    return out + [F.sum(w * a[i] * t).alias(f"v{k}_{i}") for k, t in enumerate(y) for i in range(len(a))]


def _solved(df: DataFrame, x: Sequence[str], n_targets: int, alpha: float) -> DataFrame:
    """Add pred0 ... of the queries x from the moment columns."""
    e = len(x)
    m = lambda i, j: F.col(f"m{min(i, j)}_{max(i, j)}")
    trace = m(0, 0)
    for i in range(1, e + 1):
        trace = trace + m(i, i)
    ridge = F.lit(alpha) * F.greatest(trace, F.lit(LEAST_TRACE))
    df = df.withColumn("_r", ridge)
    a = lambda i, j: m(i, j) + F.col("_r") if i == j and i else m(i, j)
    if e == 1:
        det = a(0, 0) * a(1, 1) - a(0, 1) * a(0, 1)
        for k in range(n_targets):
            v0, v1 = F.col(f"v{k}_0"), F.col(f"v{k}_1")
            c0, c1 = F.try_divide(v0 * a(1, 1) - a(0, 1) * v1, det), F.try_divide(a(0, 0) * v1 - a(0, 1) * v0, det)
            df = df.withColumn(f"pred{k}", c0 + c1 * F.col(x[0]))
        return df
    if e == 2:

        def det3(r: list[list[Column]]) -> Column:
            return r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])

        full = [[a(i, j) for j in range(3)] for i in range(3)]
        for k in range(n_targets):
            v = [F.col(f"v{k}_{i}") for i in range(3)]
            cs = [F.try_divide(det3([[v[i] if j == c else full[i][j] for j in range(3)] for i in range(3)]), det3(full)) for c in range(3)]
            df = df.withColumn(f"pred{k}", cs[0] + cs[1] * F.col(x[0]) + cs[2] * F.col(x[1]))
        return df
    names = df.columns
    ddl = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + "".join(f", pred{k} double" for k in range(n_targets))

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            big = np.empty((len(f), e + 1, e + 1))
            for i in range(e + 1):
                for j in range(i, e + 1):
                    big[:, i, j] = big[:, j, i] = f[f"m{i}_{j}"]
            for i in range(1, e + 1):
                big[:, i, i] += f["_r"]
            q = np.column_stack([np.ones(len(f)), *[f[c] for c in x]])
            for k in range(n_targets):
                v = np.column_stack([f[f"v{k}_{i}"] for i in range(e + 1)])
                try:
                    c = np.linalg.solve(big, v[:, :, None])[:, :, 0]
                except np.linalg.LinAlgError:
                    c = np.array([np.linalg.solve(b, u) if abs(np.linalg.det(b)) > 0 else np.full(e + 1, np.nan) for b, u in zip(big, v)])
                p = (q * c).sum(1)
                f[f"pred{k}"] = pd.Series(p, index=f.index).where(np.isfinite(p), None)
            yield f[[*names, *[f"pred{k}" for k in range(n_targets)]]]

    return df.mapInPandas(kernel, ddl)


def smap(library: DataFrame, query: DataFrame, theta: float | Sequence[float], alpha: float = 1e-10, keys: Sequence[str] = (), targets: Sequence[str] = ("y0",), coords: Sequence[str] | None = None, mask: str | None = None, keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """keys, [theta,] t, pred0 ...: forecasts by regressions that weight library points by their distance to the query.

    theta: one value, or several (a sweep), which then is a column. Library rows
    with a missing coordinate or target, or a false mask, take no part. Keys with
    fewer than E + 1 points have no rows, or raise with strict. A singular system
    gives null.
    """
    thetas = [float(v) for v in ([theta] if isinstance(theta, (int, float)) else theta)]
    if any(v < 0 for v in thetas):
        raise ValueError("theta must be non-negative")
    coords = list(coords or coordinates(library))
    missing = [c for c in (*coords, *targets) if c not in library.columns]
    if missing:
        raise ValueError(f"library and targets must have the same length and columns; missing: {missing}")
    if mask is not None:
        library = library.where(F.col(mask))
    library = library.dropna(subset=[*coords, *targets])
    if strict:
        enough(library, len(coords) + 1, keys, "Not enough valid points")
    sweep = not isinstance(theta, (int, float))
    out = None
    local = [v for v in thetas if v > 0]
    need = len(coords) + 1
    q_names = [f"q_{c}" for c in coords]
    if any(v == 0 for v in thetas):
        sums = library.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_moments(F.lit(1.0), [F.col(c) for c in coords], [F.col(y) for y in targets])).where(F.col("_n") >= need)
        qry = query.select(*keys, F.col("t").alias("qt"), *[F.col(c).alias(f"q_{c}") for c in [*coords, *keep]]).dropna(subset=q_names)
        one = (qry.join(sums, list(keys)) if keys else qry.join(F.broadcast(sums))).withColumn("theta", F.lit(0.0))
        out = one.select(*keys, "theta", "qt", *q_names, *[F.col(f"q_{c}").alias(c) for c in keep if c not in coords], *[c for c in sums.columns if c[0] in "mv" and "_" in c])
    if local:
        both = pairs(library, query, coords, keys, carry=targets)
        if len(local) == 1:
            both = both.withColumn("theta", F.lit(local[0]))
        mean = F.avg("d").over(Window.partitionBy(*keys, "qt"))
        both = both.withColumn("_mean", mean)
        if len(local) > 1:
            both = both.withColumn("theta", F.explode(F.array(*[F.lit(v) for v in local])))
        both = both.withColumn("w", local_weight(F.col("d"), F.col("_mean"), F.col("theta")))
        by = [*keys, "qt", "theta"]
        sums = both.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in q_names], *[F.first(f"q_{c}").alias(c) for c in keep if c not in coords], *_moments(F.col("w"), [F.col(f"l_{c}") for c in coords], [F.col(y) for y in targets])).where(F.col("_n") >= need).drop("_n")
        out = sums if out is None else out.unionByName(sums)
    solved = _solved(out, q_names, len(targets), alpha)
    return solved.select(*keys, *(["theta"] if sweep else []), F.col("qt").alias("t"), *[F.col(f"pred{k}") for k in range(len(targets))], *[c for c in keep if c not in coords])
