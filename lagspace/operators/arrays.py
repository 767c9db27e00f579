"""Predictors that are functions of arrays: (X, Y, Q) -> predictions at Q."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (library states, library targets, query states) -> a row of predictions per query state.
ArrayFunc = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def by_key(fn: ArrayFunc, library: DataFrame, query: DataFrame, keys: Sequence[str], coords: Sequence[str], targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """keys, t, keep ..., pred0 ...: fn applied to one key's arrays at a time. Each key's rows go to one task, so keys must be bounded; there must be one at least."""
    if not keys:
        raise ValueError("keys are needed: a key's rows meet in one task")
    types = dict(library.dtypes) | dict(query.dtypes)
    cols = [*keys, "t", *keep, *[f"pred{i}" for i in range(len(targets))]]
    ddl = ", ".join(f"`{c}` {types.get(c, 'double') if c != 't' else 'long'}" for c in cols)

    def kernel(lib: pd.DataFrame, qry: pd.DataFrame) -> pd.DataFrame:
        if not len(lib) or not len(qry):
            return pd.DataFrame({c: [] for c in cols})
        lib, qry = lib.sort_values("t"), qry.sort_values("t")
        # A state may have fewer coordinates than there are columns: the others are null throughout.
        use = [c for c in coords if lib[c].notna().any()]
        p = np.asarray(fn(lib[use].to_numpy(float), lib[list(targets)].to_numpy(float), qry[use].to_numpy(float)), dtype=float).reshape(len(qry), -1)
        if p.shape[1] != len(targets):
            raise ValueError(f"Shape mismatch: {p.shape[1]} predicted columns, {len(targets)} expected")
        return qry[[*keys, "t", *keep]].assign(**{f"pred{i}": p[:, i] for i in range(len(targets))})[cols]

    left, right = library.select(*keys, "t", *coords, *targets), query.select(*keys, "t", *coords, *keep)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(kernel, ddl)
