"""Pairs of queries and library points, and exact nearest neighbours.

Series with keys pair up by an equi-join on the keys. A single long series, or
vectors, are dealt to a grid of blocks first, so that no task has all of either
side. Ties go by (distance, library time, slot), in every strategy.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCKS, LIBRARY_BLOCK = 8, 20_000
#: Blocks of a side of all pairs of vectors, at most.
SIDE_BLOCKS = 200
#: Vectors of a side whose rounded distances are put in order at once, and rows of a batch of them.
TILE, BATCH = 2000, 1 << 16


def euclid(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance from direct differences, summed from left to right."""
    total = None
    for p, q in zip(a, b):
        d = (p - q) * (p - q)
        total = d if total is None else total + d
    return F.sqrt(total)


def pairs(library: DataFrame, query: DataFrame, coords: Sequence[str], keys: Sequence[str] = (), on: Column | None = None, carry: Sequence[str] = (), library_rows: int | None = None) -> DataFrame:
    """keys, qt, lt, slot, d, carried library columns, and query columns as q_<name>: all pairs within a key.

    on: a further condition on the columns qt and lt. Rows with a missing
    coordinate take no part. A library may have a ``slot`` column: repeated points
    of a sample with replacement are separate neighbours.
    """
    slot = F.col("slot") if "slot" in library.columns else F.lit(0)
    lib = library.select(*keys, F.col("t").alias("lt"), slot.cast("long").alias("slot"), *[F.col(c).alias(f"l_{c}") for c in coords], *carry).dropna(subset=[f"l_{c}" for c in coords])
    others = [c for c in query.columns if c not in (*keys, "t", *coords)]
    qry = query.select(*keys, F.col("t").alias("qt"), *[F.col(c).alias(f"q_{c}") for c in [*coords, *others]]).dropna(subset=[f"q_{c}" for c in coords])
    by = list(keys)
    if not by:
        n = library_rows if library_rows is not None else library.count()
        blocks = max(1, -(-n // LIBRARY_BLOCK))
        lib = lib.withColumn("_l", F.pmod("lt", F.lit(blocks)).cast("int")).withColumn("_q", F.explode(F.array(*[F.lit(i) for i in range(QUERY_BLOCKS)])))
        qry = qry.withColumn("_q", F.pmod("qt", F.lit(QUERY_BLOCKS)).cast("int")).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        by = ["_q", "_l"]
    both = qry.join(lib, by)
    if on is not None:
        both = both.where(on)
    d = euclid([F.col(f"q_{c}") for c in coords], [F.col(f"l_{c}") for c in coords])
    return both.withColumn("d", d).drop("_q", "_l")


def ranked(found: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The k nearest pairs of each query, with rank from 1. The literal bound lets the planner cut rows before the shuffle."""
    if k < 1:
        raise ValueError("k must be positive")
    w = Window.partitionBy(*keys, "qt").orderBy("d", "lt", "slot")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def enough(library: DataFrame, k: int, keys: Sequence[str] = (), what: str = "Not enough points") -> None:
    """Raise if a key of the library has fewer than k points."""
    least = library.groupBy(*keys).count().agg(F.min("count")).first()[0]
    if least is None or least < k:
        raise ValueError(f"{what}: {least or 0} < {k}")


def knn(library: DataFrame, query: DataFrame, k: int, keys: Sequence[str] = (), coords: Sequence[str] = ("x0",), strict: bool = False) -> DataFrame:
    """keys, qt, rank, lt, d: the k nearest library points of each query, by Euclidean distance, ascending; a point is its own neighbour."""
    if strict:
        enough(library, k, keys)
    return ranked(pairs(library, query, coords, keys), k, keys).select(*keys, "qt", "rank", "lt", "d")


def _blocks(left: DataFrame, right: DataFrame, left_block: int, right_block: int, left_rows: int | None, right_rows: int | None) -> tuple[DataFrame, DataFrame]:
    a = max(1, -(-(left_rows if left_rows is not None else left.count()) // left_block))
    b = max(1, -(-(right_rows if right_rows is not None else right.count()) // right_block))
    left = left.withColumn("_a", F.pmod(F.xxhash64("id"), F.lit(a)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    # New names: both frames often come from one table.
    right = right.select(F.col("id").alias("id2"), F.col("v").alias("v2")).withColumn("_b", F.pmod(F.xxhash64("id2"), F.lit(b)).cast("int")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    return left, right


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in v]) if len(v) else np.zeros((0, 1))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, by direct differences in blocks of rows."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 4):  # so few that the differences stay in the cache
        diff = a[i : i + 4, None, :] - b[None, :, :]
        out[i : i + 4] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Numbers of 0 or more, rounded half up by their decimal form, as Spark's round does. What is too near a half for doubles goes by decimals."""
    scale = 10.0**digits
    with np.errstate(over="ignore", invalid="ignore"):
        y, small = d * scale, d < 2.0**52  # from there on all are whole
        out = np.where(small, np.rint(y) / scale, d)
        near = small & ~(np.abs(y - np.floor(y) - 0.5) > y * 2.0**-51)
    if near.any():
        unit, most = Decimal(1).scaleb(-digits), Context(prec=100)
        out[near] = [float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP, most)) for x in d[near].tolist()]
    return out


def _gathered(batches):
    """The rows (id, v) of a task as one row: its number, ids, the vectors' numbers (as floats where these are exact), and how many a vector has."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    v = t.column("v").combine_chunks()
    widths = np.unique(pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False))
    if len(widths) > 1 or widths[0] < 0:
        raise ValueError("vectors must be of one length")
    ids, numbers = t.column("id").combine_chunks(), v.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        short = numbers.astype(np.float32)
    if np.array_equal(short.astype(np.float64), numbers, equal_nan=True):
        numbers = short
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([numbers.tobytes()], pa.binary()), pa.array([int(widths[0])], pa.int32())], names=["n", "ids", "v", "width"])


def _block_rows(side: DataFrame, block: int) -> DataFrame:
    """n, ids, v, width: a row for each block of at most ``block`` vectors, or larger ones where there would be more than SIDE_BLOCKS; each in a partition of its own, written once."""
    n = max(1, min(SIDE_BLOCKS, -(-side.count() // block)))
    rows = side.select(F.col("id").cast("long").alias("id"), "v").repartition(n).withColumn("v", F.col("v").cast("array<double>")).mapInArrow(_gathered, "n int, ids array<bigint>, v binary, width int")
    return rows.checkpoint() if side.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def _numbers(v: pa.Scalar, rows: int, width: int) -> np.ndarray:
    b = v.as_buffer()
    return np.frombuffer(b, dtype=np.float32 if b.size == 4 * rows * width else np.float64).reshape(rows, width).astype(np.float64)


def _all_distances(batches, digits: int | None, mirrored: bool):
    """mirrored: a block's pairs with another block are given both ways."""
    rows, columns = (64, 1000) if digits is None else (TILE, TILE)
    for found in batches:
        for n_a, ids_a, a, k, n_b, ids_b, b, m in zip(*found.columns):
            if k.as_py() != m.as_py():
                raise ValueError("vectors must be of one length")
            ids_a, ids_b = (ids.values.to_numpy() for ids in (ids_a, ids_b))
            x, y = _numbers(a, len(ids_a), k.as_py()), _numbers(b, len(ids_b), m.as_py())
            twice = mirrored and n_a != n_b
            for i in range(0, len(x), rows):
                for j in range(0, len(y), columns):
                    left, right = ids_a[i : i + rows], ids_b[j : j + columns]
                    if digits is None:
                        d = squared_distances(x[i : i + rows], y[j : j + columns]).ravel()
                        order = np.arange(len(d))
                    else:
                        d = np.concatenate([rounded(squared_distances(x[h : min(h + 64, i + rows)], y[j : j + columns]).ravel(), digits) for h in range(i, min(i + rows, len(x)), 64)])
                        order = np.argsort(d)
                    for s in range(0, len(order), BATCH):
                        at = order[s : s + BATCH]
                        p, q = np.divmod(at, len(right))
                        p, q, z = left[p], right[q], d[at]
                        if twice:
                            p, q, z = np.column_stack([p, q]).ravel(), np.column_stack([q, p]).ravel(), np.repeat(z, 2)
                        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(z)], names=["id_a", "id_b", "d2"])


def vector_pairs(left: DataFrame, right: DataFrame, block: int = 1000, digits: int | None = None) -> DataFrame:
    """id_a, id_b, d2: squared Euclidean distances of all pairs of two frames (id, v array<double>), by a kernel on blocks of both.

    Each side is shuffled and written once, in blocks; a task of the product reads a
    block of either, so disk grows with the rows and not with their pairs. Two blocks
    of one frame meet once, and their pairs are given both ways.
    digits: d2 is rounded, and a task's rows go by d2: equal ones side by side take half the bytes in a file.
    """
    a = _block_rows(left, block)
    b = a if right is left else _block_rows(right, block)
    b = b.select(*[F.col(c).alias(f"{c}_b") for c in ("n", "ids", "v", "width")])
    # By the hint neither side is broadcast, whatever its size.
    both = a.hint("shuffle_replicate_nl").crossJoin(b)
    if right is left:
        both = both.where("n <= n_b")
    return both.mapInArrow(partial(_all_distances, digits=digits, mirrored=right is left), "id_a long, id_b long, d2 double")


def vector_knn(library: DataFrame, query: DataFrame, k: int, block: int = 4000) -> DataFrame:
    """qt, rank, lt, d of wide vectors (id, v): each pair of blocks gives its k best, and the best of these are ranked."""
    if k < 1:
        raise ValueError("k must be positive")
    q, lib = _blocks(query.select("id", "v"), library.select("id", "v"), 500, block, None, None)

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        y = y.sort_values("id2") if len(y) else y
        ids, m = (y.id2.to_numpy(), _matrix(y.v2)) if len(y) else (None, None)
        for i, v in zip(x.id, x.v) if len(y) else ():
            d2 = squared_distances(np.asarray(v, dtype=np.float64)[None, :], m)[0]
            best = np.lexsort((ids, d2))[:k]
            out.append(pd.DataFrame({"qt": i, "lt": ids[best], "slot": 0, "d": np.sqrt(d2[best])}))
        return pd.concat(out) if out else pd.DataFrame({"qt": [], "lt": [], "slot": [], "d": []}).astype({"qt": "int64", "lt": "int64", "slot": "int64"})

    found = q.groupBy("_a", "_b").cogroup(lib.groupBy("_a", "_b")).applyInPandas(kernel, "qt long, lt long, slot long, d double")
    return ranked(found, k).select("qt", "rank", "lt", "d")


