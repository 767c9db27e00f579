"""The registered queries on the driver's tables. Results are rounded to 6 decimals."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import ccm, crossval, distance, neighbors, spectral, splits
from ..operators.embedding import concat_embeddings, lagged_embed, with_target
from ..operators.simplex import loo, simplex
from ..operators.smap import smap
from ..sources import generate
from ..sources.series import aggregated, from_table, read
from . import workflows

U = ("user_id",)
HALF = 0.5
THETAS = [0.0, 0.1, 0.3, 1.0, 2.0, 4.0, 8.0]
LIB_SIZES, N_SAMPLES, SEED, POOL, PRIME = [10, 20, 40, 80], 10, 42, range(1, 200), 1_000_003
E_GRID, TAU_GRID = [1, 2, 3], [1, 2]


def _r(c, n: int = 6):
    return F.round(c, n)


# -- series ------------------------------------------------------------------------


def users(spark: SparkSession, d: str) -> DataFrame:
    return from_table(read(spark, d, "events"), ["ts", "event_id"], {"x": "value"}, U)


def hours(spark: SparkSession, d: str) -> DataFrame:
    return aggregated(read(spark, d, "events"), F.date_trunc("hour", "ts"), F.avg("value"))


def revenue(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("x"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("y"))


def both_days(spark: SparkSession, d: str) -> DataFrame:
    """t, x (revenue by ship date in millions), y (orders by order date in millions) of the days that have both."""
    j = revenue(spark, d).join(orders(spark, d), "day")
    return from_table(j, ["day"], {"x": F.col("x") / 1e6, "y": F.col("y") / 1e6})


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _halves(series: DataFrame, keys=(), e: int = 2) -> tuple[DataFrame, DataFrame]:
    """Embedding of e lags with the next value as target: the first half of each series is the library, the rest the queries."""
    s = with_target(series, 1, keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    emb = lagged_embed(s.withColumn("n", n), 1, e, keys, keep=["y0", "n"])
    first = F.col("t") < F.floor(F.col("n") * HALF)
    return emb.where(first & F.col("y0").isNotNull()).drop("n"), emb.where(~first & F.col("y0").isNotNull()).drop("n").withColumnRenamed("y0", "truth")


# -- embedding and neighbours ------------------------------------------------------


def embed_user(spark, d):
    e = lagged_embed(with_target(users(spark, d), 1, U), 2, 3, U, keep=["y0"])
    return e.select("user_id", "t", "x0", "x1", "x2", "y0")


def embed_multivariate(spark, d):
    s = both_days(spark, d)
    e = concat_embeddings([lagged_embed(s, 1, 2, x="x"), lagged_embed(s, 2, 2, x="y")])
    return e.select("t", *[_r(f"x{i}", 8).alias(f"x{i}") for i in range(4)])


def knn_user(spark, d):
    lib, qry = _halves(users(spark, d), U)
    return neighbors.knn(lib, qry.select(*U, "t", "x0", "x1"), 3, U, ["x0", "x1"]).select("user_id", "qt", F.col("rank").cast("long").alias("rank"), "lt", _r("d").alias("d"))


def knn_vectors(spark, d):
    v = vectors(spark, d)
    out = neighbors.vector_knn(v, v.where("id % 50 = 0"), 5)
    return out.select("qt", F.col("rank").cast("long").alias("rank"), "lt", _r("d").alias("d"))


def simplex_user(spark, d):
    lib, qry = _halves(users(spark, d), U)
    return simplex(lib, qry, U, keep=["truth"]).select("user_id", "t", _r("pred0").alias("pred"), "truth")


def simplex_hour(spark, d):
    lib, qry = _halves(hours(spark, d))
    return simplex(lib, qry, keep=["truth"]).select("t", _r("pred0").alias("pred"), _r("truth").alias("truth"))


def simplex_multi_target(spark, d):
    s = with_target(with_target(users(spark, d), 1, U), 2, U, name="y1")
    e = lagged_embed(s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*U))), 1, 2, U, keep=["y0", "y1", "n"]).where("y1 IS NOT NULL")
    first = F.col("t") < F.floor(F.col("n") * HALF)
    out = simplex(e.where(first), e.where(~first).select("user_id", "t", "x0", "x1"), U, targets=("y0", "y1"))
    return out.select("user_id", "t", _r("pred0").alias("pred0"), _r("pred1").alias("pred1"))


def simplex_masked(spark, d):
    lib, qry = _halves(users(spark, d), U)
    lib = lib.withColumn("keep", F.col("t") % 3 != 0)
    return simplex(lib, qry, U, mask="keep").select("user_id", "t", _r("pred0").alias("pred"))


def loo_user(spark, d):
    e = lagged_embed(with_target(users(spark, d), 1, U), 1, 2, U, keep=["y0"]).where("y0 IS NOT NULL")
    return loo(e, 1, U).select("user_id", "t", _r("pred0").alias("pred"))


def loo_hour(spark, d):
    e = lagged_embed(with_target(hours(spark, d), 1), 1, 2, keep=["y0"]).where("y0 IS NOT NULL")
    return loo(e, 1).select("t", _r("pred0").alias("pred"))


def loo_diagnostic_user(spark, d):
    return workflows.loo_diagnostic(users(spark, d), 2, 1, keys=U).select("user_id", _r("rho").alias("rho"))


# -- S-Map -------------------------------------------------------------------------


def smap_linear_hour(spark, d):
    lib, qry = _halves(hours(spark, d))
    return smap(lib.drop("x1"), qry.drop("x1"), 0.0).select("t", _r("pred0").alias("pred"))


def smap_local_e1(spark, d):
    lib, qry = _halves(hours(spark, d))
    return smap(lib.drop("x1"), qry.drop("x1"), 2.0).select("t", _r("pred0").alias("pred"))


def smap_local_e2(spark, d):
    lib, qry = _halves(hours(spark, d))
    return smap(lib, qry, 2.0).select("t", _r("pred0").alias("pred"))


def smap_local_e3(spark, d):
    lib, qry = _halves(hours(spark, d), e=3)
    return smap(lib, qry, 2.0).select("t", _r("pred0").alias("pred"))


def nonlinearity_hour(spark, d):
    return workflows.nonlinearity(hours(spark, d), 2, 1, THETAS).select("theta", _r("rho").alias("rho"))


def smap_theta_sweep(spark, d):
    lib, qry = _halves(hours(spark, d))
    p = smap(lib.drop("x1"), qry.drop("x1"), THETAS, keep=["truth"])
    return p.groupBy("theta").agg(_r(metrics.rho(F.col("pred0"), F.col("truth"))).alias("rho"))


# -- metrics -----------------------------------------------------------------------


def _two_dims(spark, d):
    s = with_target(with_target(users(spark, d), 1, U), 2, U, name="y1")
    e = lagged_embed(s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*U))), 1, 2, U, keep=["y0", "y1", "n"]).where("y1 IS NOT NULL")
    first = F.col("t") < F.floor(F.col("n") * HALF)
    p = simplex(e.where(first), e.where(~first), U, targets=("y0", "y1"), keep=["y0", "y1"])
    obs = p.select("user_id", "t", F.col("y0").alias("obs0"), F.col("y1").alias("obs1"))
    return metrics.compared(p.select("user_id", "t", "pred0", "pred1"), obs, U, 2)


def metric_rhos(spark, d):
    return metrics.rhos(_two_dims(spark, d), U).select("user_id", F.col("dim").cast("long").alias("dim"), _r("rho").alias("rho"))


def metric_mean_rho(spark, d):
    return metrics.mean_rho(_two_dims(spark, d), U).select("user_id", _r("mean_rho").alias("mean_rho"))


def metric_rmse(spark, d):
    return metrics.errors(_two_dims(spark, d), U).select("user_id", _r("rmse").alias("rmse"))


def metric_mae(spark, d):
    return metrics.errors(_two_dims(spark, d), U).select("user_id", _r("mae").alias("mae"))


# -- folds and search --------------------------------------------------------------


def _folded(spark, d, folds):
    s = hours(spark, d)
    n = s.count()
    return splits.frame(spark, folds(n)).select(F.col("fold").cast("long").alias("fold"), "train_start", "train_end", "val_start", "val_end")


def fold_temporal(spark, d):
    return _folded(spark, d, lambda n: [splits.temporal_fold(n, 0.7, gap=3)])


def fold_expanding(spark, d):
    return _folded(spark, d, lambda n: splits.expanding_folds(n, 100, 40, stride=30, gap=2))


def fold_sliding(spark, d):
    return _folded(spark, d, lambda n: splits.sliding_folds(n, 100, 40, gap=2))


def _scores(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("E", "tau", "fold")], _r("score").alias("score"))


def scan_hour(spark, d):
    return _scores(crossval.scan(hours(spark, d), E_GRID, TAU_GRID))


def scan_user(spark, d):
    split = lambda n: splits.sliding_folds(n, 20, 10)
    return _scores(crossval.scan(users(spark, d), [1, 2], [1], U, split=split), "user_id")


def scan_expanding_rmse(spark, d):
    split = lambda n: splits.expanding_folds(n, 200, 100)
    return _scores(crossval.scan(hours(spark, d), E_GRID, TAU_GRID, split=split, metric=metrics.rmse))


def select_hour(spark, d):
    return crossval.select(crossval.scan(hours(spark, d), E_GRID, TAU_GRID)).select(F.col("E").cast("long").alias("E"), F.col("tau").cast("long").alias("tau"), _r("mean").alias("mean"))


def e_curve(spark, d):
    s = crossval.summary(crossval.scan(hours(spark, d), E_GRID, [1]))
    return s.select(F.col("E").cast("long").alias("E"), _r("mean").alias("mean"), _r("adjusted").alias("adjusted"), "n")


def dimension_curve_hour(spark, d):
    c = workflows.dimension_curve(hours(spark, d), E_GRID)
    return c.select(F.col("E").cast("long").alias("E"), _r("mean").alias("mean"), _r("adjusted").alias("adjusted"))


def expanding_errors_hour(spark, d):
    c = workflows.expanding_errors(hours(spark, d), E_GRID, TAU_GRID, 200, 100)
    return c.select(F.col("E").cast("long").alias("E"), F.col("tau").cast("long").alias("tau"), _r("mean").alias("mean"))


def noise_floor_hour(spark, d):
    s = hours(spark, d)
    c = workflows.noise_floor(s, E_GRID, TAU_GRID, order=_mixed(s.count()))
    return c.select(F.col("E").cast("long").alias("E"), F.col("tau").cast("long").alias("tau"), _r("mean").alias("mean"))


def lag_range_hour(spark, d):
    return spark.createDataFrame([(i,) for i in workflows.lag_range(hours(spark, d), 48)], "lag long")


# -- causality ---------------------------------------------------------------------


def ccm_draws(spark, d):
    out = ccm.draws(spark, LIB_SIZES, N_SAMPLES, list(POOL), ccm.sampler(SEED))
    return out.select(F.col("lib_size").cast("long").alias("lib_size"), F.col("sample").cast("long").alias("sample"), "slot", "idx")


def spread() -> ccm.Sampler:
    """Draws with replacement by whole-number arithmetic that SQL can repeat; each call has its own."""
    calls = count()

    def sample(pool: np.ndarray, size: int) -> np.ndarray:
        i, c = np.arange(size), next(calls)
        return pool[(i * i * 7919 + i * 31 + c * 104729) % PRIME % len(pool)]

    return sample


def _mixed(n: int) -> list[int]:
    """A permutation of 0 ... n - 1 by arithmetic that SQL can repeat, for n that PRIME doesn't divide."""
    return [(t * PRIME + 13) % n for t in range(n)]


def _cross(n: int) -> dict:
    """Arguments of a cross mapping over the whole of n days: the first half is the library pool, the rest is predicted; sizes double up to the pool."""
    pool = range(1, n // 2)
    return {"lib_sizes": sorted({max(len(pool) >> k, 1) for k in range(4)}), "library_pool": pool, "prediction_pool": range(n // 2, n), "e": 2, "n_samples": N_SAMPLES, "sample": spread()}


def _out(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in ("lib_size", "sample") else _r(c).alias(c) for c in df.columns])


def ccm_bootstrap(spark, d):
    s = both_days(spark, d)
    return _out(ccm.run(s, "y", "x", **_cross(s.count())))


def ccm_mean(spark, d):
    s = both_days(spark, d)
    return _out(ccm.with_simplex(s, "y", "x", **_cross(s.count())))


def ccm_reverse(spark, d):
    s = both_days(spark, d)
    return _out(ccm.with_simplex(s, "x", "y", **_cross(s.count())))


def ccm_bands(spark, d):
    s = both_days(spark, d)
    return _out(ccm.bands(ccm.run(s, "y", "x", **_cross(s.count()))))


def ccm_smap(spark, d):
    s = both_days(spark, d)
    return _out(ccm.with_smap(s, "y", "x", theta=2.0, **_cross(s.count())))


def ccm_surrogate(spark, d):
    s = both_days(spark, d)
    n = s.count()
    mixed = ccm.shuffled(s, "x", n, order=_mixed(n))
    return _out(ccm.with_simplex(mixed, "y", "x", aggregate=F.median, **_cross(n)))


# -- distances and spectra ---------------------------------------------------------


def acf_hour(spark, d):
    return spectral.autocorrelation(hours(spark, d), 48).select("lag", _r("acf").alias("acf"))


def acf_user(spark, d):
    return spectral.autocorrelation(users(spark, d), 10, 2, U).select("user_id", "lag", _r("acf").alias("acf"))


def tau_first_below(spark, d):
    return spectral.first_below(spectral.autocorrelation(users(spark, d), 20, keys=U), keys=U)


def pairwise_vectors(spark, d):
    v = vectors(spark, d)
    return distance.pairwise_distance(v.where("id % 50 = 0"), v).select("id_a", "id_b", _r("d2").alias("d2"))


def pairwise_self(spark, d):
    """All pairs of the whole table."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return distance.pairwise_distance(v, block=2000, digits=6).select("id_a", "id_b", "d2")


def dtw_users(spark, d):
    """Each user's values against those of the user with the next id."""
    s = users(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda p: p["x"]).alias("a"))
    both = s.join(s.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b")), "user_id")
    return distance.dtw(both, "a", "b", ["user_id"]).select("user_id", _r("dtw").alias("dtw"))


def pad_orders(spark, d):
    """Each customer's order prices, in time, padded to the longest list."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))), lambda p: p["o_totalprice"]).alias("v"))
    p = distance.padded(o, "v")
    return p.select(F.col("o_custkey").cast("long").alias("o_custkey"), F.posexplode("v").alias("pos", "value")).select("o_custkey", F.col("pos").cast("long").alias("pos"), "value")


# -- sources -----------------------------------------------------------------------


def gen_lorenz(spark, d):
    out = generate.lorenz(spark, [{"sigma": 10.0, "rho": 28.0, "beta": 8.0 / 3.0, "X0": (1.0, 1.0, 1.0), "dt": 0.01, "t_max": 4.0}])
    return out.select("t", *[_r(c).alias(c) for c in ("x", "y", "z")])


def gen_mackey_glass(spark, d):
    out = generate.mackey_glass(spark, [{"tau": 17.0, "n": 10, "beta": 0.2, "gamma": 0.1, "x0": 1.2, "dt": 1.0, "t_max": 200.0}])
    return out.select("t", _r("x").alias("x"))


_PENDULUM = {"m1": 1.0, "m2": 1.0, "L1": 1.0, "L2": 1.0, "g": 9.81, "X0": (1.0, 0.5, 0.0, 0.0), "dt": 0.01, "t_max": 2.0}


def gen_double_pendulum(spark, d):
    out = generate.double_pendulum(spark, [_PENDULUM])
    return out.select("t", *[_r(c).alias(c) for c in ("theta1", "theta2", "omega1", "omega2")])


def to_xy(spark, d):
    out = generate.double_pendulum(spark, [_PENDULUM]).select("t", *generate.to_xy(1.0, 1.0))
    return out.select("t", *[_r(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


def gen_logistic(spark, d):
    out = generate.logistic(spark, [{"rx": 3.8, "ry": 3.5, "coupling": 0.02, "x0": 0.4, "y0": 0.2, "n": 60}])
    return out.select("t", _r("x").alias("x"), _r("y").alias("y"))
