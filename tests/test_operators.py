"""Small cases with known results, and properties that must hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagspace.functions import metrics
from lagspace.operators import ccm, crossval, distance, neighbors, spectral, splits
from lagspace.operators.embedding import concat_embeddings, coordinates, lagged_embed, with_target
from lagspace.operators.simplex import loo, simplex
from lagspace.operators.smap import smap
from lagspace.sources import generate


def logistic_values(n=500, r=3.8, x=0.4, drop=50):
    out = []
    for i in range(n + drop):
        if i >= drop:
            out.append(x)
        x = r * x * (1 - x)
    return out


def series(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "t long, x double")


def points(spark, xs, ys=None):
    rows = [(i, *map(float, np.atleast_1d(x)), *([] if ys is None else [float(ys[i])])) for i, x in enumerate(xs)]
    e = len(np.atleast_1d(xs[0]))
    return spark.createDataFrame(rows, ", ".join(["t long", *[f"x{j} double" for j in range(e)], *([] if ys is None else ["y0 double"])]))


def by_t(df, c="pred0"):
    return [r[c] for r in df.orderBy("t").collect()]


def test_embed_known_rows(spark):
    got = [tuple(r) for r in lagged_embed(series(spark, range(10)), 2, 3).orderBy("t").collect()]
    assert got[0] == (4, 4.0, 2.0, 0.0) and got[-1] == (9, 9.0, 7.0, 5.0) and len(got) == 6
    assert lagged_embed(series(spark, range(5)), 2, 3).count() == 1


@pytest.mark.parametrize(("tau", "e"), [(0, 1), (1, 0), (-1, 2)])
def test_embed_positive(spark, tau, e):
    with pytest.raises(ValueError, match="positive"):
        lagged_embed(series(spark, range(5)), tau, e)


def test_embed_too_short(spark):
    assert lagged_embed(series(spark, range(4)), 2, 3).count() == 0
    with pytest.raises(ValueError, match="tau"):
        lagged_embed(series(spark, range(4)), 2, 3, strict=True)


def test_embed_keeps_missing_values(spark):
    s = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "t long, x double")
    assert [tuple(r) for r in lagged_embed(s, 1, 2).orderBy("t").collect()] == [(1, None, 1.0), (2, 3.0, None)]


def test_concat(spark):
    s = series(spark, range(6))
    both = concat_embeddings([lagged_embed(s, 1, 2), lagged_embed(s, 2, 2)])
    assert coordinates(both) == ["x0", "x1", "x2", "x3"]
    assert tuple(both.orderBy("t").first()) == (2, 2.0, 1.0, 2.0, 0.0)


def test_knn_known(spark):
    lib, qry = points(spark, [0, 2, 5, 9]), points(spark, [1.5, 8])
    got = neighbors.knn(lib, qry, 2).orderBy("qt", "rank").collect()
    assert [(r.lt, r.d) for r in got] == [(1, 0.5), (0, 1.5), (3, 1.0), (2, 3.0)]
    with pytest.raises(ValueError, match="Not enough points"):
        neighbors.knn(lib, qry, 5, strict=True)


def test_vector_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.qt, r["rank"]): r.lt for r in neighbors.vector_knn(df, df, 4, block=16).collect()}
    for i in range(60):
        order = np.lexsort((np.arange(60), ((v - v[i]) ** 2).sum(1)))[:4]
        assert [got[i, k + 1] for k in range(4)] == order.tolist()


def test_simplex_identity_and_constant(spark):
    x, y = [0, 2, 5, 9], [10, 20, 30, 40]
    assert by_t(simplex(points(spark, x, y), points(spark, x))) == pytest.approx(y)
    assert by_t(simplex(points(spark, x, [7.5] * 4), points(spark, [0.3, 4]))) == pytest.approx([7.5, 7.5])
    got = by_t(simplex(points(spark, [0, 1, 2, 4, 7], [-2, 1, 3, 5, 8]), points(spark, [1.5, 3.5])))
    assert all(-2 <= v <= 8 for v in got)


def test_simplex_errors_and_mask(spark):
    lib = points(spark, [0, 1], [1, 2])
    with pytest.raises(ValueError, match="same length"):
        simplex(points(spark, [0, 1]), points(spark, [0]))
    with pytest.raises(ValueError, match="Not enough points"):
        simplex(lib.where("t = 0"), points(spark, [0]), strict=True)
    assert simplex(lib.where("t = 0"), points(spark, [0])).count() == 0
    rng = np.random.default_rng(2)
    big = points(spark, rng.normal(size=(14, 2)), rng.normal(size=14)).withColumn("keep", F.col("t") % 3 != 0)
    qry = points(spark, rng.normal(size=(5, 2)))
    assert by_t(simplex(big, qry, mask="keep")) == pytest.approx(by_t(simplex(big.where("keep"), qry)))


def test_keys_are_independent_problems(spark):
    rng = np.random.default_rng(0)
    parts = [(points(spark, rng.normal(size=(12, 2)), rng.normal(size=12)), points(spark, rng.normal(size=(5, 2)))) for _ in range(3)]
    lib, qry = [a.withColumn("b", F.lit(i)) for i, (a, _) in enumerate(parts)], [q.withColumn("b", F.lit(i)) for i, (_, q) in enumerate(parts)]
    both = simplex(lib[0].union(lib[1]).union(lib[2]), qry[0].union(qry[1]).union(qry[2]), ("b",))
    for i, (a, q) in enumerate(parts):
        assert by_t(both.where(F.col("b") == i)) == pytest.approx(by_t(simplex(a, q)))


def test_loo_is_naive_exclusion(spark):
    rng = np.random.default_rng(99)
    x, y, w = rng.normal(size=(60, 3)), rng.normal(size=60), 5
    got = by_t(loo(points(spark, x, y), w))
    for i in range(60):
        j = np.array([j for j in range(60) if abs(i - j) > w])
        d = np.sqrt(((x[j] - x[i]) ** 2).sum(1))
        near = np.lexsort((j, d))[:4]
        wt = np.exp(-d[near] / max(d[near].min(), 1e-6))
        assert got[i] == pytest.approx((wt * y[j[near]]).sum() / wt.sum())
    with pytest.raises(ValueError, match="Not enough"):
        loo(points(spark, x[:8], y[:8]), 5, strict=True)


def naive_smap(x, y, q, theta, alpha):
    out = []
    for p in q:
        d = np.sqrt(((x - p) ** 2).sum(1))
        w = np.exp(-theta * d / max(d.mean(), 1e-6))
        a = np.column_stack([np.ones(len(x)), x])
        m = (a * w[:, None]).T @ a
        m[range(1, len(m)), range(1, len(m))] += alpha * max(np.trace(m), 1e-12)
        out.append(np.r_[1.0, p] @ np.linalg.solve(m, (a * w[:, None]).T @ y))
    return out


@pytest.mark.parametrize("e", [1, 2, 3])
@pytest.mark.parametrize("theta", [0.0, 2.5])
def test_smap_matches_normal_equations(spark, e, theta):
    rng = np.random.default_rng(123 + e)
    x, y, q = rng.normal(size=(40, e)), rng.normal(size=40), rng.normal(size=(6, e))
    got = by_t(smap(points(spark, x, y), points(spark, q), theta, 1e-4))
    assert got == pytest.approx(naive_smap(x, y, q, theta, 1e-4), abs=1e-8)


def test_smap_cases(spark):
    line = points(spark, range(5), [1.5 + 2 * i for i in range(5)])
    assert by_t(smap(line, points(spark, [1.5, 2.5]), 0.0)) == pytest.approx([4.5, 6.5], abs=1e-6)
    assert by_t(smap(points(spark, range(5), [3.0] * 5), points(spark, [1.0]), 2.0, 100.0)) == pytest.approx([3.0])
    with pytest.raises(ValueError, match="non-negative"):
        smap(line, line, -1.0)
    with pytest.raises(ValueError, match="Not enough valid"):
        smap(line.where("t = 0"), line, 1.0, strict=True)
    sweep = smap(line, points(spark, [1.5]), [0.0, 1.0])
    assert sorted(r.theta for r in sweep.collect()) == [0.0, 1.0]


def test_metrics(spark):
    rows = [(t, d, float(p), float(o)) for t, (p0, p1, o0, o1) in enumerate([(1, 4, 2, 1), (2, 3, 4, 2), (3, 2, 6, 3), (4, 1, 8, 4)]) for d, p, o in ((0, p0, o0), (1, p1, o1))]
    long = spark.createDataFrame(rows, "t long, dim int, pred double, obs double")
    assert {r.dim: round(r.rho, 9) for r in metrics.rhos(long).collect()} == {0: 1.0, 1: -1.0}
    assert metrics.mean_rho(long).first()[0] == pytest.approx(0.0)
    err = metrics.errors(spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 2.0), (2, 5.0, 7.0)], "t long, pred double, obs double")).first()
    assert (err.rmse, err.mae) == pytest.approx((math.sqrt(5 / 3), 1.0))
    flat = spark.createDataFrame([(i, 2.0, float(i)) for i in range(3)], "t long, pred double, obs double")
    assert flat.agg(metrics.rho(F.col("pred"), F.col("obs"))).first()[0] == 0.0
    with pytest.raises(ValueError, match="Shape mismatch"):
        metrics.compared(flat, flat, dims=1)


def test_folds():
    assert splits.temporal_fold(12, 0.5, gap=2) == (0, 6, 8, 12)
    assert splits.expanding_folds(20, 6, 4, stride=3, gap=1) == [(0, 6, 7, 11), (0, 9, 10, 14), (0, 12, 13, 17), (0, 15, 16, 20)]
    assert splits.sliding_folds(20, 6, 4, stride=3, gap=1)[:2] == [(0, 6, 7, 11), (3, 9, 10, 14)]
    assert splits.sliding_folds(5, 6, 4) == []
    for bad, match in ((lambda: splits.temporal_fold(10, 1.0), "train_ratio"), (lambda: splits.temporal_fold(10, 0.95, gap=5), "Validation"), (lambda: splits.sliding_folds(10, 3, 2, stride=0), "stride")):
        with pytest.raises(ValueError, match=match):
            bad()


def test_fold_rows(spark):
    folds = splits.frame(spark, splits.sliding_folds(10, 4, 2))
    got = splits.assigned(series(spark, range(10)), folds).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in got} == {(i, role): n for i in range(3) for role, n in (("train", 4), ("val", 2))}


def test_scan_and_select_on_the_logistic_map(spark):
    s = series(spark, logistic_values())
    scores = crossval.scan(s, [1, 2, 3], [1, 2]).cache()
    count = {(r.E, r.tau): (r.n, r["mean"]) for r in crossval.summary(scores).collect()}
    assert [count[e, 1][0] for e in (1, 2, 3)] == [8, 7, 7]
    assert count[1, 1][1] == pytest.approx(0.999814, abs=1e-6) and count[3, 2][1] == pytest.approx(0.995341, abs=1e-6)
    assert crossval.selected(scores) == (1, 1, pytest.approx(0.999814, abs=1e-6))
    assert crossval.scan(series(spark, np.linspace(0, 1, 30)), [8], [2]).count() == 0
    with pytest.raises(ValueError):
        crossval.selected(scores.where("E > 9"))


def test_scan_with_smap(spark):
    s = series(spark, logistic_values(120))
    y = with_target(s, 1).where("y0 IS NOT NULL")
    got = {r.E: r["mean"] for r in crossval.summary(crossval.scan(y, [1, 2], [1], y="y0", predict=crossval.SMap(4.0))).collect()}
    assert got[1] > 0.9 and got[2] > 0.9


def test_select_prefers_the_stable_cell(spark):
    rows = [(2, 1, i, v) for i, v in enumerate([0.9, 0.5, 0.7])] + [(3, 1, i, v) for i, v in enumerate([0.71, 0.69, 0.7])]
    assert crossval.selected(spark.createDataFrame(rows, "E int, tau int, fold int, score double"))[0] == 3


def causal_pair(r2=3.5, b=0.02):
    x, y, out = 0.4, 0.2, []
    for i in range(1050):
        if i >= 50:
            out.append((i - 50, x, y))
        x, y = x * (3.8 - 3.8 * x), y * (r2 - r2 * y) + b * x
    return out


def test_ccm_finds_the_direction(spark):
    s = spark.createDataFrame(causal_pair(), "t long, x double, y double")
    sizes, lib, pred = [20, 160], range(1, 500), range(500, 1000)
    fwd = {r.lib_size: r.rho for r in ccm.with_simplex(s, "y", "x", sizes, lib, pred, 2, n_samples=6).collect()}
    rev = {r.lib_size: r.rho for r in ccm.with_simplex(s, "x", "y", sizes, lib, pred, 2, n_samples=6).collect()}
    assert fwd[160] - rev[160] > 0.2 and fwd[160] - fwd[20] > 0.2


def test_ccm_arguments(spark):
    with pytest.raises(ValueError, match="n_samples"):
        ccm.draws(spark, [5], 0, range(9))
    with pytest.raises(ValueError, match="lib_sizes"):
        ccm.draws(spark, [0], 1, range(9))
    with pytest.raises(ValueError, match="pool"):
        ccm.draws(spark, [5], 1, [])
    with pytest.raises(ValueError, match="aggregate_func"):
        ccm.ccm(spark.createDataFrame([(1, 0.5)], "lib_size int, rho double"), 3)
    a, b = (ccm.draws(spark, [5, 7], 3, range(50)).collect() for _ in range(2))
    assert a == b and len(a) == 36
    assert ccm.library_sizes(100, 10, 2) == [10, 100]


def test_repeated_points_are_separate_neighbours(spark):
    lib = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 0.0, 1.0), (1, 0, 1.0, 9.0)], "t long, slot long, x0 double, y0 double")
    assert by_t(simplex(lib, points(spark, [0.1]))) == pytest.approx([1.0])


def test_distances(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id long, v array<double>")
    assert {(r.id_a, r.id_b): r.d2 for r in distance.pairwise_distance(df).collect()} == {(0, 0): 0.0, (0, 1): 25.0, (1, 0): 25.0, (1, 1): 0.0}
    assert distance.warp([0, 1, 2], [0, 2]) == 1.0
    pairs = spark.createDataFrame([(1, [0.0, 1.0, 2.0], [0.0, 2.0]), (2, [], [1.0]), (3, None, [1.0])], "k int, a array<double>, b array<double>")
    assert {r.k: r.dtw for r in distance.dtw(pairs, "a", "b", ["k"]).collect()} == {1: 1.0, 2: None, 3: None}
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [5.0])], "id int, v array<double>")
    assert [r.v for r in distance.padded(ragged, "v").orderBy("id").collect()] == [[1.0, 2.0], [5.0, 0.0]]
    with pytest.raises(ValueError, match="2D"):
        distance.padded(ragged, "id")


def test_dtw_matches_the_table():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.normal(size=rng.integers(1, 9)), rng.normal(size=rng.integers(1, 9))
        t = np.full((len(a) + 1, len(b) + 1), np.inf)
        t[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = abs(a[i] - b[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
        assert distance.warp(a, b) == pytest.approx(t[-1, -1])


def test_keyed_autocorrelation_needs_one_shuffle(spark):
    """No row is repeated for each lag, and none is broadcast; a null key has no rows, a missing value no product."""
    values = {1: [1.0, 3.0, 2.0, 5.0, 4.0], 2: [2.0, 1.0], None: [1.0, 2.0], 3: [1.0, None, 4.0, 2.0]}
    s = spark.createDataFrame([(k, t, x) for k, v in values.items() for t, x in enumerate(v)], "k long, t long, x double")
    found = spectral.autocorrelation(s, 4, keys=["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    want = {}
    for k in (1, 2, 3):
        v = np.array(values[k], dtype=float)
        c = v - np.nanmean(v)
        want |= {(k, lag): np.nansum(c[lag:] * c[: len(c) - lag]) / (len(v) * np.nanvar(v)) for lag in range(min(4, len(v)))}
    assert {(r.k, r.lag): r.acf for r in found.collect()} == pytest.approx(want)


def test_autocorrelation(spark):
    s = series(spark, np.sin(2 * np.pi * np.arange(200) / 20))
    got = {r.lag: r.acf for r in spectral.autocorrelation(s, 30).collect()}
    assert got[0] == pytest.approx(1.0) and got[10] == pytest.approx(-0.95) and sorted(got) == list(range(30))
    assert spectral.first_below(spectral.autocorrelation(s, 30)).first().tau == 4
    assert spectral.autocorrelation(series(spark, [1.0] * 5), 3).where("acf IS NOT NULL").count() == 0


def test_generators(spark):
    z = generate.lorenz(spark, [{"sigma": 10.0, "rho": 28.0, "beta": 8 / 3, "X0": (1, 1, 1), "dt": 0.01, "t_max": 1.0}]).orderBy("t").collect()
    assert len(z) == 100 and (z[99].x, z[99].y, z[99].z) == pytest.approx((-4.31673288, -6.00464139, 18.34460882), abs=1e-7)
    m = [r.x for r in generate.mackey_glass(spark, [{"tau": 17.0, "n": 10, "beta": 0.2, "gamma": 0.1, "x0": 1.2, "dt": 1.0, "t_max": 200.0}]).collect()]
    assert min(m) == pytest.approx(0.4171, abs=1e-3) and max(m) == pytest.approx(1.3141, abs=1e-3)
    with pytest.raises(ValueError):
        generate.mackey_glass(spark, [{"tau": 0.5, "dt": 1.0}])
    p = generate.double_pendulum(spark, [{"m1": 1, "m2": 1, "L1": 2, "L2": 3, "g": 9.81, "X0": (1, 0.5, 0, 0), "dt": 0.01, "t_max": 0.5}])
    for r in p.select(*generate.to_xy(2.0, 3.0)).collect():
        assert math.hypot(r.x1, r.y1) == pytest.approx(2) and math.hypot(r.x2 - r.x1, r.y2 - r.y1) == pytest.approx(3)
