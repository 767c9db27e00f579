"""Several targets, a caller's predictor, batches of distances, checks of arguments, stable choices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagspace.functions import metrics
from lagspace.operators import ccm, crossval, distance, neighbors, splits
from lagspace.operators.embedding import lagged_embed
from lagspace.plans import queries


@pytest.fixture(scope="module")
def logistic(spark):
    x = [0.4]
    for _ in range(160):
        x.append(3.8 * x[-1] * (1 - x[-1]))
    rows = [(i, x[i], x[i + 1], x[max(0, i - 1)]) for i in range(160)]
    return spark.createDataFrame(rows, "t long, x double, y0 double, y1 double").cache()


def one_neighbour():
    """A predictor that workers get by value."""
    return lambda X, Y, Q: Y[((Q[:, None] - X[None]) ** 2).sum(-1).argmin(1)]


nearest = one_neighbour()


def scores(df):
    return {(r.E, r.tau, r.fold): r.score for r in df.collect()}


def test_scan_of_several_targets_is_the_mean_of_each(logistic):
    both = scores(crossval.scan(logistic, [1, 2], [1, 2], y=["y0", "y1"]))
    one, two = (scores(crossval.scan(logistic, [1, 2], [1, 2], y=c)) for c in ("y0", "y1"))
    assert both and both == pytest.approx({k: (one[k] + two[k]) / 2 for k in both})
    mapped = scores(crossval.scan(logistic, [2], [1], y=["y0", "y1"], predict=crossval.SMap(2.0)))
    single = [scores(crossval.scan(logistic, [2], [1], y=c, predict=crossval.SMap(2.0))) for c in ("y0", "y1")]
    assert mapped == pytest.approx({k: (single[0][k] + single[1][k]) / 2 for k in mapped})
    pooled = scores(crossval.scan(logistic, [1], [1], y=["y0", "y1"], metric=metrics.rmse))
    each = [scores(crossval.scan(logistic, [1], [1], y=c, metric=metrics.rmse)) for c in ("y0", "y1")]
    assert pooled == pytest.approx({k: np.sqrt((each[0][k] ** 2 + each[1][k] ** 2) / 2) for k in pooled})


def test_scan_with_a_function(logistic):
    got = scores(crossval.scan(logistic, [1, 2], [1], y="y0", predict=nearest))
    x, y = (np.array([r[c] for r in logistic.orderBy("t").collect()]) for c in ("x", "y0"))
    for (e, lag, k), v in got.items():
        states = np.stack([x[1 - j : len(x) - j] for j in range(e)], axis=1) if e == 2 else x[:, None]
        truth = y[-len(states) :]
        f = crossval.default_split(len(x))(len(states))[k]
        p = nearest(states[f.train_start : f.train_end], truth[f.train_start : f.train_end], states[f.val_start : f.val_end])
        assert v == pytest.approx(np.corrcoef(p, truth[f.val_start : f.val_end])[0, 1])


def test_bootstrap_with_a_function(spark, logistic):
    drawn = ccm.draws(spark, [20], 3, range(60))
    pool = spark.range(80, 120).select(F.col("id").alias("t"))
    got = ccm.bootstrap(lagged_embed(logistic, 1, 2), logistic.select("t", "y0"), drawn, pool, predict=nearest)
    assert got.count() == 3 and all(r.rho > 0.5 for r in got.collect())


def test_smap_scan_of_a_constant_has_no_forecast(spark):
    flat = spark.createDataFrame([(i, 1.0) for i in range(60)], "t long, x double")
    assert all(v == 0 for v in scores(crossval.scan(flat, [1, 2], [1], predict=crossval.SMap(0.0, alpha=0.0))).values())


def test_ties_go_by_the_lists(spark):
    rows = [(1, 1, 0, 0.5), (1, 2, 0, 0.5 + 1e-13), (2, 1, 0, 0.5), (2, 2, 0, 0.1)]
    s = spark.createDataFrame(rows, "E int, tau int, fold int, score double")
    assert crossval.select(s).first()[:2] == (1, 1)
    assert crossval.select(s, E=[2, 1], tau=[2, 1]).first()[:2] == (2, 1)
    assert crossval.select(s, E=[1, 2], tau=[2, 1]).first()[:2] == (1, 2)


def test_batched_distances(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(size=(2, 4, 3)), r.normal(size=(2, 5, 3))
    frame = lambda x: spark.createDataFrame([(k, i, x[k, i].tolist()) for k in range(2) for i in range(x.shape[1])], "k int, id long, v array<double>")
    got = distance.pairwise_distance(frame(a), frame(b), keys=["k"]).collect()
    assert len(got) == 40
    for x in got:
        assert x.d2 == pytest.approx(((a[x.k, x.id_a] - b[x.k, x.id_b]) ** 2).sum())
    assert distance.pairwise_distance(frame(a), keys=["k"]).count() == 32


def test_arguments(spark):
    for n in (0, -3):
        for f in (splits.expanding_folds, splits.sliding_folds):
            with pytest.raises(ValueError, match="n must be positive"):
                f(n, 4, 2)
    flat = spark.createDataFrame([(1, 2.0)], "id long, v double")
    deep = spark.createDataFrame([(1, [[2.0]])], "id long, v array<array<double>>")
    vec = spark.createDataFrame([(1, 1, [2.0])], "k int, id long, v array<double>")
    for bad in (flat, deep):
        with pytest.raises(ValueError, match="2D or 3D"):
            distance.pairwise_distance(bad)
    with pytest.raises(ValueError, match="same number of dimensions"):
        distance.pairwise_distance(vec, vec.drop("k"), keys=["k"])


def test_metrics_need_the_same_times(spark):
    p = spark.createDataFrame([(0, 1.0), (1, 2.0)], "t long, pred0 double")
    o = spark.createDataFrame([(0, 1.0), (2, 2.0)], "t long, obs0 double")
    assert metrics.compared(p, o.replace(2, 1, "t")).count() == 2
    with pytest.raises(Exception, match="Shape mismatch"):
        metrics.compared(p, o).collect()


def test_all_pairs_shuffle_each_vector_once(spark):
    """What is shuffled grows with the vectors, not with their pairs; blocks of unequal sizes, two frames, and null numbers."""
    r = np.random.default_rng(7)
    v = r.normal(size=(600, 64))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").cache()
    frame.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    got = distance.pairwise_distance(frame, block=20).toPandas().sort_values(["id_a", "id_b"])
    assert written() - before < 3 * v.nbytes  # each of 30 blocks for each of 30 would be 60 times them
    assert len(got) == 600**2 and np.allclose(got.d2.to_numpy().reshape(600, 600), ((v[:, None] - v[None]) ** 2).sum(-1))
    few = distance.pairwise_distance(frame.where("id % 50 = 0"), frame, block=70).toPandas().sort_values(["id_a", "id_b"])
    assert len(few) == 12 * 600 and np.allclose(few.d2.to_numpy().reshape(12, 600), ((v[::50, None] - v[None]) ** 2).sum(-1))
    assert distance.pairwise_distance(frame.where("id < 0"), frame).count() == 0


def test_all_pairs_take_less_disk_by_distance(spark, tmp_path):
    """The files of pairwise_self hold all pairs in less than three quarters of the 8.2 bytes a pair that rows in the order of vectors take."""
    v = np.random.default_rng(8).normal(size=(1500, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    queries.pairwise_self(spark, str(tmp_path)).write.parquet(f"{tmp_path}/d")
    assert sum(f.stat().st_size for f in (tmp_path / "d").glob("*.parquet")) < 6.15 * 1500**2
    got = spark.read.parquet(f"{tmp_path}/d").toPandas().sort_values(["id_a", "id_b"])
    x = v.astype(float)
    assert np.allclose(got.d2.to_numpy().reshape(1500, 1500), (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, rtol=0, atol=6e-7)


def test_rounding_is_that_of_spark(spark):
    r = np.random.default_rng(9)
    x = [np.arange(4001) / 2e6, np.arange(4001) / 2e6 + 7e3, r.random(4000) * 10.0 ** r.integers(-12, 19, 4000), [0.0, 2.0**52, 1e300, np.inf, np.nan, 4503599627.370497, 1.0000005, 0.0000005, 2.6500005]]
    x = np.concatenate([*x, *(np.nextafter(y, z) for y in x[:2] for z in (0, np.inf))])
    for digits in (0, 3, 6):
        want = spark.createDataFrame([(i, float(y)) for i, y in enumerate(x)], "i long, x double").select("i", F.round("x", digits).alias("y")).toPandas().sort_values("i")
        assert np.array_equal(neighbors.rounded(x, digits), want.y.to_numpy(), equal_nan=True)


def test_blocks_of_one_frame_meet_once(spark):
    """Repeated ids, blocks of unequal sizes and a block with itself: each pair once each way, rounded or not; keys round too."""
    v = np.random.default_rng(10).normal(size=(90, 3)) * 1e5
    ids = np.arange(90) // 2
    frame = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")
    d2 = ((v[:, None] - v[None]) ** 2).sum(-1)
    want = sorted((int(ids[i]), int(ids[j]), round(d2[i, j], 3)) for i in range(90) for j in range(90))
    for digits in (None, 3):
        got = sorted((r.id_a, r.id_b, round(r.d2, 3)) for r in distance.pairwise_distance(frame, block=20, digits=digits).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=0.002)
    keyed = distance.pairwise_distance(frame.withColumn("k", F.lit(1)), keys=["k"], digits=1).collect()
    assert len(keyed) == 8100 and all(r.d2 == round(r.d2, 1) for r in keyed)
    with pytest.raises(ValueError, match="digits"):
        distance.pairwise_distance(frame, digits=-1)
