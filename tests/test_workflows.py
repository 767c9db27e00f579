import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import causal_pair, logistic_values, points, series

from lagspace.operators.simplex import simplex
from lagspace.plans import workflows
from lagspace.streaming.scoring import score


def test_forecast_of_a_sine(spark):
    r = workflows.forecast(series(spark, np.sin(np.linspace(0, 8 * np.pi, 160))), [2, 3], [1]).first()
    assert r.rho > 0.99 and r.E in (2, 3) and r.tau == 1


def test_nonlinearity_of_the_logistic_map(spark):
    got = {r.theta: r.rho for r in workflows.nonlinearity(series(spark, logistic_values(300)), 2, 1, [0.0, 4.0]).collect()}
    assert got[4.0] - got[0.0] > 0.2


def test_search_helpers(spark):
    s = series(spark, logistic_values(200))
    assert {r.E for r in workflows.dimension_curve(s, [1, 2]).collect()} == {1, 2}
    assert workflows.lag_range(series(spark, np.sin(2 * np.pi * np.arange(200) / 20)), 30) == [1, 2, 3, 4]
    good, floor = workflows.expanding_errors(s, [1], [1], 60, 40).first(), workflows.noise_floor(s, [2], [1]).first()
    assert good["mean"] < 0.1 and floor["mean"] < 1
    assert workflows.loo_diagnostic(s, 2, 1).first().rho > 0.98


def test_causality(spark):
    s = spark.createDataFrame(causal_pair()[:600], "t long, x double, y double")
    rows = workflows.both_directions(s, "x", "y", [80], range(1, 300), range(300, 600), 2, n_samples=3).collect()
    assert {(r.cause, r.effect) for r in rows} == {("x", "y"), ("y", "x")}
    b = workflows.causal_bands(s, "y", "x", [80], range(1, 300), range(300, 600), 2, n_samples=3).first()
    assert b.low <= b.median <= b.high and b.floor < b.median


def test_array_predictor(spark):
    lib = points(spark, range(6), range(6)).withColumn("k", F.lit("a"))
    got = workflows.array_predictor(lambda x, y, q: q[:, 0] + y.mean(), lib, lib.select("k", "t", "x0"), ["k"]).orderBy("t").collect()
    assert [r.pred0 for r in got] == [2.5 + i for i in range(6)]
    with pytest.raises(ValueError, match="keys"):
        workflows.array_predictor(lambda x, y, q: q, lib, lib, [])


def test_streamed_scores_equal_batch_scores(spark, tmp_path):
    rng = np.random.default_rng(3)
    lib = points(spark, rng.normal(size=(30, 2)), rng.normal(size=30))
    qry = points(spark, rng.normal(size=(12, 2)))
    qry.repartition(3).write.parquet(str(tmp_path / "in"))
    states = spark.readStream.schema(qry.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = score(states, lib, lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b{i}")), checkpoint=str(tmp_path / "c"))
    assert q.awaitTermination(120)
    got = {r.t: r.pred0 for r in spark.read.parquet(str(tmp_path / "out/*")).collect()}
    assert got == pytest.approx({r.t: r.pred0 for r in simplex(lib, qry).collect()})
