"""Cross mappings and distances of whole tables give the same rows as direct computations."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from lagspace.plans import queries as q

DAYS = """WITH r AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS x FROM read_parquet('{d}/lineitem.parquet') GROUP BY 1),
o AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y FROM read_parquet('{d}/orders.parquet') GROUP BY 1)
SELECT x / 1e6, y / 1e6 FROM r JOIN o USING (day) ORDER BY day"""


@pytest.fixture(scope="module")
def days(sf_dir):
    return np.array(duckdb.sql(DAYS.format(d=sf_dir)).fetchall()).T


def cross_mapped(x, y, theta=None):
    """{(size, sample): rho} of "x drives y" by halves of the series."""
    n, draw, out = len(x), q.spread(), {}
    e = np.column_stack([y, np.concatenate([[np.nan], y[:-1]])])
    pool, pred = np.arange(1, n // 2), np.arange(n // 2, n)
    sizes = [len(pool) // 8, len(pool) // 4, len(pool) // 2, len(pool)]
    for size in sizes:
        for k in range(q.N_SAMPLES):
            lib = draw(pool, size)
            got = []
            for t in pred:
                d = np.sqrt(((e[lib] - e[t]) ** 2).sum(1))
                if theta is None:
                    near = np.lexsort((np.arange(size), lib, d))[:3]
                    w = np.exp(-d[near] / max(d[near].min(), 1e-6))
                    got.append((w * x[lib[near]]).sum() / w.sum())
                else:
                    w = np.exp(-theta * d / max(d.mean(), 1e-6))
                    a = np.column_stack([np.ones(size), e[lib]])
                    m = a.T @ (w[:, None] * a)
                    m += np.diag([0, 1, 1]) * 1e-10 * np.trace(m)
                    got.append(np.linalg.solve(m, a.T @ (w * x[lib])) @ [1, *e[t]])
            out[int(size), k] = np.corrcoef(got, x[pred])[0, 1]
    return out


def by_size(samples, f):
    return {s: f([v for (z, _), v in samples.items() if z == s]) for s, _ in samples}


def test_ccm_of_the_whole_series(spark, sf_dir, days):
    run = lambda name: __spark_entry__.queries()[name](spark, sf_dir).collect()
    x, y = days
    assert len(x) > 400
    want = cross_mapped(x, y)
    assert {(r.lib_size, r.sample): r.rho for r in run("ccm_bootstrap")} == pytest.approx(want, abs=2e-6)
    assert {r.lib_size: r.rho for r in run("ccm_mean")} == pytest.approx(by_size(want, np.mean), abs=2e-6)
    for r in run("ccm_bands"):
        assert (r.low, r.median, r.high) == pytest.approx(by_size(want, lambda v: np.quantile(v, [0.05, 0.5, 0.95]))[r.lib_size], abs=2e-6)
    assert {r.lib_size: r.rho for r in run("ccm_reverse")} == pytest.approx(by_size(cross_mapped(y, x), np.mean), abs=2e-6)
    assert {r.lib_size: r.rho for r in run("ccm_smap")} == pytest.approx(by_size(cross_mapped(x, y, 2.0), np.mean), abs=2e-5)
    order = (np.arange(len(x)) * q.PRIME + 13) % len(x)
    assert {r.lib_size: r.rho for r in run("ccm_surrogate")} == pytest.approx(by_size(cross_mapped(x[order], y), np.median), abs=2e-6)


def test_pairwise_self_of_the_whole_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 120").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')").fetchall()
    v = {i: np.asarray(e, dtype=np.float64) for i, e in rows}
    got = __spark_entry__.queries()["pairwise_self"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) ** 2 > 3**2
    assert {(r.id_a, r.id_b): r.d2 for r in got} == pytest.approx({(a, b): ((v[a] - v[b]) ** 2).sum() for a in v for b in v}, abs=2e-6)
