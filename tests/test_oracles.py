"""Every registered query with SQL gives the same rows as an independent engine on the smallest tables."""

import os

import duckdb
import pytest

from lagspace.plans.registry import ORACLES, QUERIES

#: Names are checked in groups that share a session; all are run.
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = _sorted([tuple(r[c] for c in cols) for r in df.collect()])
    found = con.execute(ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == cols
    want = _sorted([tuple(r[at.index(c)] for c in cols) for r in found.fetchall()])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-6, nan_ok=True)
