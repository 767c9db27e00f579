"""Repeated runs are counted over all pages of a host, however many shards it has, and by distinct page."""

import random

import numpy as np

from lagspace.llm import html


def page(i, extra=""):
    return f"<body>{extra}<div>own words a{i} b{i} c{i} d{i} e{i}</div></body>"


def test_counts_do_not_depend_on_shards(spark, monkeypatch):
    notice = "<div>please read our terms of service today</div>"
    rows = [(i, f"http://h.example/{i}", page(i, notice if i % 400 == 0 else "")) for i in range(2000)]
    rows += [(5000, "http://h.example/same", page(5000, "<div>this page stands here three times over</div>"))] * 3
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(0, 2000, 200):
        assert got[i] == f"own words a{i} b{i} c{i} d{i} e{i}"
    assert got[5000] == "this page stands here three times over\n\nown words a5000 b5000 c5000 d5000 e5000"


def test_shard_runs_match_brute_force():
    r = random.Random(8)
    for _ in range(60):
        pages = [[r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 6))]
        keys = sorted(r.randint(0, 3) for _ in pages)
        cut, total, seen = r.randint(0, len(pages)), {}, None
        for part in (slice(0, cut), slice(cut, None)):
            if pages[part]:
                runs, counts, seen = html.shard_runs(pages[part], keys[part], seen, 3)
                for x, c in zip(runs.tolist(), counts.tolist()):
                    total[x] = total.get(x, 0) + c
        grams = [{tuple(p[i : i + 3]) for i in range(len(p) - 2)} for p in pages]
        want = {g: len({k for k, q in zip(keys, grams) if g in q}) for g in set().union(*grams)}
        assert sorted(total.values()) == sorted(want.values())
        some = np.array([x for x, c in total.items() if c >= 2], dtype=np.uint64)
        for p, c in zip(pages, html.covered_by(pages, some, 3)):
            flags = [False] * len(p)
            for i in range(len(p) - 2):
                if want[tuple(p[i : i + 3])] >= 2:
                    flags[i : i + 3] = [True] * 3
            assert c.tolist() == flags
