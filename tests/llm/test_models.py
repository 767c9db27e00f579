"""Operators that learn, by held-out accuracy; and the pipeline."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lagspace.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def auc(rows, label):
    s = np.array([r.score for r in rows])
    y = np.array([r[label] for r in rows])
    rank = s.argsort().argsort() + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def synthetic(spark, n=600):
    r = random.Random(1)
    common = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [r.choice(common) for _ in range(r.randint(20, 200))]
        if bad:
            for _ in range(1 + len(w) // 40):
                w[r.randrange(len(w))] = r.choice(["nastyone", "nastytwo"])
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_finds_planted_words(spark):
    docs, labels = synthetic(spark)
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc(rows, "toxic") > 0.97
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93


def counted(words_of):
    """N-grams and their counts by class of two lists of words."""
    found = {}
    for k, ws in enumerate(words_of):
        for w in ws:
            for g in toxicity.grams(w, 3):
                found.setdefault(g, [0, 0])[k] += 1
    runs = sorted(found)
    return runs, np.array([found[r] for r in runs])


def plain_kneser_ney(runs, counts, k, context, char):
    """The probability of a character after a context, by the definition: raw counts of a class, then continuation counts of both."""

    def take(c):
        ones, twos = sum(x == 1 for x in c), sum(x == 2 for x in c)
        return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5

    def lower(h, c):
        kinds = {r[-len(h) - 2 :] for r in runs if len(r) >= len(h) + 2}
        n = {}
        for x in kinds:
            n[x[1:]] = n.get(x[1:], 0) + 1
        d, mine = take(n.values()), {x: v for x, v in n.items() if x[:-1] == h}
        below = lower(h[1:], c) if h else 1 / (len({r[-1] for r in runs}) + 1)
        if not mine:
            return below
        return (max(mine.get(h + c, 0) - d, 0) + d * len(mine) * below) / sum(mine.values())

    n = {r: int(v) for r, v in zip(runs, counts[:, k]) if v}
    d, mine = take(n.values()), {r: v for r, v in n.items() if r[:-1] == context}
    if not mine:
        return lower(context[1:], char)
    return (max(mine.get(context + char, 0) - d, 0) + d * len(mine) * lower(context[1:], char)) / sum(mine.values())


def test_kneser_ney_matches_its_definition_and_sums_to_one():
    r = random.Random(3)
    runs, counts = counted([["".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(40)] for _ in range(2)])
    m, p = toxicity.kneser_ney(toxicity.justified(runs, 3), counts)
    for i, g in enumerate(runs):
        for k in (0, 1):
            assert p[k][i] == pytest.approx(plain_kneser_ney(runs, counts, k, g[:-1], g[-1]))
    for context in {g[:-1] for g in runs}:
        for k in (0, 1):
            assert sum(plain_kneser_ney(runs, counts, k, context, c) for c in "abc ?") == pytest.approx(1)
    for word in ("abc", "aacb", "xa", "c"):
        want = sum(np.log(plain_kneser_ney(runs, counts, 1, g[:-1], g[-1]) / plain_kneser_ney(runs, counts, 0, g[:-1], g[-1])) for g in toxicity.grams(word, 3))
        assert m.of_words([word.encode()])[0] == pytest.approx(want, abs=1e-4)


def test_toxicity_counts_all_labelled_rows(spark):
    """Each of 6,000 rows has a word of its own; all of them are learnt from, equal texts once; parts of n-grams give the same model."""
    rows = [(i, f"row{i:05d}", i % 2) for i in range(6000)] + [(6000 + i, "the same text", 0) for i in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    used = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 != 0}
    found = toxicity.distinct(toxicity.labelled(docs, labels, "toxic", 5, 0)).collect()
    assert sorted((r.text, r.label) for r in found) == sorted({(t, y) for i, t, y in rows if i in used})


def test_kneser_ney_in_parts(monkeypatch):
    r = random.Random(2)
    ws = [["".join(r.choice("abcdef") for _ in range(r.randint(1, 6))) for _ in range(300)] for _ in range(2)]
    runs, counts = counted(ws)
    codes = toxicity.justified(runs, 3)
    m, p = toxicity.kneser_ney(codes, counts)
    monkeypatch.setattr(toxicity, "PART", 7)
    m2, p2 = toxicity.kneser_ney(codes, counts)
    assert np.allclose(p, p2) and (m.keys == m2.keys).all() and np.allclose(m.evidence_of, m2.evidence_of) and (m.contexts == m2.contexts).all() and np.allclose(m.backoffs, m2.backoffs)


def test_toxicity_models_are_made_by_tasks(spark):
    """Pieces of a model by tasks give the model of all n-grams, of all folds and without one; a step of the plan has one Python worker."""
    docs, labels = synthetic(spark, 200)
    rows = toxicity.labelled(docs, labels, "toxic", 5, 0)
    made, _ = toxicity.models(toxicity.distinct(rows, toxicity._counted, "gram string, class int, n long"))
    for fold in (-1, 1):
        by = {}
        for r in toxicity.distinct(rows).collect():
            if r.fold != fold:
                for w in toxicity.words(r.text):
                    for g in toxicity.grams(w.decode()):
                        by.setdefault(g, [0, 0])[r.label] += 1
        want, _ = toxicity.kneser_ney(toxicity.justified(list(by)), np.array(list(by.values())))
        got = made(fold)
        assert len(got.keys) == len(by) > 500
        for name in ("keys", "evidence_of", "contexts", "backoffs"):
            assert np.allclose(getattr(got, name), getattr(want, name)), name
    plan = rows.of(rows.docs, "text string, h long, fold int, label int")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    plan = toxicity.distinct(rows, toxicity._counted, "gram string, class int, n long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("Exchange") >= 1  # one over texts that occur once, two with a shuffle between over the others


def test_toxicity_of_inflected_rare_expressions(spark):
    """Every toxic text has few words of a stem, each inflected in a way that is seen hardly twice."""
    r = random.Random(5)
    syllables = ["ba", "ko", "mi", "ru", "se", "ta", "no", "li", "du", "fe"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    rows, marks = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(30, 600))]
        if i % 6 == 0:
            for _ in range(2):
                w[r.randrange(len(w))] = "zugra" + word()
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(x.predicted for x in got if x.toxic) >= 0.95 * sum(x.toxic for x in got)
    assert sum(x.predicted for x in got if not x.toxic) <= 0.02 * len(got)


def test_toxicity_on_labelled_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.scored(docs, labels).join(labels.where("toxic IS NOT NULL"), "doc_id").where("held_out").collect()
    assert auc(got, "toxic") > 0.95
    assert sum(x.predicted for x in got if x.toxic) > 0.85 * sum(x.toxic for x in got)
    assert sum(x.predicted for x in got if not x.toxic) < 0.01 * len(got)


def test_quality_learns_from_positives(more):
    docs, labels = more
    rows = quality.scored(docs, labels).join(labels.where("quality IS NOT NULL"), "doc_id").where("held_out").collect()
    assert auc(rows, "quality") > 0.93
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.95


def test_class_prior():
    r = np.random.default_rng(0)
    p, u = r.normal(2, 1, 4000), np.r_[r.normal(2, 1, 2800), r.normal(-2, 1, 1200)]
    assert quality.class_prior(p, u) == pytest.approx(0.7, abs=0.07)


def test_models_on_odd_rows(odd, no_rows, marks):
    for op in (toxicity, quality):
        rows = op.scored(odd, marks).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.predicted == int(r.score >= op.THRESHOLD) for r in rows)
        assert op.scored(no_rows, marks).count() == 0
        assert op.scored(odd, marks.where("1 = 0")).count() == odd.count()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, sf_dir).cache()
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and after <= before, name
        seen.add(name)
    assert after == before  # redaction keeps all
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == after
