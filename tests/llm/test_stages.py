"""The near-copy stage links what its own rule links: five-word shingles, similarity of 0.8 or more."""

import random

import corpus_pipeline


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_near_copies_by_five_words_and_four_fifths(spark, sf_dir):
    base = [f"w{i}" for i in range(204)]
    texts = {1: base, 2: base + [f"x{i}" for i in range(45)], 3: base + [f"y{i}" for i in range(60)], 4: [f"z{i}" for i in range(204)]}
    texts = {k: " ".join(v) for k, v in texts.items()}
    like = lambda a, b: len(shingles(texts[a]) & shingles(texts[b])) / len(shingles(texts[a]) | shingles(texts[b]))
    assert 0.8 <= like(1, 2) < 0.85 and like(1, 3) < 0.8 and like(2, 3) < 0.8
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == [1, 3, 4]


CLASHING = "doc_id long, text string, score double, predicted int, _row string, _cut string, _tail string, own string, n_chars long, source string"


def clashing(rows):
    return [(i, t, 0.5, 7, f"r{i}", "c", "t", "o", len(t or ""), f"s{i % 9}") for i, t in rows]


def test_stages_keep_columns_of_any_name(spark, sf_dir, tmp_path):
    """Nulls, empty texts and repeated rows; columns that are named like the operators' own; a live secret; an empty table."""
    r = random.Random(2)
    word = lambda: "".join(r.choice(["ba", "ko", "mi", "ru", "se", "ta"]) for _ in range(r.randint(1, 4)))
    prose = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(12)) + "."
    rows = [(i, prose() + (" idiotic idiot scum" if i % 5 == 0 else "")) for i in range(300)] + [(900, None), (901, ""), (902, " \n"), (903, "a key token = 'aLiveOne12345678' " + prose())]
    rows += [rows[1], rows[1], (950, rows[2][1])]
    docs = spark.createDataFrame(clashing(rows), CLASHING)
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = docs.where("1 = 0")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {x._row for x in out.collect()} <= {f"r{i}" for i, _ in rows}, name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    clean = {x.doc_id: x for x in corpus_pipeline.redact_secrets(spark, docs, str(tmp_path)).collect()}
    assert "aLiveOne" not in clean[903].text and clean[903].n_chars == len(clean[903].text) and clean[903]._cut == "c"
    assert clean[900].text is None and clean[901].text == ""
    kept = {x.doc_id for x in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert not {i for i in kept if i < 300 and i % 5 == 0} and kept >= {i for i in range(300) if i % 5}
    once = [x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    assert once.count(1) == 1 and 950 not in once and {900, 901, 902} <= set(once)
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} == {i for i, _ in rows} and corpus_pipeline.pack(spark, none, str(tmp_path)).count() == 0
