import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, with an extra column whose name clashes with the operators' own."""
    long = " ".join(f"word{i % 977} tail{i % 13}." for i in range(20_000))
    base = "the quick brown fox jumps over the lazy dog and runs away from the farm in the night while everyone sleeps"
    rows = [
        (1, base, "en", "a", None, 7.0),
        (2, base, "en", "b", 3, None),
        (2, base, "en", "b", 3, None),
        (3, base + " again", None, None, 4, 1.0),
        (4, None, "en", "a", 0, 1.0),
        (5, "", "en", "a", 0, 1.0),
        (6, "  \n\t ", "en", "a", 4, 1.0),
        (7, "two words", "en", "a", 9, 1.0),
        (8, "two words", "en", "c", 9, 1.0),
        (None, "a text without an id token = 'abcdefgh12345678'", "en", "a", 9, 1.0),
        (9, long, "en", "a", len(long), 1.0),
        (10, "<|endoftext|> café \U0001f600 it's  two   spaces\n\n x 日本", "xx", "a", 5, 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (7, None, None), (8, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}
