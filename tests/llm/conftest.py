import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the cat sat on a mat and then it ran far away from home to see the wide sea again".split()


@pytest.fixture(scope="session")
def edges(spark):
    """Null, empty, blank, tied, repeated and very long texts, null metadata, and clashing extra columns."""
    long = " ".join(f"w{k % 977} x{k}" for k in range(20_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", None, None, 5), (4, "One two.", "en", "b", 8), (5, "One two.", "en", "b", 8), (6, " ".join(WORDS), "en", "b", 1), (6, " ".join(WORDS), "en", "b", 1),
        (7, " ".join(WORDS).upper(), "fr", "c", 1), (8, long, "de", "c", len(long)), (9, "日本語 héé 😀  x\x00y", "xx", "c", 9), (10, "x" * 100_000, "en", "a", 1), (11, "Der eine und die andere sind hier", "de", None, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ["size", "target", "taken", "key", "fp", "label", "node", "n", "chunk", "part", "o", "last", "score", "blocks", "id", "u", "v", "host", "sketch"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
