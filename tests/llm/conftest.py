import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (3, ""),
    (4, None),
    (None, "A row without an id has words of its own as well"),
    (5, "É è ß “quoted” words\n\n\nand\tmore  \x0b lines\r\n" + "long " * 3000),
    (6, "one two"),
    (6, "one two"),
    (7, "   \n\t "),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results'."""
    rows = [(i, t, "x", 1, 2.0, "s") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, n_lines int, score double, spans string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
