import pytest

LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and null-id rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "plain words here"), (5, "plain words here"), (None, "no id é ñ"), (7, "x" * 5000), (8, "a  b \n c")]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with columns whose names clash with those that operators add."""
    rows = [(i, t, None if i == 1 else "en", "src0" if (i or 0) % 2 else None, len(t or ""), 1, "s", 0.5, "k") for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece int, secrets string, score double, kept string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
