import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, digest string, row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeated rows and columns that clash with those of the operators."""
    long = " ".join(f"word{k % 997}x{k}" for k in range(30_000))
    texts = [None, "", "   \n\t ", "one", "two words", "a b c d e f g h", "a  b c d e\nf g h", long, long, "same line\nsame line\nother line here", None]
    rows = [(k if k != 10 else None, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 3}", None, "x", "y", "z") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
