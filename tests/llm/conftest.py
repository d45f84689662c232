import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, bucket long"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; the last
    three columns have names that the operators use inside."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12
    other = " ".join(f"word{i}" for i in range(300))
    texts = [(1, base, "a"), (1, base, "a"), (2, base, "b"), (3, "", "b"), (4, None, None), (5, "one two", None),
             (None, other, "a"), (6, other + " tail", "c"), (7, "x" * 5000, "c"), (8, "  \n\t ", "c"), (9, "end <|endoftext|>  of \n texté\U0001f600", "d"),
             (10, " ".join(f"long{i % 97}" for i in range(20000)), "a"), (11, None, None)]
    return [(i, t, None, s, None if t is None else len(t), 0.5, 1, 2) for i, t, s in texts]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 0, 1), (5, 1, 0), (6, 1, 0), (7, None, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
