import pytest

LONG = "word " * 9000


@pytest.fixture
def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties and repeated rows."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "a null id has a text too"), (None, None), (5, LONG), (6, LONG), (6, LONG), (7, "é 漢字 \U0001f600 ﬁ\r\nx"), (8, "x" * 70000), (9, "tie"), (9, "tie")]
    return rows


@pytest.fixture
def edge_docs(spark, edge_rows):
    """The edge rows with further columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, [2], "y") for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, id int, ids array<int>, signals string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
