import pytest

#: Columns whose names clash with those inside the operators.
CLASHES = ("key", "k", "h", "n", "t", "x", "y", "row", "word", "digest", "bands", "class", "score", "__row", "__h")


@pytest.fixture(scope="session")
def documents(spark):
    """make(rows): documents from (doc_id, text) with the other columns, and one whose name clashes with inner ones."""

    def make(rows):
        rows = [(i, t, "en", "src0", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))

    return make


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "é ß 日本 \U0001f600"), (5, LONG), (5, LONG), (None, "a null key"), (7, "!!! ###"), (8, "a\x00b   c")]
