import pytest


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as documents, with an extra column whose name clashes with inner ones."""

    def make(rows, extra=True):
        full = [(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "k") for i, t in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, k1 string")
        df = df.repartition(3)
        return df if extra else df.drop("k1")

    return make


#: Null, empty, blank, tied, repeated and very long texts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (None, "no id here at all"),
    (6, "word " * 60_000), (7, "a" * 100_000), (8, "ünïcode 你好 \U0001f600 text"), (9, "x\x00y"),
]


@pytest.fixture
def odd():
    return list(ODD)
