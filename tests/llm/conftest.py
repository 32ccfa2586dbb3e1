import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, _drop string, h int, id string"


def docs_frame(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, (langs or {}).get(i), None, len(t) if t else None, 0.5, "x", 1, "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, ids=None, langs=None: docs_frame(spark, texts, ids, langs)


EDGES = [None, "", " ", "\n\n", "one", "a b", "word " * 40_000, "x" * 60_000, "same text here and there", "same text here and there", "ÀÉß ﬁ \x1c 1.2.3.4 😀", "+1 234 567 890 " * 50]


@pytest.fixture(scope="session")
def edges(make):
    return make([*EDGES, "same text here and there"], [*range(len(EDGES)), 9])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
