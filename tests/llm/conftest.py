import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, _s string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with extra columns whose names clash with those the operators use."""

    def make(*rows, parts=3):
        full = [(i, t, "en", "src", None if t is None else len(t), 0.5, "x", None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


LONG = "word " * 30_000 + "x" * 100_000

#: Null ids and texts, empty and blank texts, repeated rows, ties, and a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no id at all"), (None, None), (6, LONG), (7, "Ä ß 中文 \U0001f600 <|endoftext|> e\u0301")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(*ODD)


@pytest.fixture(scope="session")
def empty(docs_of, odd):
    return odd.where("false")
