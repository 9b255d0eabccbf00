import pytest

from farsight.llm.common import prepare

# Rows that every operator has to take: null ids and texts, empty, blank and odd texts, repeats.
ODD_TEXTS = [None, "", " ", "\n\n\t", "a", "a b", "a b c", "\x00", "é" * 3, "日本 語", "🙂 " * 40, "x" * 30_000, "the same line of words here\n" * 60]


@pytest.fixture()
def llm(spark):
    return prepare(spark)


@pytest.fixture()
def odd(llm):
    """Documents with every odd text twice, repeated and null ids, and columns whose names clash."""
    rows = [(k % 17 if k % 5 else None, text, "n", k) for k, text in enumerate(ODD_TEXTS * 2)]
    return llm.createDataFrame(rows, "doc_id long, text string, spans string, n_words int")


@pytest.fixture()
def none(llm):
    return llm.createDataFrame([], "doc_id long, text string, spans string, n_words int")
