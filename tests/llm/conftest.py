import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside under the same names.
INSIDE = "copies mixed_id id own_id reads passed text_key node head slot curve size mixed part salt fail_bits part_ held n_words".split()
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, shard int, tokens int, epoch int, spans string, m string, row string, digest string, " + ", ".join(f"{n} int" for n in INSIDE)


@pytest.fixture
def docs(spark):
    """Documents from texts, or (doc_id, text, lang, source) rows."""

    def make(rows, clashing=False):
        full = [(i, r, "en", "s") if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        full = [(*r, None if r[1] is None else len(r[1])) for r in full]
        return spark.createDataFrame([(*r, True, 1, 2, 3, 4, "a", "b", "c", "d", *range(len(INSIDE))) for r in full], CLASHING) if clashing else spark.createDataFrame(full, DOCS)

    return make


EDGES = [None, "", " \n\t", "one", "a b c d", "tie tie", "tie tie", "ﬀ İ 👍🏽 \x00 x", "word " * 30000, "x" * 200_000, "a b c"]


@pytest.fixture
def edges(docs):
    """Null, empty, very long, tied and repeated rows, null in other columns, and clashing further columns."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s") for i, t in enumerate(EDGES)]
    return docs([*rows, rows[3], rows[3], (None, "no id here", None, None), (None, None, None, None)], clashing=True)


@pytest.fixture
def nothing(docs):
    return docs([])
