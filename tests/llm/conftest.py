import pytest

CLASH = "words lines size source_size doc fp h1 key place n component_id kept drops query text_hash".split()


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, source) rows, with columns whose names clash with inner ones."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
        full = [(i, t, "en", s, None if t is None else len(t), *CLASH) for i, t, s in rows]
        return spark.createDataFrame(full, schema)

    return make


LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))

#: NULLs, empty and blank texts, one very long, ties, repeated rows, copies and near copies.
ODD = [
    (None, None, None), (1, None, "a"), (2, "", "a"), (3, " \t\n ", "b"), (4, LONG, "a"), (5, LONG, "b"),
    (6, "one two", "c"), (6, "one two", "c"), (7, "İstanbul ΟΔΟΣ ﬁ naïve <|endoftext|> \U0001f600 x y", None),
    (8, "The quick brown fox jumps over the lazy dog today", "a"), (9, "the QUICK brown fox, jumps over the lazy dog today!", "b"),
    (10, "alpha beta gamma delta epsilon\nalpha beta gamma delta epsilon\nshort\n\nshort", "c"),
    (11, "a b c d e " * 40, "c"), (12, "x" * 5000, None), (13, "#$% &&& " * 30, "a"), (14, "one two three", "b"),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
