import pytest

SMALL = "/root/testdata/sf0.001"

#: Texts that any text operator has to take: null, empty, white space, repeats, other scripts, odd bytes, one very long.
ODD = [None, "", " ", "\n\t", "a", "Word", "word word", "  two  spaces ", "tab\tand\nline", "é ß ñ", "漢字かな交じり文", "🙂🙂 ok", "\x00\x1c\x85 x",
       "İΣς ǅ", "12 345 6.7", "!!! *** $$$", "The same text. " * 30, "The same text. " * 30, "x" * 5000, "ab" * 3000, "long words " * 20000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with clashing further columns, a repeated row and a null id."""
    rows = [(i, t, "en", "src", len(t or ""), 1.0, [1], "b") for i, t in enumerate(ODD)]
    rows += [rows[16], (None, "No id here at all.", None, None, 3, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, ids array<int>, key string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
