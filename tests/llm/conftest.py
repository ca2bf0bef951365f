import pytest

#: doc_id, text: null and empty texts, ties, repeated rows, null ids, blanks only, a long text, special strings.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two three four five six seven eight nine ten"),
    (4, "one two three four five six seven eight nine ten"),
    (5, "one two three four five six seven eight nine ten"),
    (None, "a row without an id, one two three four five six seven"),
    (6, "word " * 30_000),
    (7, "x" * 50_000),
    (8, "<|endoftext|> inside  a   text\n\n \n with blanks "),
    (9, "Grüße, señor — 日本語 😀 ٣"),
    (10, "123 456 | & % $ ### ***"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows of ODD with columns whose names clash with those that operators add."""
    rows = [(d, t, "en", "s", 1, "x", "y", 0.5, 1, 2) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, words string, score double, start int, mark long")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
