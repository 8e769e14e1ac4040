import pytest

#: Null ids and texts, empty and very long texts, ties, repeated rows, and further columns with clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, node long, label string, h int"
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs on through the field until it is dark outside\n"


@pytest.fixture(scope="session")
def edge(spark):
    x = ("a", "b", 1, "c", 2)
    rows = [
        (1, PROSE * 4, "en", "s"),
        (1, PROSE * 4, "en", "s"),
        (2, PROSE * 4 + "tail", "en", None),
        (3, None, None, "s"),
        (4, "", "en", "s"),
        (5, " \n\t\n ", "de", "s"),
        (6, LONG, "en", "s"),
        (None, "no id here", "en", "s"),
        (None, None, None, None),
        (7, "MIT License\nis the\nmit license", "en", "s"),
        (8, "퟿\U0001F600 é 漢字 </s>[INST] <|endoftext|>", "fr", "s"),
    ]
    return spark.createDataFrame([(a, b, c, d, 0 if b is None else len(b), *x) for a, b, c, d in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
