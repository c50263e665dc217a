import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} and more{i}" for i in range(20000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n ", None, "a", 5), (4, long, "en", None, len(long)),
            (5, long, "en", "b", len(long)), (6, "same text " * 12, "en", "a", 1), (6, "same text " * 12, "en", "a", 1),
            (None, "a row without an id but with words", "en", "a", 1), (7, "x", "en", "a", 1),
            (8, "中文 é 😀 'tis don't  two  spaces\t\n\n end <|endoftext|> x", "fr", "c", 3)]
    extra = ", score double, n_words long, class_id long, rule int, rejected boolean, n_removed long, start long, licence string"
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, False, 4, 5, "z") for r in rows], DOCS + extra)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
