import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties and columns with clashing names."""
    long = "The report says that you may call them. " * 20_000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "src0", 5),
        (2, None, None, None, None),
        (3, "", "de", "src1", 0),
        (4, " \n\t ", None, "src1", 4),
        (5, long, "en", "src0", len(long)),
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "src0", 5),
        (None, "no id here but words all the same and some more of them to count", "en", None, 1),
        (6, "日本語 😀 token = 'abcdefgh1234' 10.0.0.1 x@y.example.org", "ja", "", 9),
        (7, "one two", "en", "src2", 7),
        (8, "one two", "en", "src2", 7),
    ]
    more = "_key string, _text string, size long, target string, component long, rules string, score string, terms string, text_key string"
    wide = [(*r, "k", "t", 1, "x", 2, "r", "s", "t", "q") for r in rows]
    return spark.createDataFrame(wide, f"{DOCS}, {more}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
