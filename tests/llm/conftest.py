import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, id long, size long, kept boolean, `text.x` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""
    long = "lorem ipsum dolor sit amet " * 9000
    texts = [(1, "the cat sat on the mat today", "en", "a"), (1, "the cat sat on the mat today", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "the cat sat on the mat today", "fr", None), (None, None, None, "a"),
             (4, long, "en", "b"), (5, long, "en", "b"), (6, "   \n\t ", None, "c"), (7, "é" * 50 + " ß \U0001f600", "fr", "c"), (8, "  two  spaces <|endoftext|> \x1c x", "de", "a"), (9, "1234 %%%", "de", "")]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, "h", 7, 1, True, "x") for i, t, lang, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
