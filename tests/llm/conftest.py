import pytest

# Rows that every operator must take: nulls in any column, empty texts, a
# repeated row, one id with two texts, a null id, columns that clash with
# internal names.
LONG = "lorem ipsum " * 3000 + "x" * 70_000
NASTY = [
    (0, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (1, None, "en", None),
    (2, "", None, "a"),
    (3, "Alpha beta gamma delta epsilon zeta eta theta", "en", "b"),
    (3, "Alpha beta gamma delta epsilon zeta eta theta", "en", "b"),
    (4, "\n\n \n", "en", "b"),
    (5, LONG, "en", "c"),
    (6, LONG + " tail", "en", "c"),
    (7, "one", "en", "c"),
    (7, "another text of the same id", "en", "c"),
    (None, "a text without an id", "en", "c"),
    (8, "a b a b a b a b\nline\nline\r\n  LINE \t\nÉcole école 漢字 🎉 \x00\x1c", "fr", "d"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture()
def nasty(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(NASTY, SCHEMA)
    extra = ["_text", "host", "y", "ids", "h", "pos", "line", "key", "score", "kept", "n", "bucket", "piece", "_h"]
    return df.withColumns({c: F.lit("clash") for c in extra}).repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
