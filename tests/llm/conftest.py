import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside; they must not clash.
EXTRA = ("size", "start", "copy", "class", "mark", "block", "label", "score", "taken", "host", "tile", "_times")


def odd_documents(spark):
    """Nulls everywhere, empty and long texts, ties and repeated rows, clashing extra columns."""
    long = "word " * 30_000 + "end."
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 1),
        (2, "one TWO three four five six seven eight nine ten eleven twelve.", None, None, None),
        (3, None, "en", "a", None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", None, 4),
        (6, long, "en", "b", len(long)),
        (None, "A row without an id, but with some words to be counted in it here.", "en", "a", None),
        (None, None, None, None, None),
        (7, "twin text", "en", "c", 9),
        (7, "twin text", "en", "c", 9),
        (7, "twin text", "en", "c", 9),
        (-5, "é ü ñ 漢字 😀 <|endoftext|> |> tab\there  double  space\n\nend ", "de", "c", 5),
        (9, "x", "fr", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *(f"'clash' as {c}" for c in EXTRA))


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark).cache()


@pytest.fixture(scope="session")
def none(spark):
    return odd_documents(spark).limit(0).cache()


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
