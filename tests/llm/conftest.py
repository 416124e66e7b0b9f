import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    words = "the thion eran of and to in"
    rows = [
        (1, "plain text of some words that go on and on for a while here", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "   \n\t ", "de", "s"),
        (5, "plain text  of some words\tthat go on and on for a while here", "en", "s"), (5, "plain text  of some words\tthat go on and on for a while here", "en", "s"),
        (6, " ".join(f"{words} {i % 977}" for i in range(12000)), "en", "s"), (7, "x" * 300_000, "fr", "s"), (None, "id is missing but the text is not", "fr", "s"),
        (8, "<s>special</s> <|endoftext|> 😀 ▁▁ é\x00ü", "es", "s"), (9, "12345 !!! ???", "es", "s"), (10, "plain text of some words that go on and on for a while here", "en", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for clash in ("n_chars", "node", "key", "row", "score", "kept", "length", "tokens", "pos", "__id", "hashes", "piece"):
        df = df.withColumn(clash, F.lit(7).cast("long"))
    return df


@pytest.fixture(scope="session")
def awkward_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 0), (6, 1, 0), (None, 1, 0), (9, 0, 1), (9, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
