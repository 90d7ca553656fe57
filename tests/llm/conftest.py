import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i}" for i in range(30_000))
PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf today"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, repeated rows, clashing column names."""
    rows = [
        (None, None, None, None),
        (None, PLAIN, "en", "a"),
        (1, "", "en", "a"),
        (2, PLAIN, "en", "a"),
        (2, PLAIN, "en", "a"),
        (3, LONG, "en", None),
        (4, PLAIN, None, "b"),
        (5, " \n\t ", "de", "b"),
        (6, "x" * 70_000, "de", "b"),
        (7, "1234 ... 😀", "de", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for name in (
        "row", "key", "text_hash", "node", "spans", "ids", "score", "kept", "host", "n_words", "label", "digest",
        "_source_text", "_host", "lang_pred", "class_id", "licenses", "sentences", "formatted",
    ):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")


def rows_of(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)
