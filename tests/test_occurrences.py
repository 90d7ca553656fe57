"""All occurrences, however many."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quotelock.functions.text import bounded_matches, exact_occurrences, running_totals, ws_occurrences


def plain(text, query):
    if not text or not query:
        return []
    return [i + 1 for i in range(len(text)) if text.startswith(query, i)]


def test_random_texts(spark):
    random.seed(3)
    letters = ["a", "b", "é", "😀", ".", "\\", "(", "$", "\n"]
    rows = []
    for number in range(300):
        text = "".join(random.choice(letters) for _ in range(random.randrange(60)))
        query = "".join(random.choice(letters) for _ in range(random.randrange(1, 4)))
        rows.append((number, text, text[:2] if number % 5 == 0 else query))
    rows += [(900, "a" * 50, "aa"), (901, None, "a"), (902, "a", None), (903, "", "a"), (904, "a", ""), (905, "[x]\\E.\\Q", "\\E.\\Q")]
    frame = spark.createDataFrame(rows, "id int, text string, query string")
    got = frame.select("id", exact_occurrences(F.col("text"), F.col("query")).alias("all"),
                       exact_occurrences(F.col("text"), F.col("query"), 3).alias("few")).collect()
    want = {number: plain(text, query) for number, text, query in rows}
    assert {row["id"]: row["all"] for row in got} == want
    assert {row["id"]: row["few"] for row in got} == {number: found[:4] for number, found in want.items()}


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 9, 10, 101])
def test_running_totals(spark, size):
    values = [random.randrange(9) for _ in range(size)]
    frame = spark.createDataFrame([(values,)], "values array<int>").select(running_totals(F.col("values")).alias("sums"))
    assert frame.first()["sums"] == [sum(values[: i + 1]) for i in range(size)]


def test_a_text_of_very_many_hits(spark):
    frame = spark.createDataFrame([("ab" * 100_000, "ab"), ("a" * 100_001, "aa")], "text string, query string")
    started = time.time()
    rows = frame.select(exact_occurrences(F.col("text"), F.col("query")).alias("all"),
                        F.size(ws_occurrences(F.col("text"), F.col("query"))).alias("ws")).collect()
    assert time.time() - started < 30
    assert rows[0]["all"] == list(range(1, 200_001, 2)) and rows[1]["all"] == list(range(1, 100_001))
    assert [row["ws"] for row in rows] == [100_000, 100_000]
    kept, more = bounded_matches(exact_occurrences(F.col("text"), F.col("query"), 20))
    assert frame.select(F.size(kept).alias("n"), more.alias("more")).first() == (20, True)
