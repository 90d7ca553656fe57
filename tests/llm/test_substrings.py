import random

import numpy as np
from pyspark.sql import functions as F

from quotelock.llm import substrings
from quotelock.llm.fmindex import FMIndex
from quotelock.llm.queries import op4
from quotelock.llm.substrings import remove_repeats
from quotelock.plans.registry import Query
from tests.oracle import compare, connect


def plain_removal(docs, window):
    least = {}
    for key, text in docs:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            sequence = tuple(words[i : i + window])
            least[sequence] = min(least.get(sequence, key), key)
    out = []
    for key, text in docs:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = b" ".join(word for i, word in enumerate(words) if i not in gone).decode()
        out.append((key, len(words), len(gone), kept))
    return sorted(out)


def test_index_intervals_and_least_values():
    random.seed(2)
    for _ in range(150):
        parts = [random.choices(range(random.choice([2, 6])), k=random.randrange(3, 9)) for _ in range(random.randrange(1, 12))]
        bounds = np.concatenate([[0], np.cumsum([len(part) for part in parts])])
        index = FMIndex(np.array([word for part in parts for word in part]), bounds)
        values = np.array([random.randrange(100) for _ in parts])
        own = [(i, j, tuple(part[j : j + 3])) for i, part in enumerate(parts) for j in range(len(part) - 2)]
        low, high = index.find(np.array([bounds[i] + j for i, j, _ in own]), 3)
        least = index.least(low, high, values)
        for at, (_, _, pattern) in enumerate(own):
            places = [i for i, _, other in own if other == pattern]
            assert high[at] - low[at] == (len(places) if len(places) > 1 else 0)
            if len(places) > 1:
                assert least[at] == min(values[i] for i in places)


def random_docs():
    random.seed(8)
    pool = [" ".join(random.choices("abcdefgh", k=40)) for _ in range(6)]
    docs = []
    for key in range(120):
        parts = [" ".join(random.choices("abcdefghijklmnop", k=random.randrange(20))) for _ in range(3)]
        parts[1:1] = [" ".join(random.choice(pool).split()[random.randrange(20) :])] if random.random() < 0.7 else []
        docs.append((key, "\n ".join(parts)))
    return docs + docs[:5] + [(500, docs[3][1]), (501, docs[3][1])]


def removed(frame, window):
    return sorted((row["doc_id"], row["n_words"], row["n_removed"], row["kept"]) for row in remove_repeats(frame, window=window).collect())


def test_equals_brute_force(spark):
    docs = random_docs()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("key", F.lit("clash"))
    assert removed(frame, 6) == plain_removal(docs, 6)


def test_hot_anchors_and_small_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", 2)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    docs = random_docs()
    assert removed(spark.createDataFrame(docs, "doc_id bigint, text string"), 6) == plain_removal(docs, 6)


def test_odd_rows(odd_docs, no_docs):
    rows = remove_repeats(odd_docs).collect()
    got = sorted((str(row["doc_id"]), row["n_words"], row["n_removed"]) for row in rows)
    assert got == sorted(
        [("None", 0, 0), ("None", 19, 19), ("1", 0, 0), ("2", 19, 0), ("2", 19, 0), ("3", 30_000, 0), ("4", 19, 19),
         ("5", 0, 0), ("6", 1, 0), ("7", 3, 0)]
    )
    assert remove_repeats(no_docs).count() == 0


def test_query_equals_sql(spark, folder):
    passed, note = compare(spark, connect(folder), folder, Query(op4.NAME, op4.build, op4.SQL))
    assert passed, note
