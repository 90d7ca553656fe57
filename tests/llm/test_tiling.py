import random

import numpy as np
from pyspark.sql import functions as F

from quotelock.llm.queries import op7
from quotelock.llm.tiling import leaks, tile, without_leaks


def plain_tiles(item, doc, least):
    item_marked, doc_marked, found = [False] * len(item), [False] * len(doc), []
    while True:
        matches = []
        for i in range(len(item)):
            for j in range(len(doc)):
                size = 0
                while (
                    i + size < len(item) and j + size < len(doc) and item[i + size] == doc[j + size]
                    and not item_marked[i + size] and not doc_marked[j + size]
                ):
                    size += 1
                if size >= least:
                    matches.append((-size, i, j))
        if not matches:
            return found
        size, i, j = min(matches)
        for step in range(-size):
            item_marked[i + step] = doc_marked[j + step] = True
        found.append((i, j, -size))


def test_tiles_equal_brute_force():
    random.seed(5)
    for _ in range(800):
        item = [random.randrange(random.choice([2, 4, 9])) for _ in range(random.randrange(25))]
        doc = [random.randrange(4) for _ in range(random.randrange(30))]
        if random.random() < 0.6:
            doc = doc[:5] + item[3:] + doc[5:] + item[:3]
        assert tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3) == plain_tiles(item, doc, 3)


def test_reordered_passages_are_found_and_others_left(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    filler = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame(
        [
            (1, f"{filler} {' '.join(words[6:])}, {filler} {' '.join(words[:6]).upper()}. {filler}"),
            (2, f"{filler} {' '.join(words[:4])} {filler}"),
            (3, filler),
            (4, None),
            (None, item),
            (5, item),
            (5, item),
        ],
        "doc_id bigint, text string",
    ).withColumn("row", F.lit("clash")).withColumn("seeds", F.lit("clash")).withColumn("digest", F.lit(1))
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id bigint, text string")
    found = leaks(docs, benchmark, ["doc_id"]).collect()
    assert sorted((str(row["doc_id"]), row["item_id"]) for row in found) == sorted(
        [("1", 7), ("None", 7), ("5", 7), ("5", 7)] * 2
    )
    assert {row["n_tiles"] for row in found if row["doc_id"] == 1} == {2}
    kept = without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(row["doc_id"] for row in kept.collect()) == [2, 3, 4]


def test_odd_rows(odd_docs, no_docs, spark):
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id bigint, text string")
    assert leaks(odd_docs, benchmark, ["doc_id"]).count() == 4
    assert without_leaks(odd_docs, benchmark).count() == 6
    assert leaks(no_docs, benchmark, ["doc_id"]).count() == 0
    assert leaks(odd_docs, benchmark.where("item_id = 2"), ["doc_id"]).count() == 0
    assert without_leaks(odd_docs, benchmark.where("item_id = 2")).count() == 10


def test_query_finds_every_whole_item(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    found = {(row["doc_id"], row["item_id"]) for row in op7.build(spark, folder).collect()}
    assert found >= {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in (d["text"] or "")}
    flagged = {doc for doc, _ in found}
    assert flagged == {d["doc_id"] for d in docs if any(i["text"] in (d["text"] or "") for i in items)}
