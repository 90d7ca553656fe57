import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelock.llm import negatives
from quotelock.llm.negatives import SortedLists, hard_negatives
from quotelock.llm.queries import op11

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every=50, positives=5, negatives=3):
    """All scores of all pairs."""
    vectors = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        vectors[key] = (label, [int(np.floor(256 * float(np.float32(x)))) for x in vector])
    out = []
    for anchor, (label, v) in vectors.items():
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), key, other) for key, (other, w) in vectors.items() if key != anchor)
        near = [(key, -score) for score, key, other in scored if other == label][:positives]
        for positive, best in near:
            far = [(key, -score) for score, key, other in scored if other != label and 50 * best <= -100 * score <= 95 * best]
            out += [(anchor, positive, rank, key, best, score) for rank, (key, score) in enumerate(far[:negatives], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(row) for row in frame.collect())


def mined(frame, every=50, **options):
    return rows_of(hard_negatives(frame, lambda key: key % every == 0, **options))


def made(count, width, labels, spread, seed):
    source = random.Random(seed)
    return [(i, [source.randrange(-spread, spread + 1) / 16 for _ in range(width)], source.randrange(labels)) for i in range(count)]


@pytest.mark.parametrize(("width", "spread", "shard_rows", "block_anchors"), [(6, 16, 64, 7), (1, 2, 50, 100), (3, 1, 1000, 2)])
def test_equals_all_pairs(spark, monkeypatch, width, spread, shard_rows, block_anchors):
    """Few values make many ties; small shards and steps make many of both."""
    rows = made(400, width, 4, spread, width)
    frame = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(negatives, "FIRST_DEPTH", 2)
    assert mined(frame, 10, shard_rows=shard_rows, block_anchors=block_anchors) == plain(rows, 10)


def test_reading_stops_early_and_misses_nothing():
    random = np.random.default_rng(4)
    rows = np.floor(random.normal(size=(3000, 4)) * 256)
    anchor = np.floor(random.normal(size=4) * 256)
    lists = SortedLists(rows)
    found, scores = lists.search(anchor, np.ones(3000, bool), negatives._least_of_best(5))
    assert len(found) < 2000
    assert sorted(scores)[-5:] == sorted(rows @ anchor)[-5:]
    met = set(found.tolist())
    least = sorted(scores)[-5]
    assert all(i in met for i in np.flatnonzero(rows @ anchor >= least))


def test_anchor_of_zeros_and_few_rows(spark):
    rows = [(0, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (50, [1.0, 1.0], 3), (51, [0.6, 0.6], 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    alone = [(50, [1.0, 1.0], 3), (51, [0.6, 0.6], 1)]
    assert mined(spark.createDataFrame(alone, SCHEMA)) == []


def test_odd_rows(spark):
    rows = made(120, 3, 3, 8, 9)
    odd = [
        (None, [1.0, 1.0, 1.0], 1), (200, None, 1), (250, [1.0, None, 0.5], 1), (300, [float("nan"), 1.0, 1.0], 2),
        (350, [float("inf"), 1.0, 1.0], 2), (400, [1.0, 1.0, 1.0], None), *rows[:5],
    ]
    frame = spark.createDataFrame(rows + odd, SCHEMA)
    for name in ("key", "number", "vector", "shard", "block", "row", "rank", "anchor", "score", "positives"):
        frame = frame.withColumn(name, F.lit("clash"))
    assert mined(frame, 10) == plain(rows + odd, 10)
    assert mined(frame.where("vec_id = -1")) == []
    no_anchor = frame.where("vec_id % 50 <> 0")
    assert mined(no_anchor) == []


def test_large_components_are_exact(spark):
    rows = [(0, [5e6, 1.0], 1), (1, [5e6, 2.0], 1), (2, [4e6, 0.5], 2), (3, [4e6, 1.5], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_query_equals_all_pairs(spark, folder):
    rows = []
    for row in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        label = row["label"]
        rows.append((row["vec_id"], row["embedding"], (label + 1) % 10 if row["vec_id"] % 7 == 0 else label))
    got = rows_of(op11.build(spark, folder))
    assert got == plain(rows) and got
