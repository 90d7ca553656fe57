import itertools
import zlib

import numpy as np
import pytest

from quotelock.llm import crf
from quotelock.llm.crf import posteriors
from quotelock.llm.langid import Field, identify, learn
from quotelock.llm.queries import op2

BOUNDS = np.array([0, 1, 1, 6, 8, 15])


@pytest.fixture
def field():
    random = np.random.default_rng(1)
    return Field(("a", "b", "c"), np.empty(0), random.normal(size=3), random.normal(size=(3, 3)), np.empty(0))


def path_score(field, emission, path):
    value = field.first[path[0]] + sum(emission[i, k] for i, k in enumerate(path))
    return value + sum(field.steps[a, b] for a, b in itertools.pairwise(path))


def test_posteriors_equal_all_paths(field, monkeypatch):
    monkeypatch.setattr(crf, "CHUNK", 3)
    emission = np.random.default_rng(2).normal(size=(15, 3))
    got = posteriors(emission, BOUNDS, field)
    for start, end in itertools.pairwise(BOUNDS):
        if start == end:
            continue
        want = np.zeros((end - start, 3))
        for path in itertools.product(range(3), repeat=end - start):
            weight = np.exp(path_score(field, emission[start:end], path))
            want[np.arange(end - start), path] += weight
        assert np.allclose(got[start:end], want / want.sum(axis=1, keepdims=True))


def test_gradients_equal_differences(field):
    random = np.random.default_rng(3)
    bounds, labels = np.array([0, 1, 6, 8, 13]), random.integers(0, 3, 13)
    emission = random.normal(size=(13, 3))

    def likelihood(emission, field):
        total = 0.0
        for start, end in itertools.pairwise(bounds):
            part = emission[start:end]
            paths = [path_score(field, part, path) for path in itertools.product(range(3), repeat=end - start)]
            total += path_score(field, part, labels[start:end]) - np.log(np.exp(paths).sum())
        return total

    by_word, by_first, by_step = crf.batch_gradient(emission, labels, bounds, field)
    base, step = likelihood(emission, field), 1e-5
    for at in ((0, 0), (4, 1), (12, 2)):
        moved = emission.copy()
        moved[at] += step
        assert (likelihood(moved, field) - base) / step == pytest.approx(by_word[at], abs=1e-3)
    steps, first = field.steps.copy(), field.first.copy()
    steps[1, 2] += step
    first[1] += step
    other = Field(field.labels, field.weights, field.first, steps, field.lexicon)
    assert (likelihood(emission, other) - base) / step == pytest.approx(by_step[1, 2], abs=1e-3)
    other = Field(field.labels, field.weights, first, field.steps, field.lexicon)
    assert (likelihood(emission, other) - base) / step == pytest.approx(by_first[1], abs=1e-3)


def test_held_out_accuracy(spark, folder):
    lang = {row["doc_id"]: row["lang"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op2.build(spark, folder).collect()
    assert len(rows) == len(lang)
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1
    right = [row["lang_pred"] == lang[row["doc_id"]] for row in rows if row["held_out"] and lang[row["doc_id"]]]
    assert sum(right) >= 0.95 * len(right)


def test_switches_inside_a_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    field = learn(docs, "doc_id")
    text = {row["lang"]: " ".join(row["text"].split()[:40]) for row in docs.where("char_length(text) > 400").collect()}
    both = spark.createDataFrame([(1, f"{text['en']} {text['es']}"), (2, text["es"])], "doc_id bigint, text string")
    got = {row["doc_id"]: row for row in identify(both, field).collect()}
    assert got[1]["n_switches"] >= 1 and 0.3 < got[1]["score"] < 0.8
    assert got[2]["lang_pred"] == "es" and got[2]["score"] > got[1]["score"]


def test_odd_rows(odd_docs, no_docs):
    labelled = odd_docs.where("lang is not null and doc_id is not null")
    field = learn(labelled, "doc_id")
    assert field.labels == ("de", "en")
    rows = {str(row["doc_id"]): row for row in identify(odd_docs, field).collect()}
    for key in ("1", "5", "7"):
        assert (rows[key]["lang_pred"], rows[key]["score"]) == ("und", 0.0)
    assert rows["3"]["lang_pred"] == "en"
    assert identify(no_docs, field).count() == 0
    assert learn(no_docs, "doc_id") is None
    assert {row["lang_pred"] for row in identify(odd_docs, None).collect()} == {"und"}


def test_partitions_change_nothing_and_rare_languages_are_learned(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(9001, "qaqa zizi qaqa zuzu qizi quza " * 4, "xx")], docs.schema)
    both = docs.union(rare)
    fields = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        fields.append(learn(both.repartition(int(parts)), "doc_id", sample=120))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    one, two = fields
    assert one.labels == two.labels == ("de", "en", "es", "fr", "xx")
    for name in ("weights", "first", "steps", "lexicon"):
        assert np.array_equal(getattr(one, name), getattr(two, name))
    asked = spark.createDataFrame([(1, "zizi quza qaqa zuzu")], "doc_id bigint, text string")
    assert identify(asked, one).first()["lang_pred"] == "xx"
