"""The whole pipeline against a version that compares everything with everything."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quotelock.llm.hostrules import HOST_LIMIT, beta_prior
from quotelock.llm.pii import find_spans, redact
from quotelock.llm.tiling import tile, tokens
from tests.llm.test_hostrules import plain_counts
from tests.llm.test_ordermin import plain_classes


def plain_quality(docs):
    failed = {}
    for doc in docs:
        counts = plain_counts(doc["text"] or "")
        failed[doc["doc_id"]] = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
    hosts = {}
    for doc in docs:
        hosts.setdefault(doc["source"], []).append(failed[doc["doc_id"]])
    rates = [sum(host) / len(host) for host in hosts.values()]
    alpha, beta = beta_prior(float(np.mean(rates)), float(np.var(rates, ddof=1)) if len(rates) > 1 else None)
    bad = {name for name, host in hosts.items() if (sum(host) + alpha) / (len(host) + alpha + beta) > HOST_LIMIT}
    return [doc for doc in docs if not failed[doc["doc_id"]] and doc["source"] not in bad]


def plain_distinct(docs):
    classes = plain_classes([(doc["doc_id"], doc["text"]) for doc in docs])
    kept = {key for key, least in classes if key == least}
    return [doc for doc in docs if doc["doc_id"] in kept]


def plain_without_leaks(docs, items):
    def hashes(texts):
        words = tokens(pa.array(texts, pa.string()))
        values = words.hashes()
        return [values[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]

    items = [item for item in hashes(items) if len(item) >= 4]
    covered = lambda doc: any(2 * sum(t[2] for t in tile(item, doc)) >= len(item) for item in items)
    return [doc for doc, own in zip(docs, hashes([doc["text"] for doc in docs]), strict=True) if not covered(own)]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [row.asDict() for row in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_pipeline_equals_brute_force(spark, folder, docs):
    items = [row["text"] for row in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for doc in plain_without_leaks(plain_distinct(plain_quality(docs)), items):
        text = redact(doc["text"], find_spans(doc["text"]))
        want[doc["doc_id"]] = (text, len(text), doc["source"], library.encode(text, add_special_tokens=False).ids)
    rows = corpus_pipeline.run(spark, folder).collect()
    got = {row["doc_id"]: (row["text"], row["n_chars"], row["source"], row["ids"]) for row in rows}
    assert len(rows) == len(got) and got == want
    assert 0 < len(got) < len(docs)


def test_stages_keep_the_columns(spark, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_copies", "benchmark_leaks", "personal_data", "tokens"
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).schema.names == frame.schema.names


def test_odd_rows(spark, folder, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for frame in (odd_docs, no_docs):
            result = stage(spark, frame.withColumn("n_chars", F.char_length("text").cast("bigint")), folder)
            assert result.count() <= frame.count(), name


def test_odd_rows_keep_what_is_stated(spark, folder, odd_docs):
    frame = odd_docs.withColumn("n_chars", F.char_length("text").cast("bigint"))
    kept = {row["doc_id"] for row in corpus_pipeline.quality_rules(spark, frame, folder).collect()}
    assert kept.isdisjoint({1, 5, 6, 7})
    clean = corpus_pipeline.personal_data(spark, frame, folder)
    assert clean.columns == frame.columns and clean.count() == 10
    encoded = corpus_pipeline.tokens(spark, frame, folder)
    assert "_source_text" in encoded.columns and encoded.count() == 10
    texts = {(row["doc_id"], row["text"]) for row in frame.collect()}
    assert {(row["doc_id"], row["text"]) for row in encoded.collect()} == {(key, text or "") for key, text in texts}
    assert all(len(row["ids"]) == row["n_tokens"] for row in encoded.collect())
