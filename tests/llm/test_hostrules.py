from collections import Counter

import pytest
from pyspark.sql import functions as F

from quotelock.llm.hostrules import COUNTS, beta_prior, host_verdicts, judge, keep_good, text_counts
from quotelock.llm.queries import op9
from quotelock.plans.registry import Query
from tests.oracle import compare, connect


def plain_counts(text):
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [line for line in text.encode().split(b"\n") if line.strip()]
    symbols = sum(char in "#*$%&|<>" for char in text)
    return len(words), len(b"".join(words).decode()), symbols, len(lines) - len(set(lines)), len(covered)


def test_query_equals_sql(spark, folder):
    query = Query(op9.NAME, op9.build, op9.SQL)
    passed, note = compare(spark, connect(folder), folder, query)
    assert passed, note


def test_counts_of_odd_rows(odd_docs, no_docs):
    rows = text_counts(odd_docs).collect()
    texts = {row["doc_id"]: row["text"] for row in odd_docs.collect() if row["doc_id"] is not None}
    assert len(rows) == 10
    for row in rows:
        if row["doc_id"] is not None:
            assert tuple(row[name] for name in COUNTS) == plain_counts(texts[row["doc_id"]] or "")
    assert text_counts(no_docs).count() == 0 and keep_good(no_docs).count() == 0


def test_repeats_inside_one_text_only(spark):
    part = "a b c d e"
    docs = spark.createDataFrame(
        [(1, f"{part} f g h i {part}\n x\n x\nx"), (2, part), (3, "é|é $ é|é $ é|é $")], "doc_id bigint, text string"
    )
    for row in text_counts(docs).collect():
        text = {r["doc_id"]: r["text"] for r in docs.collect()}[row["doc_id"]]
        assert tuple(row[name] for name in COUNTS) == plain_counts(text)


def test_bad_host_takes_its_documents_along(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, "bad", "short") for i in range(40)] + [(100, "bad", good)]
    rows += [(200 + i, f"good{i % 5}", good) for i in range(50)] + [(300, None, good), (301, "few", "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("kept", F.lit("clash"))
    kept = {row["doc_id"] for row in keep_good(docs).collect()}
    assert kept == {200 + i for i in range(50)} | {300}
    assert keep_good(docs).columns == docs.columns
    counts = text_counts(docs)
    verdicts = {row["host"]: row for row in host_verdicts(counts).collect()}
    assert verdicts["bad"]["host_failed"] and verdicts["few"]["failure_rate"] < 1.0
    assert judge(counts, host_verdicts(counts)).count() == len(rows)


def test_prior_moments():
    alpha, beta = beta_prior(0.2, 0.01)
    assert alpha / (alpha + beta) == pytest.approx(0.2) and alpha + beta == pytest.approx(15)
    assert beta_prior(None, None)[0] == 0 and beta_prior(0.5, None) == (5e5, 5e5)
