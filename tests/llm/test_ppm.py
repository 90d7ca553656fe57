import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quotelock.llm import ppm
from quotelock.llm.buffers import buffer, per_text
from quotelock.llm.ppm import SYMBOLS, ByteModel, ByteScorer, grams, score_texts
from quotelock.llm.queries import op6

EDGE = b"\xff"


def lowered(text):
    return bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in (text or "").encode())


def plain_model(training, least, depth=4):
    counts = [Counter() for _ in range(depth + 1)]
    for text in training:
        padded = EDGE * depth + lowered(text) + EDGE
        for i in range(depth, len(padded)):
            for order in range(depth + 1):
                counts[order][padded[i - order : i + 1]] += 1
    children = defaultdict(dict)
    for order in counts:
        for gram, count in order.items():
            if count >= least:
                children[gram[:-1]][gram[-1]] = count
    return children


def plain_log10(children, context, symbol):
    value, excluded = 0.0, set()
    for start in range(len(context) + 1):
        known = children.get(context[start:])
        if known is None:
            excluded = set()
            continue
        rest = {other: count for other, count in known.items() if other not in excluded}
        if rest:
            whole = sum(rest.values()) + len(rest)
            if symbol in rest:
                return value + math.log10(rest[symbol] / whole)
            value += math.log10(len(rest) / whole)
        excluded = set(known)
    return value - math.log10(SYMBOLS - len(excluded))


def plain_score(children, text, depth=4):
    padded = EDGE * depth + lowered(text) + EDGE
    return sum(plain_log10(children, padded[i - depth : i], padded[i]) for i in range(depth, len(padded)))


def random_texts(count):
    return ["".join(random.choices("aAbéc \n", k=random.randrange(50))) for _ in range(count)]


@pytest.mark.parametrize("least", [1, 3])
def test_scores_equal_brute_force(least):
    random.seed(1)
    training, texts = random_texts(40), [*random_texts(60), "", "zq😀"]
    keys, counts = np.unique(grams(*buffer(pa.array(training)))[0], return_counts=True)
    scorer = ByteScorer(ByteModel.build(keys, counts, least))
    keys, bounds = grams(*buffer(pa.array(texts)))
    children = plain_model(training, least)
    for _ in range(2):
        assert per_text(scorer.score(keys), bounds) == pytest.approx([plain_score(children, text) for text in texts])


def test_probabilities_of_a_context_sum_to_one():
    random.seed(1)
    children = plain_model(random_texts(40), 2)
    symbols = [*{byte for byte in range(256) if not 65 <= byte <= 90} - {0xC0, 0xC1, *range(0xF5, 0xFF)}]
    assert len(symbols) == SYMBOLS
    for context in (EDGE * 4, b"ab a", b"zzzz", b"\xff\xffaa"):
        assert sum(10 ** plain_log10(children, context, symbol) for symbol in symbols) == pytest.approx(1)


def plain_rows(docs, training, share):
    counts = Counter(word for text in training for word in [*lowered(text).split(), b"\n"])
    tokens, kinds = sum(counts.values()), len(counts)
    total = sum(len(lowered(text)) + 1 for text in training)
    children = plain_model(training, share * total)
    out = []
    for key, text in docs:
        words = [*lowered(text).split(), b"\n"]
        base = sum(math.log10((counts[word] + 1) / (tokens + kinds + 1)) for word in words)
        known = sum(word in counts for word in words)
        out.append((key, len(words), known, tokens, round(base, 6), round(plain_score(children, text), 6)))
    return sorted(out, key=repr)


def collected(frame):
    rows = [(row[0], *row[-5:-2], round(row[-2], 6), round(row[-1], 6)) for row in frame.collect()]
    return sorted(rows, key=repr)


def test_table_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "COMMON", 0.05)
    random.seed(3)
    docs = [(i, text) for i, text in enumerate(random_texts(80))] + [(None, None), (3, "É a"), (3, "É a")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    training = [text for key, text in docs if key is not None and key % 2]
    got = score_texts(frame, frame.where("doc_id % 2 = 1"), share=0.001)
    assert collected(got) == plain_rows(docs, training, 0.001)


def test_odd_rows(odd_docs, no_docs):
    assert score_texts(odd_docs, odd_docs).count() == 10
    assert score_texts(no_docs, odd_docs).count() == 0
    rows = score_texts(odd_docs, no_docs).collect()
    assert {(row["n_known"], row["train_tokens"]) for row in rows} == {(0, 0)}
    assert all(row["base_score"] == pytest.approx(0) for row in rows)


def test_query_equals_brute_force(spark, folder):
    docs = [(row["doc_id"], row["text"]) for row in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    training = [text for key, text in docs if zlib.crc32(str(key).encode()) % 7 != 2]
    rows = op6.build(spark, folder)
    assert collected(rows) == plain_rows(docs, training, ppm.SHARE)
    for row in rows.select("doc_id", "held_out").collect():
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 7 == 2)


def test_rare_contexts_count_however_large_the_corpus_is(spark, monkeypatch):
    """The rare word is under the share that the cache asks for; its contexts are known all the same."""
    monkeypatch.setattr(ppm, "CACHED", 2.0**-8)
    texts = ["the same line of common words again"] * 400 + ["zyxwvut"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    docs = spark.createDataFrame([(1, "zyxwvut"), (2, "words again"), (3, "yxwq zz")], "doc_id bigint, text string")
    got = score_texts(docs, frame)
    assert collected(got) == plain_rows([tuple(row) for row in docs.collect()], texts, 0)


def test_no_counted_node_is_left_out(spark):
    """Two million bytes of one line: a word seen once has a share under 2^-20."""
    texts = ["a line that is the same everywhere " * 600] * 100 + ["zyxwvut"]
    training = spark.createDataFrame([(0, text) for text in texts], "doc_id bigint, text string")
    docs = spark.createDataFrame([(1, "zyxwvut")], "doc_id bigint, text string")
    assert collected(score_texts(docs, training)) == plain_rows([(1, "zyxwvut")], texts, 0)
