import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quotelock.llm import ordermin
from quotelock.llm.components import components
from quotelock.llm.ordermin import aligned, near_copies, one_per_class
from quotelock.llm.queries import op10


def plain_words(text):
    return re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", text or "")


def longest_common(a, b):
    """Length of the longest common subsequence, row by row."""
    numbers = {value: k for k, value in enumerate(dict.fromkeys([*a, *b]))}
    b = np.array([numbers[value] for value in b])
    row = np.zeros(len(b) + 1, np.int64)
    for value in a:
        best = np.maximum(row[1:], row[:-1] + (b == numbers[value]))
        row[1:] = np.maximum.accumulate(best)
    return int(row[-1])


def plain_classes(docs):
    """Class of each row of (key, text) by comparing all pairs, with lists of words alone."""
    words = [[word.lower() for word in plain_words(text)] for _, text in docs]
    grams = [[tuple(own[i : i + 5]) for i in range(len(own) - 4)] for own in words]
    counts = [Counter(own) for own in grams]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = grams[i], grams[j]
            same = bool(words[i]) and words[i] == words[j]
            if not same and a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                shared = (counts[i] & counts[j]).total()
                if 5 * shared >= 4 * (len(a) + len(b) - shared):
                    both = longest_common(a, b)
                    same = 5 * both >= 4 * (len(a) + len(b) - both)
            if same:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(docs):
        least[find(i)].append(key)
    return sorted((key, min(least[find(i)])) for i, (key, _) in enumerate(docs))


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        at = random.randrange(len(words))
        words[at : at + 1] = random.choice([[], [f"new{random.randrange(999)}"], [words[at], "extra"]])
    return words


def random_docs():
    random.seed(3)
    docs = []
    for group in range(12):
        words = [f"w{random.randrange(300)}" for _ in range(random.randrange(40, 300))]
        for copy in range(random.randrange(1, 8)):
            docs.append((len(docs), " ".join(edited(words, random.randrange(1 + len(words) // 40)) if copy else words)))
    return docs + docs[:4] + [(900, ""), (901, None), (902, "one two"), (903, "One, two!"), (904, "...")]


def test_aligned_is_the_longest_common_order():
    random.seed(6)
    for _ in range(400):
        a = random.sample(range(60), random.randrange(1, 40))
        b = a[:] if random.random() < 0.5 else random.sample(range(60), random.randrange(1, 40))
        for _ in range(random.randrange(4)):
            b.insert(random.randrange(len(b)), b.pop(random.randrange(len(b))))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        want, got = table[-1, -1], aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.6)
        similar = lambda both: both / (len(a) + len(b) - both) >= 0.6
        assert similar(got) == similar(want)


def test_equals_all_pairs(spark):
    docs = random_docs()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("node", F.lit("clash"))
    got = sorted((row["doc_id"], row["class_id"]) for row in near_copies(frame).collect())
    assert got == plain_classes(docs)


def test_outsiders_meet_by_their_differences(spark):
    """Buckets by one sketch of few shingles hold many texts that are not similar."""
    docs = random_docs()
    common = [f"c{i}" for i in range(30)]
    docs += [(1000 + i, " ".join(common + [f"own{i}x{j}" for j in range(20)])) for i in range(10)]
    docs += [(1100 + i, " ".join(common + [f"own{i % 3}y{j}" for j in range(20)] + [f"end{i}"])) for i in range(9)]
    random.seed(8)
    blocks = [[f"b{i}x{j}" for j in range(25)] for i in range(6)]
    for i in range(14):
        order = random.sample(blocks, 6) if i % 2 else blocks[:3] + random.sample(blocks[3:], 3)
        docs.append((1200 + i, " ".join(edited([word for block in order for word in block], i % 3))))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((row["doc_id"], row["class_id"]) for row in near_copies(frame, bands=8, rows=1).collect())
    assert got == plain_classes(docs)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(77, 78), (78, 78)], "a bigint, b bigint")
    got = {row["node"]: row["component"] for row in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {77: 77, 78: 77}
    assert components(edges.where("a < 0")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = near_copies(odd_docs).collect()
    assert len(rows) == 10
    assert {row["class_id"] for row in rows if row["n_words"] == 19} == {2}
    assert [row["class_id"] for row in rows if row["doc_id"] is None and row["n_words"] == 0] == [None]
    kept = one_per_class(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(row["doc_id"]) for row in kept.collect())
    assert ids == ["1", "2", "3", "5", "6", "7", "None"]
    assert near_copies(no_docs).count() == 0 and one_per_class(no_docs).count() == 0


def test_query_equals_all_pairs(spark, folder):
    docs = [(row["doc_id"], row["text"]) for row in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(row) for row in op10.build(spark, folder).collect()) == plain_classes(docs)


def test_aligned_with_repeated_shingles(monkeypatch):
    random.seed(7)
    similar = lambda both, a, b: both / (len(a) + len(b) - both) >= 0.6
    for matches in (0, 2, 1000):
        monkeypatch.setattr(ordermin, "MATCHES", matches)
        for _ in range(200):
            a = [random.randrange(6) for _ in range(random.randrange(1, 40))]
            b = edited(a, random.randrange(min(5, len(a))))
            b = [x if isinstance(x, int) else 7 for x in b] or [1]
            got = aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.6)
            assert similar(got, a, b) == similar(longest_common(a, b), a, b)


def test_an_edit_near_the_top_of_repeated_lines(spark):
    line = [f"line{i}" for i in range(12)]
    header = [f"head{i}" for i in range(20)]
    paragraphs = [header + [f"p{i}x{j}" for j in range(30)] for i in range(10)]
    body = [word for part in paragraphs for word in part]
    docs = [line * 20, [*line[:5], "other", *line[6:], *line * 19], body, header + body]
    rows = [(i, " ".join(words)) for i, words in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((row["doc_id"], row["class_id"]) for row in near_copies(frame).collect())
    assert got == [(0, 0), (1, 0), (2, 2), (3, 2)]
