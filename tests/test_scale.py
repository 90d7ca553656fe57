"""Block-wise operators equal the plain ones, whatever the block size and the skew."""

import hashlib
import json
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotelock.operators import audits, chains, cite, review, trust
from quotelock.plans.blocks import carry_forward, running_sum, with_previous


def skewed(spark, count=600):
    """Half of the rows belong to one group."""
    source = random.Random(7)
    data = []
    for group in range(4):
        size = count // 2 if group == 0 else count // 6
        for sequence in range(1, size + 1):
            value = source.randint(0, 50) if source.random() < 0.4 else None
            data.append((group, sequence, value))
    return spark.createDataFrame(data, "g int, sequence bigint, value bigint").repartition(4)


def test_running_sum(spark):
    rows = skewed(spark)
    window = Window.partitionBy("g").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.withColumn("total", F.coalesce(F.sum("value").over(window), F.lit(0)))
    for block in (1, 7, 1 << 16):
        blocked = running_sum(rows, ["g"], "sequence", F.col("value"), "total", block_rows=block)
        assert sorted(map(repr, blocked.collect())) == sorted(map(repr, plain.collect()))


def test_carry_forward(spark):
    rows = skewed(spark)
    for strict in (False, True):
        window = Window.partitionBy("g").orderBy("sequence").rowsBetween(
            Window.unboundedPreceding, -1 if strict else 0
        )
        plain = rows.withColumn("last", F.last("value", ignorenulls=True).over(window))
        for block in (1, 11, 10_000):
            blocked = carry_forward(
                rows, ["g"], ["sequence"], F.floor(F.col("sequence") / block), F.col("value"), "last", strict
            )
            assert sorted(map(repr, blocked.collect())) == sorted(map(repr, plain.collect()))


def test_with_previous(spark):
    rows = skewed(spark)
    window = Window.partitionBy("g").orderBy("sequence")
    plain = rows.withColumn("before", F.lag("value").over(window))
    joined = with_previous(rows, ["g"], "sequence", {"value": F.col("value")}).select(
        "g", "sequence", "value", F.col("previous.value").alias("before")
    )
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.collect()))


def digest(payload):
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def test_chain_equals_a_plain_fold_and_continues_from_heads(spark):
    rows = skewed(spark)
    payload = {"value": F.col("value"), "sequence": F.col("sequence"), "who": F.col("g").cast("string")}
    built = chains.chain_build(rows, ["g"], payload)
    expected, previous = {}, {}
    for row in sorted(rows.collect(), key=lambda r: (r.g, r.sequence)):
        link = previous.get(row.g)
        previous[row.g] = digest(
            {"value": row.value, "sequence": row.sequence, "who": str(row.g), "previousEntrySha256": link}
        )
        expected[row.g, row.sequence] = (link, previous[row.g])
    found = {(r.g, r.sequence): (r.previous_entry_sha256, r.entry_sha256) for r in built.collect()}
    assert found == expected
    heads = spark.createDataFrame(
        [(g, expected[g, 50][1]) for g in range(4)], "g int, head_sha256 string"
    )
    later = chains.chain_build(rows.where("sequence > 50"), ["g"], payload, heads=heads)
    assert {(r.g, r.sequence): (r.previous_entry_sha256, r.entry_sha256) for r in later.collect()} == {
        key: value for key, value in expected.items() if key[1] > 50
    }
    verified = chains.chain_verify(built, ["g"], payload).collect()
    assert all(row.failure_code is None for row in verified)
    assert {row.g: row.head_sha256 for row in verified} == previous


def test_chain_verify_has_no_window(spark):
    rows = skewed(spark)
    payload = {"value": F.col("value"), "sequence": F.col("sequence")}
    built = rows.withColumns({"previous_entry_sha256": F.lit(None).cast("string"), "entry_sha256": F.lit("x")})
    plan = chains.chain_verify(built, ["g"], payload)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert re.search(r"hashpartitioning\(g#\d+, sequence#\d+", plan)


def test_quotes_of_every_length_are_found(spark):
    source = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "a", "é", "of", "boilerplate"]
    documents = []
    for number in range(60):
        body = " ".join(source.choice(words) for _ in range(40))
        if number % 3 == 0:
            body = "this line is found in a third of all texts\n" + body
        documents.append((number, body))
    quotes = []
    for number in range(120):
        body = source.choice(documents)[1]
        start = source.randrange(len(body) - 1)
        quotes.append((number, body[start : start + source.choice([1, 2, 3, 5, 9, 20, 60])]))
    quotes += [(900, "nowhere at all in any of these"), (901, "zz"), (902, "this line is found in a third of all")]
    expected = {
        (number, key, body.find(quote) + 1, body.find(quote, body.find(quote) + 1) >= 0)
        for number, quote in quotes for key, body in documents if quote in body
    }
    found = cite.quote_locate(
        spark.createDataFrame(quotes, "quote_id int, exact string"),
        spark.createDataFrame(documents, "doc_id int, text string"),
    )
    assert {tuple(row) for row in found.collect()} == expected
    unique = {row.quote_id: row.corpus_unique for row in cite.corpus_unique(found).collect()}
    assert unique[902] is False


def test_locate_joins_by_key(spark):
    quotes = spark.createDataFrame([(1, "one two three four five six seven")], "quote_id int, exact string")
    documents = spark.createDataFrame([(1, "zero one two three four five six seven eight")], "doc_id int, text string")
    plan = cite.quote_locate(quotes, documents)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_first_per_key_limits_before_the_shuffle(spark):
    rows = skewed(spark)
    top = review.first_per_key(rows, "g", F.col("sequence").desc(), 3)
    assert top.count() == 12
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_audits_do_not_use_full_outer_joins(spark):
    index = spark.createDataFrame(
        [(1, 1, "a", "x"), (1, 2, "b", "y")], "g int, sequence bigint, head string, meta string"
    )
    supplied = spark.createDataFrame(
        [(1, 1, "a", "x"), (1, 2, "a", "x"), (1, 3, "c", "z")], "g int, position bigint, head string, meta string"
    )
    verdicts = audits.audit(index, supplied, ["g"], "head", {"meta": "meta"}, "T", "position")
    assert "FullOuter" not in verdicts._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.head, r.position, r.verdict) for r in verdicts.collect()) == [
        ("a", 1, "VERIFIED"), ("a", 2, "T_DUPLICATE"), ("b", 2, "T_MISSING"), ("c", 3, "T_UNEXPECTED")]
    assert audits.audit_outcome(verdicts, ["g"], prefix="T").first().outcome == "T_UNEXPECTED"


def test_policy_in_force_is_the_latest_not_after(spark):
    source = random.Random(5)
    policies, probes = [], []
    for key in range(3):
        times = sorted(source.sample(range(1000), 200 if key == 0 else 20))
        policies += [(key, number + 1, time) for number, time in enumerate(times)]
        probes += [(key, source.randrange(1000), number) for number in range(50)]
    found = trust.active_policy_asof(
        spark.createDataFrame(policies, "k int, sequence bigint, since bigint"),
        spark.createDataFrame(probes, "k int, at bigint, probe int"),
        ["k"], "since", "at", ["sequence"], block_seconds=17,
    ).collect()
    assert len(found) == len(probes)
    for row in found:
        active = [s for k, s, since in policies if k == row.k and since <= row.at]
        assert row.sequence == (max(active) if active else None)
        assert row.scheduled_count == sum(k == row.k for k, _, _ in policies) - len(active)
        assert (row.failure_code is None) == bool(active)
