"""Random inputs against small models in Python."""

import datetime
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotelock.functions import instants, semver, text

RELAXED = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def instant_model(value):
    match = re.fullmatch(
        r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(?:Z|([+-])(\d\d):(\d\d))", value, re.ASCII
    )
    if not match:
        return None
    year, month, day, hour, minute, second = (int(match[i]) for i in range(1, 7))
    zone_hour, zone_minute = int(match[9] or 0), int(match[10] or 0)
    if zone_hour > 23 or zone_minute > 59 or year == 0:
        return None
    try:
        moment = datetime.datetime(year, month, day, hour, minute, second)
    except ValueError:
        return None
    seconds = (moment - datetime.datetime(1970, 1, 1)) // datetime.timedelta(seconds=1)
    offset = (zone_hour * 3600 + zone_minute * 60) * (-1 if match[8] == "-" else 1)
    return (seconds - offset) * 10**9 + int((match[7] or "").ljust(9, "0"))


def two(low, high):
    return st.integers(low, high).map(lambda n: f"{n:02d}")


STAMPS = st.builds(
    lambda y, mo, d, h, mi, s, f, z: f"{y:04d}-{mo}-{d}T{h}:{mi}:{s}{f}{z}",
    st.integers(1, 9999), two(0, 13), two(0, 32), two(0, 24), two(0, 60), two(0, 60),
    st.one_of(st.just(""), st.integers(0, 10**9 - 1).map(lambda n: f".{n}")),
    st.one_of(st.just("Z"), st.just(""), st.builds(lambda s, h, m: f"{s}{h}:{m}", st.sampled_from("+-"), two(0, 24), two(0, 60))),
)


@RELAXED
@given(st.lists(STAMPS, min_size=60, max_size=60))
def test_instants(spark, stamps):
    frame = spark.createDataFrame([(s,) for s in stamps], "v string")
    found = [r[0] for r in frame.select(instants.instant_ns(F.col("v")).cast("string")).collect()]
    assert found == [None if instant_model(s) is None else str(instant_model(s)) for s in stamps]


def occurrences_model(body, query, limit=20):
    found = [i + 1 for i in range(len(body)) if body.startswith(query, i)] if query else []
    return found[: limit + 1]


@RELAXED
@given(st.lists(st.tuples(st.text("abé ", max_size=60), st.text("abé ", max_size=3)), min_size=60, max_size=60))
def test_occurrences(spark, pairs):
    frame = spark.createDataFrame(pairs, "t string, q string")
    found = [r[0] for r in frame.select(text.exact_occurrences(F.col("t"), F.col("q"))).collect()]
    assert found == [occurrences_model(*pair) for pair in pairs]


IDENTIFIER = st.one_of(st.integers(0, 12).map(str), st.sampled_from(["a", "alpha", "rc", "x1", "-"]))
VERSIONS = st.builds(
    lambda core, pre: ".".join(map(str, core)) + ("-" + ".".join(pre) if pre else ""),
    st.tuples(*[st.integers(0, 11)] * 3), st.lists(IDENTIFIER, max_size=3),
)


def version_model(version):
    core, _, pre = version.partition("-")
    identifiers = [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre.split(".")] if pre else []
    return ([int(n) for n in core.split(".")], not pre, identifiers)


@RELAXED
@given(st.lists(st.tuples(VERSIONS, VERSIONS), min_size=60, max_size=60))
def test_versions(spark, pairs):
    frame = spark.createDataFrame(pairs, "a string, b string")
    compared = frame.select(
        semver.semver_key(F.col("a")).alias("a"), semver.semver_key(F.col("b")).alias("b")
    ).select(F.col("a") < F.col("b"))
    assert [r[0] for r in compared.collect()] == [version_model(a) < version_model(b) for a, b in pairs]


def test_ipv6_equals_the_standard_library(spark):
    import ipaddress
    import random

    from quotelock.functions import urls

    random.seed(7)
    parts = ["::", ":", "0", "1", "ab", "ffff", "12345", "g", "1.2.3.4", "256.1.1.1", "2001:db8"]
    texts = {"".join(random.choices(parts, k=random.randrange(1, 12))) for _ in range(3000)}
    for _ in range(1500):
        groups = [f"{random.randrange(1 << random.choice([1, 8, 16])):x}" for _ in range(8)]
        start, stop = sorted(random.sample(range(9), 2))
        texts |= {":".join(groups), ":".join(groups[:start]) + "::" + ":".join(groups[stop:])}
        texts |= {":".join(groups[:6]) + ":9.8.7.65", ":".join(groups[:start]) + "::" + ":".join(groups[stop:7]) + ":1.2.3.4"}

    def expected(text):
        try:
            return ipaddress.IPv6Address(text).packed.hex()
        except ValueError:
            return None

    frame = spark.createDataFrame([(text,) for text in sorted(texts)], "v string")
    rows = frame.select("v", urls.ipv6_hex(F.col("v")).alias("got")).collect()
    wrong = [(row.v, row.got, expected(row.v)) for row in rows if row.got != expected(row.v)]
    assert not wrong, wrong[:10]
    assert sum(row.got is not None for row in rows) > 1000
