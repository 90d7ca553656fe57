"""Closed records of any depth: every fault at the top, at depth two and inside arrays."""

import copy
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelock.sources.records import closed_records, read_closed_records

HEX = {"pattern": "[0-9a-f]{8}"}
SELECTOR = T.StructType([T.StructField("start", T.LongType(), False, {"low": 0}), T.StructField("exact", T.StringType(), True)])
SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False, {"choices": [1]}),
        T.StructField("source", T.StructType([
            T.StructField("sha256", T.StringType(), False, HEX),
            T.StructField("size", T.LongType(), False, {"low": 1, "high": 100}),
            T.StructField("note", T.StringType(), False, {"optional": True, "high": 5}),
        ]), False),
        T.StructField("selectors", T.ArrayType(SELECTOR, False), False, {"low": 1, "high": 3}),
        T.StructField("flags", T.MapType(T.StringType(), T.BooleanType(), False), False),
        T.StructField("ratio", T.DoubleType(), True),
        T.StructField("tags", T.ArrayType(T.StringType(), False), False, {"items": {"choices": ["a", "b"]}}),
    ]
)
GOOD = {
    "version": 1, "source": {"sha256": "0123abcd", "size": 7}, "selectors": [{"start": 0, "exact": None}, {"start": 4, "exact": "x"}],
    "flags": {"clean": True}, "ratio": 0.5, "tags": ["a", "b"],
}


def changed(path, value):
    record = copy.deepcopy(GOOD)
    at = record
    for step in path[:-1]:
        at = at[step]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(record)


CASES = [
    (json.dumps(GOOD), None, None),
    (changed(["ratio"], None), None, None),
    (changed(["ratio"], 3), None, None),
    (changed(["source", "note"], "five5"), None, None),
    (changed(["flags"], {}), None, None),
    (changed(["evil"], 1), "RECORD_UNKNOWN_KEY", "$.evil"),
    (changed(["source", "evil"], 1), "RECORD_UNKNOWN_KEY", "$.source.evil"),
    (changed(["selectors", 1, "evil"], {}), "RECORD_UNKNOWN_KEY", "$.selectors[1].evil"),
    (changed(["ratio"], KeyError), "RECORD_MISSING_KEY", "$.ratio"),
    (changed(["source", "size"], KeyError), "RECORD_MISSING_KEY", "$.source.size"),
    (changed(["selectors", 0, "exact"], KeyError), "RECORD_MISSING_KEY", "$.selectors[0].exact"),
    (changed(["version"], "1"), "RECORD_TYPE_INVALID", "$.version"),
    (changed(["version"], 1.0), "RECORD_TYPE_INVALID", "$.version"),
    (changed(["version"], 2), "RECORD_VALUE_INVALID", "$.version"),
    (changed(["version"], 1 << 40), "RECORD_TYPE_INVALID", "$.version"),
    (changed(["source"], []), "RECORD_TYPE_INVALID", "$.source"),
    (changed(["source"], None), "RECORD_TYPE_INVALID", "$.source"),
    (changed(["source", "sha256"], None), "RECORD_TYPE_INVALID", "$.source.sha256"),
    (changed(["source", "sha256"], "0123abcdX"), "RECORD_VALUE_INVALID", "$.source.sha256"),
    (changed(["source", "sha256"], "0123abcd\n"), "RECORD_VALUE_INVALID", "$.source.sha256"),
    (changed(["source", "size"], 101), "RECORD_VALUE_INVALID", "$.source.size"),
    (changed(["source", "size"], 10**30), "RECORD_TYPE_INVALID", "$.source.size"),
    (changed(["source", "note"], None), "RECORD_TYPE_INVALID", "$.source.note"),
    (changed(["source", "note"], "longer"), "RECORD_VALUE_INVALID", "$.source.note"),
    (changed(["selectors"], []), "RECORD_VALUE_INVALID", "$.selectors"),
    (changed(["selectors"], {"0": 1}), "RECORD_TYPE_INVALID", "$.selectors"),
    (changed(["selectors", 1], None), "RECORD_TYPE_INVALID", "$.selectors[1]"),
    (changed(["selectors", 1, "start"], -1), "RECORD_VALUE_INVALID", "$.selectors[1].start"),
    (changed(["selectors", 0, "exact"], 5), "RECORD_TYPE_INVALID", "$.selectors[0].exact"),
    (changed(["flags", "other"], "yes"), "RECORD_TYPE_INVALID", "$.flags.other"),
    (changed(["tags", 1], "c"), "RECORD_VALUE_INVALID", "$.tags[1]"),
    (json.dumps(GOOD).replace('"size": 7', '"size": 7, "size": 7'), "RECORD_REPEATED_KEY", "$"),
    (json.dumps(GOOD).replace('"start": 4', '"start": 4, "start": 5'), "RECORD_REPEATED_KEY", "$"),
    ('{"version": 1, ' + json.dumps(GOOD)[1:], "RECORD_REPEATED_KEY", "$"),
    (json.dumps(GOOD) + " x", "RECORD_NOT_JSON", "$"),
    (json.dumps(GOOD) + "]", "RECORD_NOT_JSON", "$"),
    (json.dumps(GOOD) + "}", "RECORD_NOT_JSON", "$"),
    (json.dumps(GOOD) + "," + json.dumps(GOOD), "RECORD_NOT_JSON", "$"),
    (json.dumps(GOOD)[:-1], "RECORD_NOT_JSON", "$"),
    ("[" + json.dumps(GOOD) + "]", "RECORD_TYPE_INVALID", "$"),
    ("null", "RECORD_TYPE_INVALID", "$"), ("", "RECORD_NOT_JSON", "$"), (None, "RECORD_NOT_JSON", "$"),
    # Two faults: the first in the order of the schema counts, and keys before values.
    (changed(["source"], {"sha256": "bad", "size": 0, "evil": 1}), "RECORD_UNKNOWN_KEY", "$.source.evil"),
    (changed(["source"], {"sha256": "bad", "size": 0}), "RECORD_VALUE_INVALID", "$.source.sha256"),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(number, text) for number, (text, _, _) in enumerate(CASES)]
    frame = closed_records(spark.createDataFrame(rows, "number int, line string"), "line", SCHEMA)
    return {row["number"]: row for row in frame.collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_every_fault(results, number):
    text, code, path = CASES[number]
    row = results[number]
    assert (row["failure_code"], row["failure_path"]) == (code, path), text
    assert (row["record"] is None) == (code is not None)


def test_record_of_a_good_text(results):
    record = results[0]["record"].asDict(recursive=True)
    assert record["source"] == {"sha256": "0123abcd", "size": 7, "note": None}
    assert record["selectors"] == GOOD["selectors"] and record["flags"] == GOOD["flags"]


def test_lines_of_a_folder_and_bounds(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps(GOOD),), ("nope",), ('{"version":1}',)], "value string")
    lines.write.text(f"{tmp_path}/in")
    got = read_closed_records(spark, f"{tmp_path}/in", SCHEMA)
    assert sorted(str(row["failure_code"]) for row in got.collect()) == ["None", "RECORD_MISSING_KEY", "RECORD_NOT_JSON"]
    few = closed_records(lines, "value", SCHEMA, required=["version"], max_bytes=20)
    assert {row["failure_code"] for row in few.where(F.col("value") != "nope").collect()} == {None, "RECORD_TOO_LARGE"}
