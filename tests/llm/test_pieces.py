import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quotelock.llm.pieces import Piece, PieceTable, fill_in_middle, restore
from quotelock.llm.queries import op13

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(key, text):
    """The contract, with strings."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = sha(f"42:{'' if key is None else key}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(part) for part in (units[:one], units[one:two], units[two:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_cuts_arrangements_and_their_inverse():
    text = "ab <c é\n<d"
    data = memoryview(text.encode())
    for one in range(len(data) + 1):
        for two in range(one, len(data) + 1):
            table = PieceTable(data).cut(one, two)
            assert table.text() == bytes(data) and len(table.pieces) == 3
            for form in ("psm", "spm"):
                output = table.arrange(form).text()
                assert table.arrange(form).sha256() == hashlib.sha256(output).hexdigest()
                back = PieceTable.read(memoryview(output), form)
                assert back.text() == bytes(data)
                assert [p.length for p in back.pieces] == [one, two - one, len(data) - two]
    assert PieceTable(data).pieces == [Piece(0, 0, len(data))]
    assert PieceTable.read(data, "plain").text() == bytes(data)


def test_random_texts(spark):
    random.seed(5)
    docs = [
        (i, "".join(random.choice(["a", "é", "😀", " ", "\n", " ", "<", "<P", "S>", "\t", "word"]) for _ in range(random.randrange(30))))
        for i in range(400)
    ] + [(9000, "x <M> y"), (9001, None), (9002, ""), (9003, "  \n"), (9004, "lead " * 40_000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("key", F.lit("clash")).withColumn("output", F.lit("clash"))
    made = fill_in_middle(frame)
    rows = {row["doc_id"]: row for row in restore(made.withColumn("written", F.col("output"))).collect()}
    assert {row["form"] for row in rows.values()} == {"plain", "psm", "spm"}
    for key, text in docs:
        row, want = rows[key], plain(key, text)
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["written"]) == want
        assert row["output_sha256"] == sha(want[-1])
        assert (row["restored"], row["restored_sha256"]) == (text or "", sha(text or ""))


def test_odd_rows(odd_docs, no_docs):
    rows = restore(fill_in_middle(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    texts = {row["doc_id"]: row["text"] for row in odd_docs.where("doc_id is not null").collect()}
    assert all(row["restored"] == (texts[row["doc_id"]] or "") for row in rows if row["doc_id"] is not None)
    assert restore(fill_in_middle(no_docs)).count() == 0


@pytest.mark.parametrize("rate", [0, 100])
def test_rates_are_parameters(spark, rate):
    frame = spark.createDataFrame([(i, "one two three") for i in range(20)], "doc_id bigint, text string")
    forms = {row["form"] for row in fill_in_middle(frame, fim_percent=rate, spm_percent=100).collect()}
    assert forms == ({"spm"} if rate else {"plain"})


def test_query_equals_strings(spark, folder):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op13.build(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        *want, output = plain(row["doc_id"], texts[row["doc_id"]])
        assert [row["n"], row["form"], row["prefix_chars"], row["middle_chars"]] == want
        assert row["output_sha256"] == sha(output) and row["restored_sha256"] == sha(texts[row["doc_id"]] or "")
