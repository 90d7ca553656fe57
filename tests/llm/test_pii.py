import hashlib
import random
import re

from quotelock.llm.pii import detect, emails, find_spans, ips, luhn, redact, redact_texts
from quotelock.llm.queries import op5

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda match: re.sub("[^0-9]", "", match[0])
    found = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def base(text):
    return [f"{kind}:{start}:{end}" for start, end, kind, _ in find_spans(text) if kind in ("email", "ip", "card", "phone")]


def test_base_spans_equal_the_plain_patterns():
    random.seed(5)
    for _ in range(20_000):
        text = "".join(random.choices("a1.@@-+ .9(%é\n", k=random.randrange(40)))
        assert base(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    text = "a" * 300_000 + "@" * 1000 + "1" * 200_000 + "." * 10
    assert list(emails(text)) == [] and list(ips(text)) == []


def test_checks_and_context():
    kinds = lambda text: [span[2] for span in find_spans(text)]
    assert kinds("GB82 WEST 1234 5698 7654 32") == ["iban"]
    assert kinds("GB83 WEST 1234 5698 7654 32") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("123-45-6789 (SSN)") == ["ssn"] and kinds("part 123-45-6789" + " x" * 20 + " ssn") == []
    assert [span[:3] for span in find_spans("part 123-45-6789, ssn 321-54-9876")] == [(22, 33, "ssn")]
    assert kinds("4111 1111 1111 1111") == ["card"] and kinds("4111 1111 1111 1112") == []
    assert redact("é a@b.co.", find_spans("é a@b.co.")) == "é <EMAIL>."


def test_odd_rows(odd_docs, no_docs):
    found = detect(odd_docs)
    assert found.count() == 10 and found.columns.count("spans") == 1
    clean = redact_texts(odd_docs)
    assert clean.columns == odd_docs.columns
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, odd_docs.collect()))
    assert detect(no_docs).count() == 0 and redact_texts(no_docs).count() == 0


def test_query_equals_the_plain_patterns(spark, folder):
    source = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in op5.build(spark, folder).collect():
        spans = plain_spans(source[row["doc_id"]] or "")
        assert row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(row["spans"].split(",")) | {""}
        assert row["n_email"] == sum(span.startswith("email:") for span in spans)
