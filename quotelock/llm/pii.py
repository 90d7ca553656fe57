"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Every proposal starts at its pattern's score. A checksum that must hold (Luhn for cards,
mod-97 for bank accounts) drops the span when it fails. Words of the kind's list close before
the span, or after it in the same clause, raise the score. Spans at or over the
threshold are reported; the kinds of :data:`BASE` have no threshold beyond their own check.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quotelock.llm.buffers import slices

BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.6
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.35

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_CLAUSE_END = re.compile(r"[0-9,;.\n]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Around each ``@``: the longest local part not yet used, then a dotted domain.

    The same spans as scanning with the whole pattern, in linear time: a local part cannot
    reach over an earlier ``@``, and without one at its side an ``@`` cannot match.
    """
    at, free = text.find("@"), 0
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL))
        free = at + 1
        if start < at and (domain := _DOMAIN.match(text, at)):
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", free)


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    values = [int(digit) for digit in reversed(digits)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * value, 10)) for value in values[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """The first four characters go last and letters count from 10; the rest by 97 is 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(char, 36)) for char in moved)) % 97 == 1


def ips(text: str) -> Iterator[Span]:
    for found in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in found[0].split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            yield found.span()


def cards(text: str) -> Iterator[Span]:
    for found in _CARD.finditer(text):
        digits = _digits(found[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def phones(text: str) -> Iterator[Span]:
    for found in _PHONE.finditer(text):
        if 9 <= len(_digits(found[0])) <= 15:
            yield found.span()


@dataclass(frozen=True)
class Recognizer:
    """One pattern with its score, check and context words."""

    kind: str
    pattern: re.Pattern[str]
    score: float
    check: Callable[[str], bool] | None = None
    context: re.Pattern[str] | None = None

    def spans(self, text: str) -> Iterator[tuple[int, int, float]]:
        for found in self.pattern.finditer(text):
            if self.check is not None and not self.check(found[0]):
                continue
            score = self.score
            if self.context is not None:
                before = text[max(0, found.start() - CONTEXT_CHARS) : found.start()]
                after = _CLAUSE_END.split(text[found.end() : found.end() + CONTEXT_CHARS], maxsplit=1)[0]
                score += CONTEXT_GAIN * any(map(self.context.search, (before, after)))
            yield found.start(), found.end(), score


def _account(span: str) -> bool:
    plain = span.replace(" ", "")
    return 15 <= len(plain) <= 34 and mod97(plain)


def _words(*words: str) -> re.Pattern[str]:
    return re.compile(rf"\b(?:{'|'.join(words)})\b", re.IGNORECASE)


#: Public shapes of identifiers and the words that announce them.
ADDED = (
    Recognizer(
        "iban",
        re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
        0.6,
        _account,
        _words("iban", "account", "bank", "konto", "compte", "cuenta"),
    ),
    Recognizer(
        "ssn",
        re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
        0.3,
        None,
        _words("ssn", "social security"),
    ),
)
KINDS = (*BASE, *(recognizer.kind for recognizer in ADDED))
_BASE_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def find_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """All spans as (start, end, kind, score), by start and then kind; ends are exclusive."""
    found = [(start, end, "email", 1.0) for start, end in emails(text)]
    if _DIGIT.search(text):
        for kind in BASE[1:]:
            if kind != "phone" or "+" in text:
                found += [(start, end, kind, 1.0) for start, end in _BASE_FINDERS[kind](text)]
        for recognizer in ADDED:
            found += [
                (start, end, recognizer.kind, score)
                for start, end, score in recognizer.spans(text)
                if score >= threshold
            ]
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """Replace each run of overlapping spans by the kind of its first."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("kind", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
_ARROW_SPANS = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])
)


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for start, stop in slices(batch.column(at)):
            part = batch.slice(start, stop - start)
            yield part, part.column(at).to_pylist()


def detect(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without their text, with ``spans``; offsets are code points.

    NULL and empty texts have no spans. A column named ``spans`` is replaced.
    """
    kept = [name for name in docs.columns if name not in (text, "spans")]
    source = docs.select(*kept, docs[text].cast("string"))
    schema = T.StructType(
        [*(T.StructField(f"c{i}", docs.schema[name].dataType) for i, name in enumerate(kept)), T.StructField("spans", SPAN_TYPE)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, len(kept)):
            spans = [
                [dict(zip(("start", "end", "kind", "score"), span, strict=True)) for span in find_spans(value or "", threshold)]
                for value in texts
            ]
            columns = [part.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(spans, _ARROW_SPANS)], names=[f"c{i}" for i in range(len(kept))] + ["spans"]
            )

    return source.mapInArrow(run, schema).toDF(*kept, "spans")


def redact_texts(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span in their text replaced by its kind; NULL stays NULL."""
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType(
        [T.StructField(name, field.dataType) for name, field in zip(names, docs.schema.fields, strict=True)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, at):
            clean = [None if value is None else redact(value, find_spans(value, threshold)) for value in texts]
            columns = [part.column(i) for i in range(part.num_columns)]
            columns[at] = pa.array(clean, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema).toDF(*docs.columns)
