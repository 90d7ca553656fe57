"""HTML to deterministic plain text (F08) and the text a citation is read from."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelock.functions.ladder import first_failure, holds
from quotelock.functions.text import is_html

TRANSFORMATION = "html-text@1"

# Elements that start and end a line, and subtrees that are no text.
BLOCK_ELEMENTS = frozenset(
    """address article aside blockquote dd div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tbody tfoot thead tr ul""".split()
)
SKIPPED_ELEMENTS = frozenset("head script style noscript template".split())
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
# Elements whose end tag may be left out: inside a hidden subtree that would make
# its extent a guess.
IMPLIED_END = frozenset("p li dd dt td th tr thead tbody tfoot option optgroup".split())
# Elements whose content is text although it looks like markup: rejected.
RAW_TEXT = frozenset("iframe noembed noframes plaintext textarea xmp".split())
# A line break right after the start tag is not content.
LEADING_BREAK = frozenset("listing pre".split())
ROW_PARTS = frozenset("tr thead tbody tfoot".split())

_CONTROL = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f]")
_BLANKS = re.compile("[\t\f\v \u00a0]+")
# The characters trimmed at both ends.
_TRIMMED = "\t\n\v\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    map(chr, range(0x2000, 0x200B))
)


class _Unsupported(Exception):
    """The markup cannot be read without guessing."""


class _TextEvents(HTMLParser):
    """Collects text and line boundaries from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.chunks: list[str] = []
        self.open_blocks: list[str] = []
        self.skipping: list[str] = []
        self.body_seen = False
        self.pending = ""
        self.after_pre = False
        self.cells = [False]

    def flush(self) -> None:
        if self.pending:
            self.chunks.append(self.pending)
            self.pending = ""

    def boundary(self, value: str) -> None:
        self.flush()
        if not self.chunks or self.chunks[-1] != value:
            self.chunks.append(value)

    def close_cell(self) -> None:
        if self.cells[-1]:
            self.cells[-1] = False
            self.boundary("\t")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()
        self.after_pre = False
        if tag in RAW_TEXT:
            raise _Unsupported
        if self.skipping:
            if tag in IMPLIED_END and tag in self.skipping:
                raise _Unsupported
            if tag not in VOID_ELEMENTS:
                self.skipping.append(tag)
            return
        hidden = any(
            name == "hidden" or (name == "aria-hidden" and (value or "").lower() == "true")
            for name, value in attrs
        )
        in_head = not self.body_seen and tag == "title"
        if tag not in HEAD_ONLY and tag not in ("html", "head"):
            self.body_seen = True
        if tag in VOID_ELEMENTS:
            if tag in ("br", "hr") and not hidden:
                self.boundary("\n")
            return
        if tag in ("td", "th") or tag in ROW_PARTS:
            self.close_cell()
        if hidden or in_head or tag in SKIPPED_ELEMENTS:
            self.skipping.append(tag)
            return
        if tag in ("td", "th"):
            self.cells[-1] = True
        elif tag == "table":
            self.cells.append(False)
        self.after_pre = tag in LEADING_BREAK
        if tag in BLOCK_ELEMENTS:
            self.boundary("\n")
            self.open_blocks.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        self.after_pre = False
        if self.skipping:
            if tag in VOID_ELEMENTS:
                return
            if self.skipping[-1] != tag:
                raise _Unsupported
            self.skipping.pop()
            return
        if tag == "br":
            self.boundary("\n")
        elif tag in ("td", "th"):
            self.close_cell()
        elif tag == "p" or tag in self.open_blocks:
            if tag == "table" or tag in ROW_PARTS:
                self.close_cell()
            if tag == "table" and len(self.cells) > 1:
                self.cells.pop()
            while tag in self.open_blocks and self.open_blocks.pop() != tag:
                pass
            self.boundary("\n")

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.after_pre:
            data = data.removeprefix("\r").removeprefix("\n")
            self.after_pre = False
        if data.strip():
            self.body_seen = True
        self.pending += data


def _unfinished(parser: _TextEvents) -> bool:
    """The document ends inside a tag, a comment or a text-only element."""
    rest = parser.rawdata
    return bool(
        parser.cdata_elem
        or re.match(r"<([a-zA-Z/!?]|$)", rest)
        or (parser.skipping and parser.skipping[-1] in ("script", "style", "title", "textarea"))
    )


def render_html(html: str) -> tuple[str | None, str | None]:
    """``(text, None)``, or ``(None, code)`` when the markup must be rejected."""
    if _CONTROL.search(html):
        return None, "HTML_PARSE_FAILED"
    parser = _TextEvents()
    try:
        parser.feed(html)
        if _unfinished(parser):
            return None, "HTML_PARSE_FAILED"
        parser.close()
    except (_Unsupported, AssertionError):
        return None, "HTML_PARSE_FAILED"
    parser.flush()
    text = "".join(parser.chunks).replace("\r\n", "\n").replace("\r", "\n")
    text = _BLANKS.sub(" ", text)
    text = re.sub(" *\n *", "\n", text)
    return re.sub("\n{3,}", "\n\n", text).strip(_TRIMMED), None


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [
            (None, "CITATION_VIEW_INVALID") if html is None else render_html(html)
            for html in batch.column("html").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("sha256"),
                pa.array([text for text, _ in pairs], pa.string()),
                pa.array([code for _, code in pairs], pa.string()),
            ],
            names=["source_sha256", "view_text", "view_failure"],
        )


def html_text_views(sources: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Render each distinct HTML content once.

    ``sources`` has ``(snapshot_ref, sha256, content)``. The result has
    ``source_sha256``, ``view_text``, ``view_sha256``, ``view_byte_length`` and
    ``view_failure``. The copies of a content are counted out by reference, so
    neither the grouping nor Python sees a content twice.
    """
    winners = sources.groupBy("sha256").agg(F.min("snapshot_ref").alias("snapshot_ref"))
    distinct = sources.join(winners.select("snapshot_ref"), "snapshot_ref", "left_semi")
    readable = F.when(F.is_valid_utf8("content"), F.col("content").cast("string"))
    decoded = distinct.select("sha256", readable.alias("html"))
    rendered = decoded.mapInArrow(
        _render_batches, "source_sha256 string, view_text string, view_failure string"
    )
    size = F.octet_length("view_text").cast("bigint")
    code = F.col("view_failure")
    if max_bytes is not None:
        code = F.when(code.isNull() & (size > max_bytes), "CITATION_VIEW_TOO_LARGE").otherwise(code)
    return rendered.select(
        "source_sha256",
        F.when(code.isNull(), F.col("view_text")).alias("view_text"),
        F.when(code.isNull(), F.sha2("view_text", 256)).alias("view_sha256"),
        F.when(code.isNull(), size).alias("view_byte_length"),
        code.alias("view_failure"),
    )


def citation_text(citations: DataFrame, snapshots: DataFrame, views: DataFrame) -> DataFrame:
    """Attach the text each citation is read from, or the code that forbids it.

    ``citations`` has ``snapshot_ref``, ``media_type``, ``sha256`` and a nullable
    ``citation_view`` struct; ``snapshots`` has ``snapshot_ref`` and ``text`` (NULL
    when not UTF-8). Raw text is used for plain media types; for HTML the derived
    text must match the digest and size the citation was bound to.
    """
    html = is_html(F.col("media_type"))
    view = F.col("citation_view")
    joined = citations.join(snapshots.select("snapshot_ref", "text"), "snapshot_ref", "left").join(
        views, F.col("sha256") == F.col("source_sha256"), "left"
    )
    code = first_failure(
        [
            (html == view.isNotNull(), "CITATION_VIEW_INVALID"),
            (~html | (view["source_sha256"] == F.col("sha256")), "CITATION_VIEW_INVALID"),
            (html | F.col("text").isNotNull(), "CITATION_VIEW_INVALID"),
            (~html | F.col("view_failure").isNull(), F.col("view_failure")),
            (
                ~html
                | holds(
                    (F.col("view_sha256") == view["sha256"])
                    & (F.col("view_byte_length") == view["byte_length"])
                ),
                "CITATION_VIEW_HASH_MISMATCH",
            ),
        ]
    )
    return joined.withColumn("text_failure", code).withColumn(
        "citation_text",
        F.when(F.col("text_failure").isNull(), F.when(html, F.col("view_text")).otherwise(F.col("text"))),
    )
