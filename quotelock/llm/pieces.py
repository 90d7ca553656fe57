"""Fill-in-middle examples by piece tables.

A document is a list of descriptors ``(buffer, start, length)`` over two buffers that never
change: the text and the sentinels. Cutting splits the one descriptor of a text in three, an
arrangement puts them in another order with sentinel descriptors between, and the inverse
order puts them back. No text is copied until an output is written, and hashes are taken by
streaming the descriptors.

A unit is a word with the white space before it; white space at the end is one more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelock.llm.buffers import WHITE, buffer, find_words, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT = 50
SPM_PERCENT = 80
SEED = 42

#: Order of the parts (0 prefix, 1 middle, 2 suffix) and the sentinel before each.
ARRANGEMENTS = {
    "psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)),
    "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE)),
}
_SENTINELS = memoryview((PREFIX + SUFFIX + MIDDLE).encode())
_SENTINEL_AT = {PREFIX: 0, SUFFIX: len(PREFIX), MIDDLE: len(PREFIX + SUFFIX)}
_TEXT, _SENTINEL = 0, 1


class Piece(NamedTuple):
    """``length`` bytes from ``start`` of the text buffer (0) or the sentinel buffer (1)."""

    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over one text; the text itself stays where it is."""

    def __init__(self, text: memoryview, pieces: list[Piece] | None = None) -> None:
        self.buffers = (text, _SENTINELS)
        self.pieces = [Piece(_TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *places: int) -> PieceTable:
        """Split descriptors at byte places of what the table reads, counted from its start."""
        pieces, at, wanted = [], 0, sorted(places)
        for piece in self.pieces:
            start, end = at, at + piece.length
            inside = [place for place in wanted if start <= place < end or (place == end and piece is self.pieces[-1])]
            edges = [start, *inside, end]
            pieces += [Piece(piece.buffer, piece.start + a - start, b - a) for a, b in zip(edges, edges[1:])]
            at = end
        return PieceTable(self.buffers[_TEXT], pieces)

    def arrange(self, form: str) -> PieceTable:
        """The three pieces of a text in the order of ``form``, each after its sentinel."""
        pieces = []
        for part, sentinel in ARRANGEMENTS[form]:
            pieces += [Piece(_SENTINEL, _SENTINEL_AT[sentinel], len(sentinel)), self.pieces[part]]
        return PieceTable(self.buffers[_TEXT], pieces)

    @classmethod
    def read(cls, output: memoryview, form: str) -> PieceTable:
        """Descriptors of prefix, middle and suffix over a written output: the inverse order.

        Sentinels are found left to right. A text that holds one is never arranged, and no
        sentinel ends as another starts, so the first one found is the one that was put there.
        """
        if form not in ARRANGEMENTS:
            return cls(output)
        data, at, found = bytes(output), 0, {}
        order = ARRANGEMENTS[form]
        for number, (part, sentinel) in enumerate(order):
            start = at + len(sentinel)
            at = data.index(order[number + 1][1].encode(), start) if number + 1 < len(order) else len(data)
            found[part] = Piece(_TEXT, start, at - start)
        return cls(output, [found[part] for part in range(3)])

    def views(self) -> Iterator[memoryview]:
        for piece in self.pieces:
            yield self.buffers[piece.buffer][piece.start : piece.start + piece.length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.views())


def _drawn(key: object, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def _form(text: bytes, fim: int, spm: int, fim_percent: int, spm_percent: int) -> str:
    if not text or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)) or fim % 100 >= fim_percent:
        return "plain"
    return "spm" if spm % 100 < spm_percent else "psm"


def _arrange_batches(seed: int, fim_percent: int, spm_percent: int):
    names = ["key", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                data, offsets = buffer(part.column(2))
                words = find_words(data, offsets)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                rows = []
                for row, drawn_for in enumerate(part.column(1).to_pylist()):
                    first, last = int(offsets[row]), int(offsets[row + 1])
                    text = memoryview(data)[first:last]
                    ends = words.ends[words.first[row] : words.first[row + 1]] - first
                    tail = last > first and WHITE[data[last - 1]]
                    n = len(ends) + int(tail)
                    h1, h2, h3, h4 = _drawn(drawn_for, seed)
                    form = _form(bytes(text), h3, h4, fim_percent, spm_percent)
                    table, sizes = PieceTable(text), (None, None)
                    if form != "plain":
                        units = sorted((h1 % (n + 1), h2 % (n + 1)))
                        one, two = (0 if k == 0 else int(ends[k - 1]) if k <= len(ends) else last - first for k in units)
                        table = table.cut(one, two).arrange(form)
                        at = chars[[first, first + one, first + two]]
                        sizes = (int(at[1] - at[0]), int(at[2] - at[1]))
                    rows.append((n, form, *sizes, table.text().decode(), table.sha256()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string(), pa.string())
                columns = [pa.array(list(values), kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                columns[4] = columns[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return run


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """Per row: key, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``, ``output_sha256``.

    Draws are the first four groups of eight digits of the sha256 of ``seed:key``. A NULL
    text is empty, a NULL key draws as an empty one. Empty texts, texts that hold a sentinel
    and texts that are not drawn stay ``plain``: output is the text, sizes are NULL. Rows
    with one key draw alike; each row stands for itself, and whole texts are cut, however
    long. Other columns are ignored.
    """
    source = docs.select(
        F.col(key).alias("key"), F.col(key).cast("string").alias("drawn_for"), F.col(text).cast("string").alias("text")
    )
    kind = source.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"
    )
    return source.mapInArrow(_arrange_batches(seed, fim_percent, spm_percent), schema).withColumnRenamed("key", key)


def _restore_batches(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = (batch.column(batch.schema.get_field_index(name)) for name in ("_output", "_form"))
            others = [at for at, name in enumerate(batch.schema.names) if name not in ("_output", "_form")]
            for start, stop in slices(outputs):
                tables = [
                    PieceTable.read(memoryview((output or "").encode()), form)
                    for output, form in zip(
                        outputs.slice(start, stop - start).to_pylist(), forms.slice(start, stop - start).to_pylist(), strict=True
                    )
                ]
                columns = [batch.column(at).slice(start, stop - start) for at in others]
                names = [batch.schema.names[at] for at in others]
                columns.append(pa.array([table.sha256() for table in tables], pa.string()))
                names.append("restored_sha256")
                if texts:
                    columns.append(pa.array([table.text().decode() for table in tables], pa.string()))
                    names.append("restored")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def restore(rows: DataFrame, output: str = "output", form: str = "form", texts: bool = True) -> DataFrame:
    """``rows`` without ``output``, with ``restored_sha256`` and, if ``texts``, ``restored``.

    The text comes from the output and its form alone. A NULL output restores as empty, and
    any form but ``psm`` and ``spm`` as it is.
    """
    kept = [name for name in rows.columns if name not in (output, "restored", "restored_sha256")]
    source = rows.select(*kept, F.col(output).cast("string").alias("_output"), F.col(form).alias("_form"))
    fields = [f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in kept] + ["restored_sha256 string"]
    return source.mapInArrow(_restore_batches(texts), ", ".join(fields + ["restored string"] * texts))
