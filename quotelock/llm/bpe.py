"""Byte-pair encoding by a deterministic automaton over bytes, decoding by its arc labels.

Merges are compiled one after the other. Merge ``a b -> c`` is a gadget: it adds an arc
labelled ``c`` that opens like ``a`` and closes like ``b``, and takes away the path ``a b``.
What each arc shows at its two edges, and up to which merge, is therefore known when all
gadgets are in, and so is whether one arc may follow another. Encodings are exactly the
paths on which every arc may follow the one before.

To read bytes from left to right the automaton is made deterministic: a state holds the
bytes that may still belong to a longer arc and the last arc of every prefix that ends in
them. Exactly one arc can end at each byte, so the state's own last arc is its label and a
word is encoded by table look-ups, however long it is. States are made when first reached.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quotelock.llm.buffers import slices

START = -1
MOST_STATES = 200_000
MOST_WORDS = 250_000

#: Fixed value: the pre-splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters and digits too new for the tables the vocabulary's own library
#: splits by (Unicode 16); it takes them for symbols.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_later = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
_SPLIT = regex.compile(PATTERN)
_HAS_LATER = regex.compile(f"[{_later}]")
_SPLIT_LATER = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_later}]]+| ?[\p{{N}}--[{_later}]]+"
    rf"| ?(?:[^\s\p{{L}}\p{{N}}]|[{_later}])+|\s+(?!\S)|\s+"
)


#: The same pattern for texts within Latin-1, whose letters, digits and spaces are few.
_letter, _digit, _space = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_SPLIT_LATIN = re.compile(
    rf" ?[{_letter}]++| ?[{_digit}]++|'(?:[stmd]|re|ve|ll)| ?[^{_space}{_letter}{_digit}]++"
    rf"|[{_space}]+(?![^{_space}])|[{_space}]+"
)
_BEYOND_LATIN = re.compile("[^\x00-\xff]")


def presplit(text: str) -> list[str]:
    if text.isascii() or not _BEYOND_LATIN.search(text):
        return _SPLIT_LATIN.findall(text)
    if _HAS_LATER.search(text):
        return _SPLIT_LATER.findall(text)
    return _SPLIT.findall(text)


def byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes: themselves where printable, else 256 and up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + n): byte for n, byte in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """Labels by id, merges by rank as (left, right, merged), and special tokens by text."""

    labels: tuple[bytes, ...]
    merges: tuple[tuple[int, int, int], ...]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a byte-level vocabulary file on the driver; its size is that of the file."""
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        names, ids = byte_names(), content["model"]["vocab"]
        special = {token["content"]: token["id"] for token in content["added_tokens"]}
        labels = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for name, number in ids.items():
            labels[number] = bytes(names[char] for char in name) if name not in special else b""
        for name, number in special.items():
            labels[number] = name.encode()
        merges = tuple((ids[a], ids[b], ids[a + b]) for a, b in content["model"]["merges"])
        return cls(tuple(labels), merges, special)


class TokenAutomaton:
    """The compiled automaton of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.labels = vocabulary.labels
        self.special = vocabulary.special
        self.splitter = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.arcs: dict[bytes, int] = {}
        self.open: set[bytes] = {b""}
        special = set(self.special.values())
        merged = {merge[2] for merge in vocabulary.merges}
        for number, label in enumerate(self.labels):
            if len(label) == 1 and number not in special and number not in merged:
                self.arcs[label] = number
        for rank, (left, right, made) in enumerate(vocabulary.merges):
            self._gadget(rank, left, right, made)
        self.follows: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _gadget(self, rank: int, left: int, right: int, made: int) -> None:
        label = self.labels[made]
        self.rank[left, right] = rank
        self.parts[made] = (rank, left, right)
        self.arcs[label] = made
        self.open.update(label[:end] for end in range(1, len(label)))

    def _edge(self, arc: int, side: int) -> list[tuple[int, float]]:
        """What ``arc`` shows at its left (1) or right (2) edge, and before which merge."""
        shown, until = [], float("inf")
        while True:
            shown.append((arc, until))
            if arc not in self.parts:
                return shown
            until, arc = self.parts[arc][0], self.parts[arc][side]

    def may_follow(self, first: int, second: int) -> bool:
        """No gadget takes the path away: none joins what the two show at one time.

        Equal neighbours are joined from the left, so what a merge uses up on the left
        side is gone at its rank, and on the right side it is not.
        """
        known = self.follows.get(first << 32 | second)
        if known is None:
            known = self.follows[first << 32 | second] = not any(
                (rank := self.rank.get((left, right))) is not None and rank < gone and rank <= used
                for left, gone in self._edge(first, 2)
                for right, used in self._edge(second, 1)
            )
        return known

    def _reset(self) -> None:
        self.follows.clear()
        self.known: dict[tuple[bytes, tuple[int, ...]], int] = {}
        self.pending: list[tuple[bytes, tuple[int, ...]]] = []
        self.label: list[int] = []
        self.table: list[dict[int, int]] = []
        self._state(b"", (START,))

    def _state(self, pending: bytes, last: tuple[int, ...]) -> int:
        """Number of the state with these pending bytes and last arcs."""
        key = (pending, last)
        number = self.known.get(key)
        if number is None:
            number = self.known[key] = len(self.pending)
            self.pending.append(key)
            self.label.append(last[-1])
            self.table.append({})
        return number

    def _step(self, state: int, byte: int) -> int:
        pending, last = self.pending[state]
        pending += bytes((byte,))
        for start in range(len(pending)):
            arc = self.arcs.get(pending[start:])
            if arc is not None and (last[start] == START or self.may_follow(last[start], arc)):
                break
        else:
            raise ValueError("the vocabulary does not cover every byte")
        last += (arc,)
        start = 0
        while pending[start:] not in self.open:
            start += 1
        return self._state(pending[start:], last[start:])

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one pre-split word of any length."""
        table, state, path = self.table, 0, []
        for byte in word:
            target = table[state].get(byte)
            if target is None:
                target = table[state][byte] = self._step(state, byte)
            state = target
            path.append(state)
        out, at = [], len(word)
        while at:
            token = self.label[path[at - 1]]
            out.append(token)
            at -= len(self.labels[token])
        return tuple(reversed(out))

    def learn(self, words: set[str]) -> None:
        """Have the encodings of these words at hand; when there are too many, only these."""
        missing = words - self.words.keys()
        if len(self.words) + len(missing) > MOST_WORDS:
            self.words = {word: self.words[word] for word in words - missing}
        if len(self.pending) > MOST_STATES:
            self._reset()
        for word in missing:
            self.words[word] = self.encode_word(word.encode())

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Token ids of whole texts; strings of special tokens are those tokens."""
        pieces = []
        for text in texts:
            at = 0
            for found in self.splitter.finditer(text):
                pieces.append((presplit(text[at : found.start()]), self.special[found[0]]))
                at = found.end()
            pieces.append((presplit(text[at:] if at else text), None))
        self.learn(set().union(*(words for words, _ in pieces)))
        known, out, ids = self.words, [], []
        for words, special in pieces:
            ids += [token for word in words for token in known[word]]
            if special is None:
                out.append(ids)
                ids = []
            else:
                ids.append(special)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other; broken UTF-8 becomes U+FFFD."""
        labels = self.labels
        return b"".join([labels[token] for token in ids]).decode("utf-8", "replace")


_compiled: dict[int, TokenAutomaton] = {}


def _automaton(vocabulary: Vocabulary) -> TokenAutomaton:
    """One automaton per process and vocabulary."""
    key = id(vocabulary)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = TokenAutomaton(vocabulary)
    return _compiled[key]


def _mapped(rows: DataFrame, added: dict[str, T.DataType], kept: list[str], read: str, run) -> DataFrame:
    """``kept`` columns with the ``added`` ones, which ``run`` makes from slices of ``read``."""
    fields = [*(rows.schema[name].dataType for name in kept), *added.values()]
    schema = T.StructType([T.StructField(f"c{i}", field) for i, field in enumerate(fields)])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            column = batch.column(batch.num_columns - 1)
            for start, stop, values in run(column):
                columns = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *values], names=[f"c{i}" for i in range(len(fields))])

    return rows.select(*kept, rows[read]).mapInArrow(batches, schema).toDF(*kept, *added)


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` without their text, with the token ids of their whole texts as ``array<int>``.

    With ``decoded`` the text that the ids stand for is added as well, from the same tasks.
    NULL counts as empty and has no tokens. Columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    added = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})

    def run(column: pa.Array):
        automaton = _automaton(shared.value)
        for start, stop in slices(column):
            found = automaton.encode_all([value or "" for value in column.slice(start, stop - start).to_pylist()])
            values = [pa.array(found, pa.list_(pa.int32()))]
            if decoded:
                values.append(pa.array([automaton.decode(tokens) for tokens in found], pa.string()))
            yield start, stop, values

    kept = [name for name in docs.columns if name != text and name not in added]
    return _mapped(docs, added, kept, text, run)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text that their token ids stand for; NULL ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.labels)

    def run(column: pa.Array):
        labels = shared.value
        for start in range(0, len(column), 256):
            part = column.slice(start, 256).to_pylist()
            texts = [b"".join([labels[token] for token in tokens or ()]).decode("utf-8", "replace") for tokens in part]
            yield start, start + len(part), [pa.array(texts, pa.string())]

    return _mapped(rows, {text: T.StringType()}, [name for name in rows.columns if name != text], ids, run)
