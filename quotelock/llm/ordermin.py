"""Near copies by order MinHash and banded alignment.

A text is its sequence of five-word shingles. For sketches only, each has the number of its
occurrence. A sketch under one hash order is the two least shingles in the order in which
the text has them; a band joins the sketches of four orders. Texts that agree in a band are
candidates. A candidate's similarity is that of an alignment: shingles matched in one order
of both texts, whichever occurrences they are, over all shingles of the two.

Texts of equal words are one node, however many documents have them. In a bucket, nodes
first meet its hub, the one that shares most buckets with others: of many copies of one
text that is the text itself. What is left are outsiders: nodes of a bucket that are not
in its hub's component. They meet others of the bucket by their differences from the hub.

Let D(a) be the labelled shingles that only one of ``a`` and the hub has. Then a and b differ
by the members that only one of D(a) and D(b) has, and a similarity of s allows at most
``(|a| + |b|) (1 - s) / (1 + s)`` of these. So D(a) and D(b) share at least half of
``slack(a) + slack(b)``, with ``slack(a) = |D(a)| - |a| (1 - s) / (1 + s)``. Two sets that share
so many members share one of the first few of both in any one order; rare members come
first, so copies that each have edits of their own meet nobody. Where the bound asks for
no shared member, both are copies of the hub but for the order of their parts; then the
distances by alignment from the hub, which differ by no more than the allowed distance,
decide who meets. Both bounds hold for every pair, so no link is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelock.llm.buffers import PLAIN, Words, buffer, find_words, mixed, per_text, slices
from quotelock.llm.components import components
from quotelock.llm.staging import staged

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 48
ROWS = 4
#: Matches per shingle up to which an alignment is a rising run; with more, bits are faster.
MATCHES = 8

_LABEL = np.uint64(0xE7037ED1A0B428DB)
_FIRST = np.uint64(0x8EBC6AF09C88C6E3)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(column: pa.Array) -> Words:
    """Lower-case runs of letters and digits; other ASCII characters separate them."""
    data, offsets = buffer(pc.utf8_lower(column.cast(pa.large_string())))
    return find_words(data, offsets, PLAIN)


def shingles(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts, and each text's range of them."""
    starts, windows = words.windows(hashes, SHINGLE)
    owner = words.owner()[starts]
    return windows, np.searchsorted(owner, np.arange(len(words.first)))


def labelled(windows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The shingles with the number of their occurrence in their text."""
    if not len(windows):
        return windows
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys = mixed(windows ^ mixed(owner.astype(np.uint64), 1))
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    places = np.arange(len(order))
    label = np.empty(len(order), np.uint64)
    label[order] = (places - np.maximum.accumulate(np.where(new, places, 0))).astype(np.uint64)
    return mixed(windows + label * _LABEL)


def sketch(values: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band values by text with shingles."""
    full = np.flatnonzero(np.diff(bounds))
    starts, counts = bounds[full], np.diff(bounds)[full]
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(full), bands), np.uint64)
    several = counts > 1
    for number, factor in enumerate(factors):
        ordered = values * factor
        ordered ^= ordered >> np.uint64(32)
        first = np.flatnonzero(ordered == np.repeat(np.minimum.reduceat(ordered, starts), counts))
        ordered[first] = _LAST
        second = first.copy()
        found = np.flatnonzero(ordered == np.repeat(np.minimum.reduceat(ordered, starts), counts))
        second[several] = found[np.repeat(several, counts)[found]]
        one, two = values[np.minimum(first, second)], values[np.maximum(first, second)]
        out[:, number // rows] = mixed(out[:, number // rows] + mixed(one) * _FIRST + two)
    return out


def _sketch_batches(bands: int, rows: int):
    names = ["nokey", "key", "text_hash", "d1", "d2", "n_words", "n_shingles", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(3)):
                part = batch.slice(start, stop - start)
                words = words_of(part.column(3))
                hashes = words.hashes()
                place = (np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
                digests = [
                    per_text(mixed(hashes + place * _FIRST, seed).view(np.int64), words.first) for seed in (1, 2)
                ]
                values, bounds = shingles(words, hashes)
                lists: list = [[]] * part.num_rows
                if len(values):
                    found = sketch(labelled(values, bounds), bounds, bands, rows).view(np.int64)
                    for row, own in zip(np.flatnonzero(np.diff(bounds)).tolist(), found, strict=True):
                        lists[row] = own
                columns = [
                    *part.columns[:3], *map(pa.array, digests),
                    pa.array(words.counts.astype(np.int64)), pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(lists, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> int:
    """Most shingles that both sequences have in one order.

    When too few match for the similarity in any order, their number is returned.

    An alignment that reaches ``similarity`` leaves out at most ``band`` shingles of either
    side, so no match in it shifts further. Few matches within the band are taken in the
    order of ``a``, and of one shingle of ``a`` the last first: the alignment is the longest
    rising run of their places in ``b``. Many are counted by bits (:func:`common_order`).
    """
    kinds, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    of_left, of_right = (np.bincount(side, minlength=len(kinds)) for side in (left, right))
    least = similarity * (len(a) + len(b)) / (1 + similarity)
    both = int(np.minimum(of_left, of_right).sum())
    if both < least - 1e-9:
        return both
    size = min(len(left), len(right))
    other = np.flatnonzero(left[:size] != right[:size])
    head = int(other[0]) if len(other) else size
    size -= head
    other = np.flatnonzero(left[len(left) - size :][::-1] != right[len(right) - size :][::-1])
    tail = int(other[0]) if len(other) else size
    left, right = left[head : len(left) - tail], right[head : len(right) - tail]
    if not len(left) or not len(right):
        return head + tail
    order = np.argsort(right, kind="stable")
    start = np.searchsorted(right[order], left)
    counts = np.searchsorted(right[order], left, side="right") - start
    if counts.sum() > MATCHES * (len(left) + len(right)):
        return head + tail + common_order(left[counts > 0].tolist(), right[np.isin(right, left)].tolist())
    places = np.repeat(np.arange(len(left)), counts)
    last = np.repeat(start + counts - 1, counts)
    back = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
    found = order[last - back]
    near = np.abs(places - found) <= max(len(a), len(b)) - least + 1e-9
    tails: list[int] = []
    for place in found[near].tolist():
        at = bisect_left(tails, place)
        tails[at : at + 1] = [place]
    return head + tail + len(tails)


def common_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; a row of its table is one number of bits."""
    masks: dict[int, int] = {}
    for place, value in enumerate(a):
        masks[value] = masks.get(value, 0) | 1 << place
    whole = (1 << len(a)) - 1
    row = whole
    for value in b:
        met = row & masks.get(value, 0)
        row = ((row + met) | (row - met)) & whole
    return len(a) - row.bit_count()


def _verify_batches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                sides = []
                for column in (part.column(2), part.column(3)):
                    words = words_of(column)
                    sides.append(shingles(words, words.hashes()))
                (left, left_at), (right, right_at) = sides
                found = []
                for row in range(part.num_rows):
                    a, b = left[left_at[row] : left_at[row + 1]], right[right_at[row] : right_at[row + 1]]
                    both = aligned(a, b, similarity) if len(a) and len(b) else 0
                    found.append(both / (len(a) + len(b) - both) if both else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
                )

    return run


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of nodes with the similarity of their texts, where high enough."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    measured = sides.select("a", "b", "text_a", "text_b").mapInArrow(
        _verify_batches(similarity), "a bigint, b bigint, similarity double"
    )
    return measured.where(F.col("similarity") >= similarity)


def _ordered(left, right) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _difference_batches(similarity: float):
    """Of (node, hub, texts): the members only one side has, and the distance by alignment of like sets."""
    names = ["node", "hub", "n", "delta", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                sides = []
                for column in (part.column(2), part.column(3)):
                    words = words_of(column)
                    values, bounds = shingles(words, words.hashes())
                    sides.append((values, labelled(values, bounds), bounds))
                (left, left_labels, left_at), (right, right_labels, right_at) = sides
                sizes, deltas, distances = [], [], []
                for row in range(part.num_rows):
                    one, two = slice(left_at[row], left_at[row + 1]), slice(right_at[row], right_at[row + 1])
                    a, b = left[one], right[two]
                    delta = np.setxor1d(left_labels[one], right_labels[two]).view(np.int64)
                    allowed = (len(a) + len(b)) * (1 - similarity) / (1 + similarity)
                    alike = len(delta) <= allowed + 1e-9
                    sizes.append(len(a))
                    deltas.append(delta)
                    distances.append(len(a) + len(b) - 2 * common_order(a.tolist(), b.tolist()) if alike else None)
                columns = [
                    part.column(0), part.column(1), pa.array(sizes, pa.int64()),
                    pa.array(deltas, pa.list_(pa.int64())), pa.array(distances, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _outsider_pairs(buckets: DataFrame, found: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of nodes of one hub's buckets, in different components, that could be similar.

    ``buckets`` has (band, node, hub) and ``found`` (node, component) of every linked node.
    """
    ratio = (1 - similarity) / (1 + similarity)
    placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_hub = found.select(F.col("node").alias("hub"), F.col("component").alias("main"))
    open_bands = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    members = staged(
        placed.join(open_bands.select("band"), "band")
        .select("node", "hub", "component")
        .distinct()
        .join(of_hub, "hub", "left")
        .withColumn("main", F.coalesce("main", "hub")),
        "open-members",
    )
    sides = (
        members.select("node", "hub")
        .join(texts.select("node", F.col("text").alias("text_a")), "node")
        .join(texts.select(F.col("node").alias("hub"), F.col("text").alias("text_b")), "hub")
        .select("node", "hub", "text_a", "text_b")
    )
    measured = sides.mapInArrow(
        _difference_batches(similarity), "node bigint, hub bigint, n bigint, delta array<bigint>, distance bigint"
    )
    differing = staged(
        measured.join(members, ["node", "hub"]).select(
            "node", "hub", "n", "delta", "distance", "component",
            (F.col("component") != F.col("main")).alias("outside"),
            (F.size("delta") - F.col("n") * ratio).alias("slack"),
        ),
        "differences",
    )
    slacks = differing.groupBy("hub").agg(
        F.min("slack").alias("of_any"), F.min(F.when(F.col("outside"), F.col("slack"))).alias("of_outside")
    )
    wide = (
        differing.join(slacks, "hub")
        .withColumn("partner", F.when(F.col("outside"), F.col("of_any")).otherwise(F.col("of_outside")))
        .where("partner is not null")
        .withColumn("size", F.size("delta"))
        .withColumn("reach", F.least("size", F.floor(F.col("size") - (F.col("slack") + F.col("partner")) / 2 + 1e-6) + 1))
    )
    rows = wide.select("hub", "node", "n", "component", "outside", "slack", "size", "reach", F.explode("delta").alias("member"))
    often = rows.groupBy("hub", "member").agg(
        F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("outside").alias("any_outside")
    )
    # The place of a member counts all members of its set, also those that no other component has.
    rarest = Window.partitionBy("hub", "node").orderBy("often", "member")
    first = staged(
        rows.join(often, ["hub", "member"])
        .withColumn("place", F.row_number().over(rarest) - 1)
        .where("place < reach and low <> high and any_outside")
        .drop("often", "low", "high", "any_outside", "reach"),
        "first-members",
    )
    other = first.select(
        "hub", "member", *(F.col(name).alias(f"other_{name}") for name in ("node", "n", "component", "slack", "size", "place"))
    )
    needed = (F.col("slack") + F.col("other_slack")) / 2 - 1e-6
    alike = F.least("n", "other_n") >= similarity * F.greatest("n", "other_n")
    by_members = (
        first.where("outside")
        .join(other, ["hub", "member"])
        .where(alike & (F.col("component") != F.col("other_component")))
        .where(F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place")) >= needed)
        .select(*_ordered(F.col("node"), F.col("other_node")))
    )
    moved = differing.where("distance is not null").drop("delta")
    movers = moved.where("outside").withColumnsRenamed(
        {name: f"other_{name}" for name in ("node", "n", "component", "slack", "distance")}
    )
    by_order = (
        moved.join(movers.drop("outside"), "hub")
        .where(alike & (F.col("component") != F.col("other_component")))
        .where(F.col("slack") + F.col("other_slack") <= 1e-6)
        .where(F.abs(F.col("distance") - F.col("other_distance")) <= (F.col("n") + F.col("other_n")) * ratio + 1e-6)
        .select(*_ordered(F.col("node"), F.col("other_node")))
    )
    return by_members.union(by_order).distinct()


#: A row's key in ``near_copies``: NULL keys come last.
_KEY = ["nokey", "key", "text_hash"]


def _keyed(key: str, text: str) -> list:
    return [
        F.col(key).isNull().alias("nokey"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("key"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"),
    ]


def _classified(docs: DataFrame, key: str, text: str, similarity: float, bands: int, rows: int) -> DataFrame:
    """Per row ``nokey``, ``key``, ``text_hash``, ``n_words`` and ``least``, the least key of its class."""
    source = docs.select(*_keyed(key, text), F.col(text).cast("string").alias("text"))
    schema = (
        "nokey boolean, key bigint, text_hash bigint, d1 bigint, d2 bigint, n_words bigint, n_shingles bigint, "
        "bands array<bigint>"
    )
    sketched = staged(source.mapInArrow(_sketch_batches(bands, rows), schema), "sketches")
    content = ["d1", "d2", "n_words"]
    nodes = staged(
        sketched.where("n_words > 0")
        .groupBy(*content, "n_shingles", "bands")
        .agg(F.min(F.struct(*_KEY)).alias("least"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    in_bands = nodes.select("node", "n_shingles", F.posexplode("bands").alias("at", "value")).select(
        "node", "n_shingles", F.xxhash64("at", "value").alias("band")
    )
    shared = in_bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    sized = staged(in_bands.join(shared, "band"), "bands")
    degrees = sized.groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree"))
    ranked = sized.join(degrees, "node")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("most"))
    buckets = staged(
        sized.drop("size").join(hubs.select("band", F.col("most.node").alias("hub")), "band"), "buckets"
    )
    sizes = nodes.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_shingles"))
    meets = staged(
        buckets.where("node <> hub").select("node", "hub", "n_shingles").distinct().join(sizes, "hub")
        .where(F.least("n_shingles", "hub_shingles") >= similarity * F.greatest("n_shingles", "hub_shingles"))
        .select(*_ordered(F.col("node"), F.col("hub")))
        .distinct(),
        "pairs",
    )
    wanted = buckets.select("node").distinct().join(nodes.select("node", "least.*"), "node")
    texts = staged(source.join(wanted, _KEY).select("node", "text").dropDuplicates(["node"]), "texts")
    edges = staged(_verified(meets, texts, similarity), "edges")
    found = staged(components(edges), "components")
    pairs = staged(_outsider_pairs(buckets.select("band", "node", "hub"), found, texts, similarity), "pairs")
    fresh = staged(_verified(pairs.join(meets, ["a", "b"], "left_anti"), texts, similarity), "edges")
    if fresh.limit(1).count():
        found = staged(components(edges.union(fresh)), "components")
    classes = nodes.join(found, "node", "left").select(
        *content, "least", F.coalesce("component", "node").alias("component")
    )
    least = classes.groupBy("component").agg(F.min("least").alias("least"))
    of_content = classes.drop("least").join(least, "component").select(*content, "least")
    return sketched.join(of_content, content, "left").select(
        *_KEY, "n_words", F.coalesce("least", F.struct(*_KEY)).alias("least")
    )


def near_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(key, text_hash, n_words, class_id)`` for every row; ``class_id`` is its class's least key.

    Rows of equal words are in one class; so are texts linked, over any number of steps,
    by a similarity of at least ``similarity``. Texts of fewer than five words only match
    equal ones, and texts without a word match nothing: their class is their own key. A
    NULL key comes after all others. Whole texts count, however long. Other columns are
    ignored.
    """
    own = lambda name: F.when(~F.col(f"{name}nokey"), F.col(f"{name}key"))
    return _classified(docs, key, text, similarity, bands, rows).select(
        own("").alias(key), "text_hash", "n_words", own("least.").alias("class_id")
    )


def one_per_class(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """The rows of ``docs`` whose key is the least of their class, with their columns.

    Of several rows with that key the one with the least text hash stays, and one of equal
    rows; texts without a word are in no class and stay, one for each key.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), *_keyed(key, text))
    kept = _classified(docs, key, text, similarity, bands, rows).select("least.*").distinct()
    return named.join(staged(kept, "kept-rows"), _KEY, "left_semi").dropDuplicates(_KEY).select("row.*")
