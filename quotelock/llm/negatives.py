"""Hard negatives by the threshold algorithm over lists sorted per dimension.

Vectors become integers, and a score is an integer inner product. Candidates are dealt to
shards of bounded size; a shard keeps, for every dimension, its rows sorted by that
component. For one anchor the lists are read from the end that the sign of the anchor's
component favours, all to the same depth. Every row met is scored whole by random access.
No row that was not met can score more than the threshold, the sum over the dimensions of
the anchor's component times the last one read; reading stops once it is strictly below the
kth score of every window that is still wanted.

Positives come first (rows of the anchor's label, lists of that label), negatives after them
(rows of other labels, one window of scores for each positive). Blocks of anchors meet every
shard by an equi join on (shard, block); the best of each shard are cut to the best of all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelock.llm.staging import staged

POSITIVES = 5
NEGATIVES = 3
SCALE = 256
#: A negative scores at least a half and at most nineteen twentieths of its positive.
LEAST, MOST, PARTS = 50, 95, 100
SHARD_ROWS = 4096
BLOCK_ANCHORS = 4096
FIRST_DEPTH = 16

#: Sums of products below this are exact in doubles.
_EXACT = 1 << 53


def participants(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(key, label, vector)`` of the rows that take part: no NULL, all components finite."""
    named = rows.select(F.col(key).cast("bigint").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    unusable = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.where("key is not null and label is not null and vector is not null").where(~unusable)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Scaled integer components, as doubles while these are exact; short vectors end in zeros."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.ListArray) else column.cast(pa.list_(column.type.value_type))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    inside = np.arange(width) < lengths[:, None]
    out[inside] = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def _exactly(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a type in which inner products are exact."""
    most = lambda m: np.abs(m).max(initial=0.0)
    if rows.shape[1] * most(rows) * most(anchors) < _EXACT:
        return rows, anchors
    whole = np.vectorize(int, otypes=[object])
    return (m if not m.size else whole(m) for m in (rows, anchors))  # type: ignore[return-value]


class SortedLists:
    """The rows of a shard, sorted by each of their components."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable").T if len(rows) else np.empty((rows.shape[1], 0), np.int64)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, wanted: Callable[[np.ndarray], object]) -> tuple[np.ndarray, np.ndarray]:
        """Allowed rows met, and their scores, until ``wanted`` has no use for lower ones.

        ``wanted(scores)`` is the least score of a row not met that could still count, or
        None. Lists are read in steps that double, as many rows of each.
        """
        met = np.zeros(len(self.rows), bool)
        dims = np.flatnonzero(anchor != 0)
        down = anchor[dims] > 0
        found, scores = [], []
        depth, step, size = 0, FIRST_DEPTH, len(self.rows)
        if not len(dims):
            depth, fresh = size, np.flatnonzero(allowed)
            found.append(fresh)
            scores.append(np.zeros(len(fresh), self.rows.dtype))
        while depth < size:
            stop = min(size, depth + step)
            touched = np.zeros(size, bool)
            touched[self.order[dims[down], size - stop : size - depth]] = True
            touched[self.order[dims[~down], depth:stop]] = True
            touched &= ~met
            met |= touched
            fresh = np.flatnonzero(touched & allowed)
            found.append(fresh)
            scores.append(self.rows[fresh] @ anchor)
            depth, step = stop, 2 * step
            if met.all():
                break
            last = np.empty(len(dims), np.int64)
            last[down] = self.order[dims[down], size - depth]
            last[~down] = self.order[dims[~down], depth - 1]
            threshold = (anchor[dims] * self.rows[last, dims]).sum()
            least = wanted(np.concatenate(scores))
            if least is None or threshold < least:
                break
        none = np.empty(0, np.int64)
        return (np.concatenate(found) if found else none), (np.concatenate(scores) if scores else none)


def _least_of_best(most: int) -> Callable[[np.ndarray], object]:
    """The kth score, below which no row is wanted; anything while there are fewer."""

    def wanted(scores: np.ndarray) -> object:
        return np.partition(scores, len(scores) - most)[len(scores) - most] if len(scores) >= most else float("-inf")

    return wanted


def _inside(scores: np.ndarray, positive: int) -> np.ndarray:
    return (LEAST * positive <= PARTS * scores) & (PARTS * scores <= MOST * positive)


def _least_of_windows(positives: list[int], most: int) -> Callable[[np.ndarray], object]:
    """The least of the kth scores of all windows; a window's own lower end while it has fewer."""
    able = [score for score in positives if score >= 0]

    def wanted(scores: np.ndarray) -> object:
        ends = []
        for positive in able:
            inside = scores[_inside(scores, positive)]
            full = len(inside) >= most
            ends.append(np.partition(inside, len(inside) - most)[len(inside) - most] if full else -(-LEAST * positive // PARTS))
        return min(ends) if ends else None

    return wanted


def _best(scores: np.ndarray, keys: np.ndarray, numbers: np.ndarray, most: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], keys[i], numbers[i]))[:most], np.int64)
    return np.lexsort((numbers, keys, -scores))[:most]


def _cell(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    column = lambda name: table.column(name).to_numpy()
    labels = np.array(table.column("label").to_pylist(), object)
    return column("key"), column("number"), labels, _matrix(table.column("vector"), width)


def _width(*tables: pa.Table) -> int:
    lengths = [np.diff(chunk.offsets.to_numpy()) for t in tables for chunk in t.column("vector").chunks]
    return max((int(part.max(initial=0)) for part in lengths), default=0)


def _positives_of_cell(most: int):
    def run(shard: pa.Table, anchors: pa.Table) -> pa.Table:
        width = _width(shard, anchors)
        (keys, numbers, labels, rows), (own, own_number, own_label, vectors) = (_cell(t, width) for t in (shard, anchors))
        rows, vectors = _exactly(rows, vectors)
        out: list[list] = [[], [], [], []]
        for label in set(own_label.tolist()) & set(labels.tolist()):
            at = np.flatnonzero(labels == label)
            lists = SortedLists(rows[at])
            for a in np.flatnonzero(own_label == label):
                found, scores = lists.search(vectors[a], keys[at] != own[a], _least_of_best(most))
                chosen = _best(scores, keys[at][found], numbers[at][found], most)
                out[0] += [own_number[a]] * len(chosen)
                out[1] += keys[at][found][chosen].tolist()
                out[2] += numbers[at][found][chosen].tolist()
                out[3] += [int(score) for score in scores[chosen]]
        return pa.table([pa.array(values, pa.int64()) for values in out], names=["anchor", "positive_id", "row", "score"])

    return run


def _negatives_of_cell(most: int):
    def run(shard: pa.Table, anchors: pa.Table) -> pa.Table:
        width = _width(shard, anchors)
        (keys, numbers, labels, rows), (_, own_number, own_label, vectors) = (_cell(t, width) for t in (shard, anchors))
        rows, vectors = _exactly(rows, vectors)
        lists = SortedLists(rows)
        out: list[list] = [[], [], [], [], []]
        for a, positives in enumerate(anchors.column("positives").to_pylist()):
            windows = sorted(set(positives))
            found, scores = lists.search(vectors[a], labels != own_label[a], _least_of_windows(windows, most))
            for positive in windows:
                inside = np.flatnonzero(_inside(scores, positive))
                chosen = inside[_best(scores[inside], keys[found[inside]], numbers[found[inside]], most)]
                out[0] += [own_number[a]] * len(chosen)
                out[1] += [positive] * len(chosen)
                out[2] += keys[found[chosen]].tolist()
                out[3] += numbers[found[chosen]].tolist()
                out[4] += [int(score) for score in scores[chosen]]
        names = ["anchor", "positive_score", "negative_id", "row", "negative_score"]
        return pa.table([pa.array(values, pa.int64()) for values in out], names=names)

    return run


def _met(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, run, schema: str) -> DataFrame:
    """``run`` over every pair of a shard of rows and a block of anchors."""
    every = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = rows.select("key", "number", "label", "vector", "shard", every("block", blocks)).groupBy("shard", "block")
    columns = [name for name in anchors.columns if name != "block"]
    right = anchors.select(*columns, "block", every("shard", shards)).groupBy("shard", "block")
    return left.cogroup(right).applyInArrow(run, schema)


def _ranked(rows: DataFrame, group: list[str], score: str, key: str, most: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), key, "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Callable[[Column], Column],
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    shard_rows: int = SHARD_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` makes a condition of the key's column. Rows with a NULL key, label, vector or
    component, or with a component that is not finite, take no part. Equal rows (key, label
    and vector) count once; rows of one key with different vectors are rows of their own,
    no positives of each other, and tie by an arbitrary but fixed number. Vectors of
    different lengths meet as if the shorter ended in zeros. Scores are exact while they
    fit a long; larger ones are an error. Other columns are ignored.
    """
    taking = participants(rows, key, vector, label).dropDuplicates()
    numbered = staged(taking.withColumn("number", F.monotonically_increasing_id()), "vectors")
    anchors = staged(
        numbered.where(is_anchor(F.col("key"))), "anchors"
    )
    shards = max(1, -(-numbered.count() // shard_rows))
    blocks = max(1, -(-anchors.count() // block_anchors))
    dealt = numbered.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int"))
    blocked = anchors.select(
        "key", "number", "label", "vector", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int").alias("block")
    )
    near = _met(
        dealt, blocked, shards, blocks, _positives_of_cell(positives), "anchor bigint, positive_id bigint, row bigint, score bigint"
    )
    chosen = staged(
        _ranked(near, ["anchor"], "score", "positive_id", positives).select(
            "anchor", "positive_id", F.col("row").alias("positive_row"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    windows = chosen.groupBy("anchor").agg(F.collect_set("positive_score").alias("positives"))
    wanting = blocked.join(windows, blocked["number"] == windows["anchor"]).drop("anchor")
    far = _met(
        dealt, wanting, shards, blocks, _negatives_of_cell(negatives),
        "anchor bigint, positive_score bigint, negative_id bigint, row bigint, negative_score bigint",
    )
    best = _ranked(far, ["anchor", "positive_score"], "negative_score", "negative_id", negatives)
    ids = anchors.select(F.col("number").alias("anchor"), F.col("key").alias("anchor_id"))
    return (
        chosen.join(best, ["anchor", "positive_score"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
