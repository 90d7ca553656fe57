"""Quality rules with host verdicts.

Every text gets counts and a base rule. Failures are summed per host, each host's failure
rate is shrunk towards the corpus by a beta prior fitted to all hosts, and documents of
hosts whose shrunk rate is over a limit go as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.llm.buffers import WHITE, buffer, find_words, mixed, per_text, slices
from quotelock.llm.staging import staged

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
HOST_LIMIT = 0.5
STRENGTH = (1.0, 1e6)

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _counts(column: pa.Array) -> list[np.ndarray]:
    data, offsets = buffer(column)
    words = find_words(data, offsets)
    continuation = (data & 0xC0) == 0x80
    covered = np.zeros(len(words.starts), bool)
    starts, windows = words.windows(words.hashes(), WINDOW)
    if len(starts):
        keys = mixed(windows ^ mixed(words.owner()[starts].astype(np.uint64), 1))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        found = np.zeros(len(covered), bool)
        found[starts[order[1:][same]]] = True
        found[starts[order[:-1][same]]] = True
        for step in range(WINDOW):
            covered[step:] |= found[: len(found) - step]
    raw = data.tobytes()
    lines = [_repeated_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return [
        words.counts.astype(np.int64),
        per_text(~(continuation | WHITE[data]), offsets),
        per_text(SYMBOL[data], offsets),
        np.asarray(lines, np.int64),
        per_text(covered, words.first),
    ]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        for start, stop in slices(text):
            part = batch.slice(start, stop - start)
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            counts = [pa.array(values) for values in _counts(part.column(part.num_columns - 1))]
            names = [f"c{i}" for i in range(len(columns) + len(counts))]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=names)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without their text, with :data:`COUNTS` and ``base_failed``.

    NULL text counts as empty (no words, so it fails). Columns of ``docs`` that have one of
    these names are replaced. Window hashes have 64 bits and meet inside one text only.
    """
    kept = [name for name in docs.columns if name != text and name not in (*COUNTS, "base_failed")]
    kinds = [docs.schema[name].dataType.simpleString() for name in kept]
    schema = ", ".join(
        f"c{i} {kind}" for i, kind in enumerate([*kinds, *("bigint" for _ in COUNTS)])
    )
    counted = docs.select(*kept, F.col(text).cast("string")).mapInArrow(_count_batches, schema)
    return counted.toDF(*kept, *COUNTS).withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Beta parameters with these moments; hosts that do not differ give the strongest."""
    if mean is None or not 0 < mean < 1:
        return (STRENGTH[1] * (mean or 0.0), STRENGTH[1] * (1 - (mean or 0.0)))
    least, most = STRENGTH
    strength = most if not variance else min(most, max(least, mean * (1 - mean) / variance - 1))
    return mean * strength, (1 - mean) * strength


def host_verdicts(counts: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, failures, shrunk ``failure_rate`` and ``host_failed``.

    A NULL host is a host of its own. The prior is fitted from two moments over all hosts.
    """
    hosts = staged(
        counts.groupBy(F.col(host).alias("host")).agg(
            F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed")
        ),
        "hosts",
    )
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    alpha, beta = beta_prior(*moments)
    shrunk = (F.col("n_failed") + alpha) / (F.col("n_docs") + alpha + beta)
    return hosts.withColumn("failure_rate", shrunk).withColumn("host_failed", F.col("failure_rate") > limit)


def judge(counts: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Add ``host_failed`` and ``kept``: no base rule failed and the host did not either."""
    of_host = verdicts.select(F.col("host").alias("_host"), F.col("host_failed"))
    rows = counts.drop("host_failed", "kept")
    return (
        rows.join(of_host, rows[host].eqNullSafe(of_host["_host"]), "left")
        .drop("_host")
        .withColumn("kept", ~(F.col("base_failed") | F.coalesce("host_failed", F.lit(False))))
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents of ``docs`` that are kept, with their columns as they are.

    Texts are counted twice instead of moved: once for the hosts, once beside the rows.
    """
    verdicts = staged(host_verdicts(text_counts(docs.select(host, text), text), host), "host-verdicts")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    return judge(text_counts(named), verdicts, "host").where("kept").select("row.*")
