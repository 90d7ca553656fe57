"""Audits: what was supplied against what an index says, and cross checks of heads.

A full outer join cannot split a hot key. The audits therefore are a left join of the
supplied rows to the index, which can, plus an anti join for what is missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.functions.digests import is_digest, is_text, packed, unpacked
from quotelock.functions.ladder import first_failure, holds
from quotelock.plans.blocks import running_sum


def audit(
    index: DataFrame,
    supplied: DataFrame,
    group: Sequence[str],
    head: str,
    compare: Mapping[str, str],
    prefix: str,
    position: str | None = None,
    size: str | None = None,
    max_bytes: int | None = None,
    mismatch: str = "METADATA_MISMATCH",
) -> DataFrame:
    """Verdict per supplied row, and one MISSING row per indexed head not supplied.

    ``index`` has the group columns, ``sequence``, the head and the indexed values named
    by ``compare`` (index column -> supplied column). With ``position`` the order counts:
    a head found at another place is REORDERED. ``size`` and ``max_bytes`` bound the
    running total per group. A row without a place is ORDER_INVALID, and of a head supplied
    twice at one place neither copy is verified. Texts move in packed form.
    """
    keys = [*group, head]
    rows = supplied
    if size is not None and position is not None and max_bytes is not None:
        rows = running_sum(rows, group, position, F.col(size), "_total", tiebreak=[head])
    order = position or "supply_order"
    if order not in rows.columns:
        raise ValueError(f"supplied rows need {order}")
    texts = {name for name in keys if is_text(index, name) and is_text(supplied, name)}
    lean_keys = [packed(F.col(name)).alias(name) if name in texts else F.col(name) for name in keys]

    def lean(rows: DataFrame, name: str, both: bool) -> Column:
        return packed(rows[name]) if both else rows[name]

    stored_values, given_values = [], []
    for number, (stored, given) in enumerate(compare.items()):
        both = is_text(index, stored) and is_text(supplied, given)
        stored_values.append(lean(index, stored, both).alias(f"_{number}"))
        given_values.append(lean(rows, given, both).alias(f"_{number}"))
    places = index.select(*lean_keys, "sequence", F.struct(*stored_values).alias("_values"))
    indexed = places.groupBy(*keys).agg(
        F.min("sequence").alias("_sequence"), F.min_by("_values", "sequence").alias("_indexed")
    )
    rows = rows.select(
        *lean_keys, order, F.struct(*given_values).alias("_given"), *[name for name in rows.columns if name == "_total"]
    )
    first = (
        rows.groupBy(*keys, order)
        .agg(F.count("*").alias("_copies"))
        .groupBy(*keys)
        .agg(F.min(order).alias("_first"), F.min_by("_copies", order).alias("_copies"))
    )
    joined = rows.join(first, keys, "left").join(indexed, keys, "left")
    equal = F.lit(True)
    for number in range(len(compare)):
        equal = equal & F.col("_indexed")[f"_{number}"].eqNullSafe(F.col("_given")[f"_{number}"])
    rules: list = [
        (F.col(order).isNotNull(), f"{prefix}_ORDER_INVALID"),
        (F.col("_first").isNull() | ((F.col(order) == F.col("_first")) & (F.col("_copies") == 1)), f"{prefix}_DUPLICATE"),
    ]
    rules.append((F.col("_sequence").isNotNull(), f"{prefix}_UNEXPECTED"))
    if position is not None:
        rules.append((F.col("_sequence") == F.col(position), f"{prefix}_REORDERED"))
    rules.append((equal, f"{prefix}_{mismatch}"))
    if "_total" in rows.columns:
        rules.append((F.col("_total") <= max_bytes, f"{prefix}_BYTES_EXCEEDED"))
    verdicts = joined.select(
        *keys,
        F.col(order).cast("bigint").alias("position"),
        first_failure(rules, passed=F.lit("VERIFIED")).alias("verdict"),
    )
    absent = missing_items(places, rows, keys).select(
        *keys,
        F.col("sequence").cast("bigint").alias("position"),
        F.lit(f"{prefix}_MISSING").alias("verdict"),
    )
    found = verdicts.unionByName(absent)
    return found.select(
        *[unpacked(F.col(name)).alias(name) if name in texts else F.col(name) for name in keys], "position", "verdict"
    )


def missing_items(index: DataFrame, supplied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Indexed rows that were not supplied."""
    return index.join(supplied.select(*keys).distinct(), list(keys), "left_anti")


PACKET_COMPARE = {
    "source_sha256": "source_sha256",
    "source_byte_length": "source_byte_length",
    "candidate_id": "candidate_id",
    "evidence_id": "evidence_id",
}
TRANSITION_COMPARE = {
    name: name
    for name in (
        "previous_bundle_sha256",
        "next_bundle_sha256",
        "previous_index_sha256",
        "next_index_sha256",
        "previous_packet_count",
        "next_packet_count",
        "appended_packet_count",
    )
}
PACK_COMPARE = {
    name: name
    for name in (
        "release_version",
        "package_sha256",
        "statement_sha256",
        "revision",
        "bundle_sha256",
        "manifest_sha256",
        "receipt_sha256",
    )
}
BINDING_COMPARE = {
    name: name
    for name in (
        "previous_package_version",
        "current_package_version",
        "previous_pack_sha256",
        "current_pack_sha256",
        "upgrade_evidence_sha256",
    )
}


def collection_audit(
    index: DataFrame,
    supplied: DataFrame,
    group: Sequence[str],
    max_bytes: int | None = None,
    head: str = "packet_sha256",
    size: str = "source_byte_length",
    compare: Mapping[str, str] = PACKET_COMPARE,
) -> DataFrame:
    """Supplied packets against the packet index, by position."""
    return audit(
        index, supplied, group, head, compare, "PACKET_COLLECTION", "position", size, max_bytes
    )


def history_audit(index: DataFrame, receipts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Transition receipts against the history index, by position."""
    return audit(
        index, receipts, group, "transition_audit_sha256", TRANSITION_COMPARE,
        "PACKET_TRANSITION_HISTORY_AUDIT", "position", mismatch="PROJECTION_MISMATCH",
    )


def archive_audit(index: DataFrame, packs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Release packs against the release index, in any order."""
    return audit(index, packs, group, "pack_sha256", PACK_COMPARE, "ARCHIVE_PACK")


def upgrade_audit(index: DataFrame, bindings: DataFrame, group: Sequence[str]) -> DataFrame:
    """Binding receipts against the upgrade history, in any order."""
    return audit(index, bindings, group, "binding_sha256", BINDING_COMPARE, "UPGRADE_AUDIT_BINDING")


def audit_outcome(
    verdicts: DataFrame, group: Sequence[str], ordered: bool = True, prefix: str = ""
) -> DataFrame:
    """The one code a group is rejected with, or ``verified``.

    Ordered audits compare counts first; after that the first bad position decides.
    Unordered audits report what is missing last.
    """
    missing = F.col("verdict").endswith("_MISSING")
    bad = ~missing & (F.col("verdict") != "VERIFIED")
    totals = verdicts.groupBy(*group).agg(
        F.count_if(~missing).alias("supplied"),
        F.count_if(missing).alias("missing"),
        F.count_if(F.col("verdict") == "VERIFIED").alias("verified"),
        F.count_if(F.col("verdict").endswith("_DUPLICATE") | F.col("verdict").endswith("_UNEXPECTED")).alias(
            "surplus"
        ),
        F.coalesce(
            F.min_by("verdict", F.when(bad, F.col("position"))), F.min(F.when(bad, F.col("verdict")))
        ).alias("_first_bad"),
        F.max(F.when(missing, F.col("verdict"))).alias("_missing"),
    )
    surplus_code = F.lit(f"{prefix}_UNEXPECTED")
    if ordered:
        outcome = (
            F.when(F.col("missing") > F.col("surplus"), F.col("_missing"))
            .when(F.col("missing") < F.col("surplus"), surplus_code)
            .otherwise(F.coalesce("_first_bad", "_missing", F.lit("verified")))
        )
    else:
        outcome = F.coalesce("_first_bad", "_missing", F.lit("verified"))
    return totals.withColumn("outcome", outcome).drop("_first_bad", "_missing")


def trust_mode_counts(packs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Verified packs per trust mode and the sum of their review signers."""
    return packs.groupBy(*group).agg(
        F.count("*").alias("verified_pack_count"),
        F.sum("verified_signer_count").cast("bigint").alias("review_verified_count"),
        F.count_if(F.col("trust_mode") == "manual").alias("manual_count"),
        F.count_if(F.col("trust_mode") != "manual").alias("rotation_history_count"),
    )


def receipt_crosscheck(
    receipts: DataFrame,
    summaries: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str],
    code: str = "PACKET_COLLECTION_AUDIT_MISMATCH",
) -> DataFrame:
    """A retained receipt against the summary recomputed from its index."""
    renamed = summaries.select(
        *keys, *[F.col(name).alias(f"_{name}") for name in compare], F.lit(True).alias("_known")
    )
    equal = F.col("_known")
    for name in compare:
        equal = equal & F.col(name).eqNullSafe(F.col(f"_{name}"))
    joined = receipts.join(renamed, list(keys), "left")
    return joined.withColumn("failure_code", first_failure([(equal, code)])).drop(
        "_known", *[f"_{name}" for name in compare]
    )


def coverage_adjacency(
    releases: DataFrame, transitions: DataFrame, group: Sequence[str], sequence: str = "sequence"
) -> DataFrame:
    """Releases number transitions plus one, and each adjacent pair agrees.

    ``releases``: ``(group, sequence, version, pack_sha256)``. ``transitions``: ``(group,
    sequence, previous_version, current_version, previous_pack_sha256,
    current_pack_sha256)``. Transition n belongs to the place of release n + 1. Every place
    gets its release, the release before it and its transition in one grouping, and each of
    them must be there exactly once; rows without a place belong to none and fail.
    """
    position = F.col(sequence).cast("bigint")
    missing = F.lit(None)
    pack = F.struct(F.col("version"), F.col("pack_sha256"))
    nothing = missing.cast("struct<version:string,pack_sha256:string>")
    own = F.struct(
        position.alias("place"), F.lit(1).alias("own"), F.lit(0).alias("before"), F.lit(0).alias("moved"),
        pack.alias("release"), nothing.alias("earlier"), nothing.alias("old"), nothing.alias("new"),
    )
    ahead = F.struct(
        (position + 1).alias("place"), F.lit(0).alias("own"), F.lit(1).alias("before"), F.lit(0).alias("moved"),
        nothing.alias("release"), pack.alias("earlier"), nothing.alias("old"), nothing.alias("new"),
    )
    pair = lambda side: F.struct(F.col(f"{side}_version").alias("version"), F.col(f"{side}_pack_sha256").alias("pack_sha256"))
    moves = transitions.select(
        *group, (position + 1).alias("place"), F.lit(0).alias("own"), F.lit(0).alias("before"), F.lit(1).alias("moved"),
        nothing.alias("release"), nothing.alias("earlier"), pair("previous").alias("old"), pair("current").alias("new"),
    )
    last = lambda name: F.last(name, ignorenulls=True).alias(name)
    places = (
        releases.select(*group, F.inline(F.array(own, ahead)))
        .unionByName(moves)
        .groupBy(*group, "place")
        .agg(
            *[F.sum(name).alias(name) for name in ("own", "before", "moved")],
            *[last(name) for name in ("release", "earlier", "old", "new")],
        )
    )
    start = (F.col("place") == 1) & (F.col("own") == 1) & (F.col("before") == 0) & (F.col("moved") == 0)
    later = (
        (F.col("own") == 1) & (F.col("before") == 1) & (F.col("moved") == 1)
        & F.col("old").eqNullSafe(F.col("earlier")) & F.col("new").eqNullSafe(F.col("release"))
    )
    after_last = (F.col("own") == 0) & (F.col("before") == 1) & (F.col("moved") == 0)
    first = F.when(F.col("own") > 0, F.col("place"))
    result = places.groupBy(*group).agg(
        F.sum("own").alias("release_count"),
        F.min_by(F.col("release.version"), first).alias("first_release"),
        F.max_by(F.col("release.version"), first).alias("latest_release"),
        F.bool_and(F.col("place").isNotNull() & (start | later | after_last)).alias("_matched"),
        F.count_if(after_last).alias("_ends"),
        F.sum("moved").alias("transition_count"),
    )
    return (
        result.where("release_count > 0")
        .withColumn(
            "failure_code",
            first_failure(
                [
                    (F.col("release_count") == F.col("transition_count") + 1, "COVERAGE_COUNT_MISMATCH"),
                    (F.col("_matched") & (F.col("_ends") == 1), "COVERAGE_RELEASE_MISMATCH"),
                ]
            ),
        )
        .drop("_matched", "_ends")
    )


def endpoint_match(
    endpoints: DataFrame,
    latest: DataFrame,
    keys: Sequence[str],
    head: tuple[str, str],
    counts: Sequence[tuple[str, str]],
    prefix: str = "PACKET_LINEAGE_ENDPOINT",
) -> DataFrame:
    """A current head and its counts against the last entry of a history.

    ``head`` and ``counts`` pair a column of ``endpoints`` with one of ``latest``.
    """
    renamed = latest.select(
        *keys, *[F.col(name).alias(f"_{name}") for _, name in [head, *counts]]
    )
    equal = F.lit(True)
    for name, other in counts:
        equal = equal & holds(F.col(name) == F.col(f"_{other}"))
    code = first_failure(
        [
            (F.col(head[0]) == F.col(f"_{head[1]}"), f"{prefix}_HEAD_MISMATCH"),
            (equal, f"{prefix}_COUNT_MISMATCH"),
        ]
    )
    return endpoints.join(renamed, list(keys), "left").withColumn("failure_code", code).drop(
        *[f"_{name}" for _, name in [head, *counts]]
    )


def latest_entry(entries: DataFrame, chain: Sequence[str], sequence: str = "sequence") -> DataFrame:
    """The last entry of every chain, by a grouped maximum."""
    others = [name for name in entries.columns if name not in chain]
    return (
        entries.groupBy(*chain)
        .agg(F.max_by(F.struct(*others), sequence).alias("_last"))
        .select(*chain, "_last.*")
    )


def expected_head_check(
    artifacts: DataFrame, expected: DataFrame, keys: Sequence[str], head: str = "head_sha256"
) -> DataFrame:
    """Every artifact's head against the head retained elsewhere.

    HEAD_INVALID: the retained head is no digest. HEAD_MISMATCH: stale or rolled back.
    ANCHORS_INVALID: an artifact without a retained head, or a head without artifact.
    """
    retained = expected.select(
        *keys, F.col("expected_sha256"), F.lit(True).alias("_retained")
    )
    code = first_failure(
        [
            (F.col("_retained"), "ANCHORS_INVALID"),
            (is_digest(F.col("expected_sha256")), "HEAD_INVALID"),
            (F.col(head) == F.col("expected_sha256"), "HEAD_MISMATCH"),
        ]
    )
    checked = artifacts.select(*keys, head).join(retained, list(keys), "left").select(
        *keys, head, "expected_sha256", code.alias("failure_code")
    )
    surplus = expected.join(artifacts.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys,
        F.lit(None).cast("string").alias(head),
        "expected_sha256",
        F.lit("ANCHORS_INVALID").alias("failure_code"),
    )
    return checked.unionByName(surplus)


def any_failure(rows: DataFrame, group: Sequence[str], order: Column) -> DataFrame:
    """First failing code per group, in ``order``; a failure without a place still counts."""
    bad = F.when(F.col("failure_code").isNotNull(), order)
    return rows.groupBy(*group).agg(
        F.coalesce(F.min_by("failure_code", bad), F.min("failure_code")).alias("failure_code")
    )
