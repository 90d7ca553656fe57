"""Resolving quotes: by named source, as a preview, and across the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.functions.digests import deterministic_id
from quotelock.functions.ladder import at_most, first_failure, holds
from quotelock.functions.text import (
    MAX_MATCHES,
    PREVIEW_CONTEXT,
    SELECTOR_CONTEXT,
    WHITESPACE,
    charset_supported,
    context_after,
    context_before,
    exact_occurrences,
    is_html,
    located,
    query_valid,
    ws_occurrences,
)
from quotelock.plans.checkpoints import cut_lineage
from quotelock.sources.snapshots import snapshot_facts



def intact_captures(
    captures: DataFrame, snapshots: DataFrame, views: DataFrame | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Captures with the text they are cited from, read only from intact bytes.

    ``captures`` has ``(capture_id, snapshot_ref, sha256, byte_length, media_type)``,
    ``snapshots`` ``(snapshot_ref, content)`` and ``views`` what ``html_text_views`` gives.
    Adds ``text``, NULL where ``capture_failure`` has a code: bytes missing, too large, of
    another size or digest, a charset other than UTF-8, or HTML without a text.
    """
    html = is_html(F.col("media_type"))
    joined = captures.join(snapshot_facts(snapshots, max_bytes), "snapshot_ref", "left")
    if views is None:
        joined = joined.withColumns({name: F.lit(None).cast("string") for name in ("view_text", "view_failure")})
    else:
        wanted = F.when(html, F.col("sha256"))
        rendered = views.select(F.col("source_sha256").alias("_view"), "view_text", "view_failure")
        joined = joined.join(rendered, wanted == F.col("_view"), "left").drop("_view")
    code = first_failure(
        [
            (F.col("actual_length").isNotNull(), "SNAPSHOT_MISSING"),
            (at_most(F.col("actual_length"), max_bytes), "SNAPSHOT_TOO_LARGE"),
            (F.col("actual_length") == F.col("byte_length"), "SNAPSHOT_SIZE_MISMATCH"),
            (F.col("actual_sha256") == F.col("sha256"), "SNAPSHOT_HASH_MISMATCH"),
            (charset_supported(F.col("media_type")) & F.col("text").isNotNull(), "CITATION_VIEW_INVALID"),
            (~html | F.col("view_text").isNotNull(), F.coalesce(F.col("view_failure"), F.lit("HTML_PARSE_FAILED"))),
        ]
    )
    read = F.when(html, F.col("view_text")).otherwise(F.col("text"))
    return (
        joined.withColumn("capture_failure", code)
        .withColumn("text", F.when(F.col("capture_failure").isNull(), read))
        .drop("actual_length", "actual_sha256", "view_text", "view_failure")
    )


def _unread(captures: DataFrame) -> Column:
    """Code of a capture without text."""
    absent = F.lit("WEB_CAPTURE_NOT_PERSISTED")
    return F.coalesce(F.col("capture_failure"), absent) if "capture_failure" in captures.columns else absent


def cite_by_source(quotes: DataFrame, captures: DataFrame) -> DataFrame:
    """Turn ``(capture_id, exact)`` into candidates on the capture's text.

    ``captures`` has ``(capture_id, text, …)``, as from :func:`intact_captures`. A quote
    that occurs once gets its context and a deterministic id; the others keep their row
    with a code.
    """
    text, exact = F.col("text"), F.col("exact")
    joined = quotes.join(captures, "capture_id", "left").withColumn("_start", F.position(exact, text))
    start = F.col("_start")
    code = first_failure(
        [
            (F.char_length(exact) > 0, "SELECTOR_NOT_FOUND"),
            (text.isNotNull(), _unread(captures)),
            (start > 0, "SELECTOR_NOT_FOUND"),
            (F.position(exact, text, start + 1) == 0, "SELECTOR_AMBIGUOUS"),
        ]
    )
    cited = joined.withColumn("failure_code", code)
    unique = F.col("failure_code").isNull()
    return cited.withColumns(
        {
            "candidate_id": F.when(
                unique, deterministic_id("candidate_web_", [F.col("capture_id").cast("string"), exact])
            ),
            "prefix": F.when(unique, context_before(text, start, SELECTOR_CONTEXT)),
            "suffix": F.when(
                unique, context_after(text, start, F.char_length(exact), SELECTOR_CONTEXT)
            ),
        }
    ).drop("_start", "text")


def citation_preview(
    queries: DataFrame,
    captures: DataFrame,
    limit: int = MAX_MATCHES,
    max_query_bytes: int | None = None,
    max_match_bytes: int | None = None,
) -> DataFrame:
    """Find ``(capture_id, query)`` in the capture's text, exactly or up to whitespace.

    Adds ``match_mode``, ``matches`` (at most ``limit``, each with its context),
    ``truncated`` and ``failure_code``. The whitespace search runs only where the exact
    one finds nothing.
    """
    text, query = F.col("text"), F.col("query")
    read = [name for name in ("capture_id", "text", "capture_failure") if name in captures.columns]
    joined = queries.join(captures.select(*read), "capture_id", "left")
    usable = query_valid(query, max_query_bytes) & text.isNotNull()
    no_texts = F.array().cast("array<string>")
    offsets = F.when(usable, exact_occurrences(text, query, limit)).otherwise(
        F.array().cast("array<int>")
    )
    staged = joined.withColumn("_offsets", offsets)
    found_exact = F.size("_offsets") > 0
    staged = staged.withColumn(
        "_blank",
        F.when(usable & ~found_exact, ws_occurrences(text, query, limit)).otherwise(no_texts),
    )
    hits = F.when(
        found_exact,
        F.transform("_offsets", lambda start: F.struct(start.alias("start"), query.alias("exact"))),
    ).otherwise(located(text, F.col("_blank")))
    staged = staged.withColumn("_hits", hits)
    matches = F.transform(
        F.slice("_hits", 1, limit),
        lambda hit: F.struct(
            hit["start"].alias("start"),
            hit["exact"].alias("exact"),
            context_before(text, hit["start"], PREVIEW_CONTEXT).alias("prefix"),
            context_after(text, hit["start"], F.char_length(hit["exact"]), PREVIEW_CONTEXT).alias(
                "suffix"
            ),
        ),
    )
    oversized = F.lit(False)
    if max_match_bytes is not None:
        oversized = F.exists(
            F.slice("_hits", 1, limit), lambda hit: F.octet_length(hit["exact"]) > max_match_bytes
        )
    code = first_failure(
        [
            (query_valid(query, max_query_bytes), "CITATION_QUERY_INVALID"),
            (text.isNotNull(), _unread(captures)),
            (~oversized, "CITATION_PREVIEW_MATCH_TOO_LARGE"),
        ]
    )
    staged = staged.withColumn("failure_code", code)
    valid = F.col("failure_code").isNull()
    return staged.withColumns(
        {
            "match_mode": F.when(
                valid,
                F.when(found_exact, "exact")
                .when(F.size("_hits") > 0, "normalized-whitespace")
                .otherwise("none"),
            ),
            "matches": F.when(valid, matches),
            "truncated": F.when(valid, F.size("_hits") > limit),
        }
    ).drop("_offsets", "_blank", "_hits", "text")


def preview_rows(previews: DataFrame) -> DataFrame:
    """One row per match of :func:`citation_preview`, numbered from 1."""
    return previews.select(
        "*", F.posexplode("matches").alias("position", "match")
    ).withColumn("position", F.col("position") + 1).drop("matches")


def unique_citation(previews: DataFrame) -> DataFrame:
    """The one match of each preview, or why there is no single one."""
    count = F.size("matches")
    code = F.when(
        F.col("failure_code").isNotNull(), F.col("failure_code")
    ).otherwise(
        first_failure(
            [
                (count > 0, "SELECTOR_NOT_FOUND"),
                ((count == 1) & ~F.col("truncated"), "SELECTOR_AMBIGUOUS"),
            ]
        )
    )
    return (
        previews.withColumn("failure_code", code)
        .withColumn(
            "exact", F.when(F.col("failure_code").isNull(), F.get("matches", F.lit(0))["exact"])
        )
        .drop("matches", "truncated", "match_mode")
    )


_OTHER = WHITESPACE.replace("[", "[^", 1)


def _inner_text(quote: Column) -> Column:
    """The part of a quote whose words are whole words of any text that contains it."""
    return F.regexp_extract(quote, f"(?s)^{_OTHER}*{WHITESPACE}+(.*?){WHITESPACE}+{_OTHER}*$", 1)


def _words(text: Column) -> Column:
    return F.split(text, f"{WHITESPACE}+")


def _pieces(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def quote_locate(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """Which documents contain each quote.

    ``quotes`` has ``(quote_id, exact)``, ``documents`` has ``(doc_id, text)``. No pair
    is compared unless the document holds the rarest fragment of the quote:

    1. every quote is cut into fragments that any containing text must share: its inner
       words, or substrings of one to three characters when it has no whole word;
    2. fragments are counted over the corpus (combined before the shuffle) and each
       quote keeps its rarest one, so a word found in a third of all documents is
       never a join key while the quote has a rarer one;
    3. documents meet quotes by equi join on that fragment, and ``position`` decides.

    The fragments shared with quotes are written to the checkpoint folder, so the corpus is
    cut into fragments once and read a second time for ``position`` only. Results are
    exact: ``(quote_id, doc_id, start, repeated)``.
    """
    exact, text = F.col("exact"), F.col("text")
    sizes = (1, 2, 3)
    cut = quotes.select("quote_id", "exact", _inner_text(exact).alias("_inner"))
    worded = F.col("_inner") != ""
    kind, parts = F.when(worded, "w"), F.when(worded, _words(F.col("_inner")))
    pieces = F.when(F.col("kind") == "w", _words(text))
    for size in sizes:
        fits = F.least(F.lit(3), F.char_length(exact)) == size
        kind, parts = kind.when(fits, f"{size}"), parts.when(fits, _pieces(exact, size))
        pieces = pieces.when(F.col("kind") == f"{size}", _pieces(text, size))
    quote_parts = (
        cut.select("quote_id", kind.alias("kind"), F.explode(parts).alias("part"))
        .select("quote_id", "kind", F.xxhash64("part").alias("hash"))
        .distinct()
    )
    wanted = quote_parts.select("kind", "hash").distinct()
    # At most four constant values: the kinds that the quotes use. Fragments of other
    # kinds are never computed.
    kinds = F.broadcast(quote_parts.select("kind").distinct())
    names = F.array(*map(F.lit, ("w", *map(str, sizes))))
    document_parts = cut_lineage(
        documents.select("doc_id", "text", F.explode(names).alias("kind"))
        .join(kinds, "kind", "left_semi")
        .select("doc_id", "kind", F.explode(pieces).alias("part"))
        .select("doc_id", "kind", F.xxhash64("part").alias("hash"))
        .join(wanted, ["kind", "hash"], "left_semi")
        .distinct()
    )
    spread = document_parts.groupBy("kind", "hash").agg(F.count("*").alias("documents"))
    anchors = (
        quote_parts.join(spread, ["kind", "hash"], "left")
        .groupBy("quote_id")
        .agg(
            F.min_by(
                F.struct("kind", "hash"), F.struct(F.coalesce("documents", F.lit(0)), "kind", "hash")
            ).alias("anchor")
        )
        .select("quote_id", "anchor.kind", "anchor.hash")
    )
    pairs = document_parts.join(anchors, ["kind", "hash"]).select("quote_id", "doc_id")
    return (
        pairs.join(quotes.select("quote_id", "exact"), "quote_id")
        .join(documents.select("doc_id", "text"), "doc_id")
        .withColumn("start", F.position(F.col("exact"), F.col("text")))
        .where(F.col("start") > 0)
        .select(
            "quote_id",
            "doc_id",
            "start",
            (F.position(F.col("exact"), F.col("text"), F.col("start") + 1) > 0).alias("repeated"),
        )
    )


def corpus_unique(matches: DataFrame) -> DataFrame:
    """Per located quote: documents that hold it, and whether it occurs only once."""
    return matches.groupBy("quote_id").agg(
        F.count("*").alias("document_count"),
        ((F.count("*") == 1) & ~F.max("repeated")).alias("corpus_unique"),
    )


def record_equality(supplied: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """A supplied record must equal the stored one: NOT_PERSISTED / RECORD_MISMATCH."""
    kept = stored.select(key, F.col(digest).alias("_stored"), F.lit(True).alias("_known"))
    code = first_failure(
        [
            (F.col("_known"), "WEB_CAPTURE_NOT_PERSISTED"),
            (holds(F.col("_stored") == F.col(digest)), "WEB_CAPTURE_RECORD_MISMATCH"),
        ]
    )
    return supplied.join(kept, key, "left").withColumn("failure_code", code).drop("_stored", "_known")
