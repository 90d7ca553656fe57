"""Helpers on arrays, maps and record structs (F20, F21, F23, canonical order)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelock.functions.digests import canonical_digest
from quotelock.functions.ladder import holds

# Header names a retained capture may keep.
RETAINED_HEADERS = (
    "content-type",
    "content-language",
    "content-encoding",
    "etag",
    "last-modified",
    "date",
)
# Fixed value: path token of bytes that travel inside a packet.
PACKET_OBJECT_PATH = "packet:source"
DEFAULT_NAMESPACE = "quotelock"


def header_allowlist(headers: Column) -> Column:
    return F.map_filter(headers, lambda name, _: name.isin(*RETAINED_HEADERS))


def set_delta(before: Column, after: Column) -> tuple[Column, Column]:
    """Numbers of keys added and removed."""
    return F.size(F.array_except(after, before)), F.size(F.array_except(before, after))


def is_canonical_order(names: Column) -> Column:
    """A list is sorted and without repeats."""
    return holds(names == F.array_sort(F.array_distinct(names)))


def content_urn(sha256: Column, namespace: str = DEFAULT_NAMESPACE) -> Column:
    return F.concat(F.lit(f"urn:{namespace}:source:sha256:"), sha256)


def portable_rewrite(snapshot: Column, namespace: str = DEFAULT_NAMESPACE) -> Column:
    """Replace the local path and URI of a snapshot struct by portable ones."""
    return snapshot.withField("object_path", F.lit(PACKET_OBJECT_PATH)).withField(
        "source_uri", content_urn(snapshot["sha256"], namespace)
    )


def object_path(sha256: Column) -> Column:
    """Content-addressed relative path of a digest."""
    return F.concat(
        F.lit("objects/sha256/"), F.substring(sha256, 1, 2), F.lit("/"), F.substring(sha256, 3, 62)
    )


def snapshot_members(snapshot: Column) -> dict:
    """Canonical members of a snapshot struct."""
    return {
        "mediaType": snapshot["media_type"],
        "sha256": snapshot["sha256"],
        "byteLength": snapshot["byte_length"],
        "objectPath": snapshot["object_path"],
        "sourceUri": snapshot["source_uri"],
        "capturedAt": snapshot["captured_at"],
        "availableAt": snapshot["available_at"],
    }


def selector_members(selector: Column) -> dict:
    return {
        "type": F.lit("TextQuoteSelector"),
        "exact": selector["exact"],
        "prefix": selector["prefix"],
        "suffix": selector["suffix"],
    }


def snapshot_reference(snapshot: Column) -> Column:
    """Reference of a snapshot record: one content digest may have many."""
    return F.concat(F.lit("snapshot_"), canonical_digest(snapshot_members(snapshot)))
