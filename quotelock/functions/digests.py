"""Digests, canonical JSON and identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelock.functions.ladder import bind

# The control characters whose JSON escape carries a hex letter.
# Spark writes the letter in upper case, the canonical form in lower case.
LETTERED_CONTROLS = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")

DIGEST_PATTERN = "^[0-9a-f]{64}$"
COMMIT_PATTERN = "^[0-9a-f]{40}$"


@dataclass(frozen=True)
class Optional:
    """A member left out of the object when ``present`` (or the value) is absent."""

    value: "Column | Mapping"
    present: Column | None = None


Spec = "Column | Mapping | Optional | Sequence"


def sha256_hex(value: Column) -> Column:
    """SHA-256 of bytes, or of the UTF-8 bytes of a string, as lowercase hex."""
    return F.sha2(value, 256)


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(DIGEST_PATTERN), F.lit(False))


def is_commit(value: Column) -> Column:
    return F.coalesce(value.rlike(COMMIT_PATTERN), F.lit(False))


def packed(text: Column) -> Column:
    """Text as bytes, lowercase hex (such as a digest) in half its length; equal only for equal texts."""

    def body(text: Column) -> Column:
        content = F.unhex(text)
        return F.when(F.lower(F.hex(content)) == text, F.concat(F.lit(b"\x01"), content)).otherwise(
            F.concat(F.lit(b"\x00"), text.cast("binary"))
        )

    return bind(text, body)


def unpacked(content: Column) -> Column:
    """The text that :func:`packed` was given."""

    def body(content: Column) -> Column:
        rest = F.substring(content, F.lit(2), F.octet_length(content))
        return F.when(F.substring(content, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))

    return bind(content, body)


def is_text(rows: DataFrame, *names: str) -> bool:
    """Whether the columns hold texts, so that :func:`packed` takes them."""
    types = dict(rows.dtypes)
    return all(types[name] == "string" for name in names)


def _lower_escapes(text: Column) -> Column:
    fixed = text
    for code in LETTERED_CONTROLS:
        fixed = F.regexp_replace(
            fixed, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}"
        )
    return F.when(F.contains(text, F.lit("\\u00")), fixed).otherwise(text)


def _plain(spec: object) -> bool:
    if isinstance(spec, Optional):
        return False
    if isinstance(spec, Mapping):
        return all(_plain(member) for member in spec.values())
    return True


def _sorted_struct(spec: Mapping) -> Column:
    members = []
    for name in sorted(spec):
        member = spec[name]
        column = _sorted_struct(member) if isinstance(member, Mapping) else member
        members.append(column.alias(name))
    return F.struct(*members)


def _encode(spec: object) -> Column:
    if isinstance(spec, Mapping):
        return _encode_object(spec) if not _plain(spec) else _encode_plain(spec)
    listed = F.to_json(F.array(spec), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def _encode_plain(spec: Mapping) -> Column:
    if not spec:
        return F.lit("{}")
    return F.to_json(_sorted_struct(spec), {"ignoreNullFields": "false"})


def _encode_object(spec: Mapping) -> Column:
    members = []
    for name in sorted(spec):
        member = spec[name]
        if isinstance(member, Optional):
            value = _encode(member.value)
            present = member.present
            if present is None:
                present = member.value.isNotNull()
            members.append(F.when(present, F.concat(F.lit(f'"{name}":'), value)))
        else:
            members.append(F.concat(F.lit(f'"{name}":'), _encode(member)))
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def canonical_json(spec: Mapping) -> Column:
    """Key-sorted JSON without spaces. Members are columns or nested mappings.

    NULL columns are written as ``null``; wrap a member in :class:`Optional` to
    leave it out instead. Array and struct columns are written as they are, so
    their struct fields must already be in key order.
    """
    return _lower_escapes(_encode(spec))


def canonical_digest(spec: Mapping) -> Column:
    """SHA-256 of :func:`canonical_json`."""
    return F.sha2(canonical_json(spec), 256)


def canonical_split(spec: Mapping, link: str) -> tuple[Column, Column]:
    """Canonical text before and after the value of member ``link``.

    ``before || json(link value) || after`` equals :func:`canonical_json` of the
    object with ``link`` added.
    """
    ahead = {name: spec[name] for name in spec if name < link}
    behind = {name: spec[name] for name in spec if name > link}
    if ahead:
        text = canonical_json(ahead)
        before = F.concat(F.substring(text, F.lit(1), F.char_length(text) - 1), F.lit(f',"{link}":'))
    else:
        before = F.lit('{"' + link + '":')
    if behind:
        text = canonical_json(behind)
        after = F.concat(F.lit(","), F.substring(text, F.lit(2), F.char_length(text)))
    else:
        after = F.lit("}")
    return before, after


def deterministic_id(prefix: str, parts: Sequence[Column], length: int | None = None) -> Column:
    """``prefix`` plus the digest of the JSON list of ``parts`` (first ``length`` hex)."""
    digest = F.sha2(_lower_escapes(F.to_json(F.array(*parts))), 256)
    return F.concat(F.lit(prefix), digest if length is None else F.left(digest, F.lit(length)))


def short_id(prefix: str, text: Column, length: int = 24) -> Column:
    """``prefix`` plus the first ``length`` hex digits of the digest of ``text``."""
    return F.concat(F.lit(prefix), F.left(F.sha2(text, 256), F.lit(length)))


def to_base64(content: Column) -> Column:
    """Base64 on one line (Spark breaks lines every 76 characters)."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def base64_canonical(text: Column, byte_length: Column, sha256: Column) -> Column:
    """True when ``text`` is canonical base64 of content with that size and digest."""
    content = F.try_to_binary(text, F.lit("base64"))
    return F.coalesce(
        (to_base64(content) == text)
        & (F.octet_length(content) == byte_length)
        & (F.sha2(content, 256) == sha256),
        F.lit(False),
    )


def fingerprint(value: Column) -> Column:
    """Hex in groups of four."""
    return F.regexp_replace(value, "(.{4})(?=.)", "$1 ")
