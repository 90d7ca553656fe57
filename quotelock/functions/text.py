"""Text search, context and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelock.functions.ladder import at_most, bind, holds

# Fixed value: the whitespace class used for query normalisation. It has the
# ASCII blanks, every Unicode separator and U+FEFF.
WHITESPACE = r"[\s\p{Z}\x{FEFF}]"

SELECTOR_CONTEXT = 32
PREVIEW_CONTEXT = 80
REVIEW_CONTEXT = 280
MAX_MATCHES = 20
ELLIPSIS = "…"


def escaped(query: Column) -> Column:
    """``query`` as a regular expression that matches it alone."""
    return F.regexp_replace(query, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def running_totals(values: Column) -> Column:
    """Running sums of an array of integers.

    Appending to an array copies it, so sums are taken in blocks of about the square root
    of the length, then over the blocks' totals.
    """
    none = F.array().cast("array<bigint>")

    def sums(part: Column) -> Column:
        return F.aggregate(
            part, none, lambda found, x: F.array_append(found, F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0)) + x)
        )

    def of_blocks(blocks: Column) -> Column:
        totals = bind(sums(F.transform(blocks, lambda block: F.element_at(block, -1))), lambda found: found)
        before = F.concat(F.array(F.lit(0).cast("bigint")), totals)
        return bind(
            before,
            lambda start: F.flatten(
                F.transform(blocks, lambda block, i: F.transform(block, lambda x: x + F.get(start, i)))
            ),
        )

    def of_values(found: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(found))).cast("int")
        cuts = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int"))
        return bind(F.transform(cuts, lambda i: sums(F.slice(found, i * size + 1, size))), of_blocks)

    numbers = F.transform(values, lambda x: x.cast("bigint"))
    return F.when(F.size(values) == 0, none).otherwise(bind(numbers, of_values))


def _all_occurrences(text: Column, query: Column) -> Column:
    """Offsets of all matches: the text is cut before each, and a piece starts where the ones before it end."""
    pieces = F.split(text, F.concat(F.lit("(?="), escaped(query), F.lit(")")), -1)

    def starts(sizes: Column) -> Column:
        ends = running_totals(F.slice(sizes, 1, F.size(sizes) - 1))
        later = F.transform(ends, lambda end: (end + 1).cast("int"))
        return F.when(F.startswith(text, query), F.concat(F.array(F.lit(1)), later)).otherwise(later)

    return bind(F.transform(pieces, F.char_length), starts)


def exact_occurrences(text: Column, query: Column, limit: int | None = None) -> Column:
    """1-based offsets of ``query`` in ``text``, overlaps included.

    Without a ``limit`` all are returned. With one, at most ``limit + 1``: the extra one only
    says that there are more (see :func:`bounded_matches`).
    """
    none = F.array().cast("array<int>")
    usable = holds(F.char_length(query) > 0) & text.isNotNull()
    if limit is None:
        return F.when(usable & F.contains(text, query), _all_occurrences(text, query)).otherwise(none)

    def step(found: Column, _: Column) -> Column:
        after = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0))
        offset = F.position(query, text, after + 1)
        finished = (F.size(found) < _ - 1) | (offset == 0)
        return F.when(finished, found).otherwise(F.array_append(found, offset))

    steps = F.sequence(F.lit(1), F.lit(limit + 1))
    return F.when(usable, F.aggregate(steps, none, step)).otherwise(none)


def trim_whitespace(value: Column) -> Column:
    return F.regexp_replace(value, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def whitespace_pattern(query: Column) -> Column:
    """Regular expression for the words of ``query`` with any blanks between them."""
    return F.regexp_replace(escaped(trim_whitespace(query)), f"{WHITESPACE}+", WHITESPACE.replace("\\", "\\\\") + "+")


def collapse_whitespace(value: Column) -> Column:
    return F.regexp_replace(value, f"{WHITESPACE}+", " ")


def ws_occurrences(text: Column, query: Column, limit: int | None = None) -> Column:
    """Source-exact texts that match ``query`` up to whitespace, overlaps included.

    All of them, or with a ``limit`` at most ``limit + 1``. The expression runs only on texts
    that hold the blank-collapsed query.
    """
    lookahead = F.concat(F.lit("(?=("), whitespace_pattern(query), F.lit("))"))
    likely = F.contains(collapse_whitespace(text), collapse_whitespace(trim_whitespace(query)))
    found = F.regexp_extract_all(text, lookahead, F.lit(1))
    return F.when(
        holds(likely & (F.char_length(trim_whitespace(query)) > 0)),
        found if limit is None else F.slice(found, 1, limit + 1),
    ).otherwise(F.array().cast("array<string>"))


def located(text: Column, matches: Column) -> Column:
    """Pair each match text, in order, with its 1-based offset."""
    none = F.array().cast("array<struct<start:int,exact:string>>")

    def step(found: Column, exact: Column) -> Column:
        last = F.coalesce(F.try_element_at(found, F.lit(-1))["start"], F.lit(0))
        start = F.position(exact, text, last + 1)
        return F.array_append(found, F.struct(start.alias("start"), exact.alias("exact")))

    return F.aggregate(matches, none, step)


def bounded_matches(matches: Column, limit: int = MAX_MATCHES) -> tuple[Column, Column]:
    """The first ``limit`` matches and whether there were more."""
    return F.slice(matches, 1, limit), F.size(matches) > limit


def context_before(text: Column, start: Column, size: int) -> Column:
    first = F.greatest(F.lit(1), start - size)
    return F.substring(text, first, start - first)


def context_after(text: Column, start: Column, length: Column, size: int) -> Column:
    return F.substring(text, start + length, F.lit(size))


def media_type_essence(value: Column) -> Column:
    return F.lower(trim_whitespace(F.split_part(value, F.lit(";"), F.lit(1))))


def charset(value: Column) -> Column:
    """Declared charset in lower case, ``utf-8`` when none is declared."""
    named = F.transform(
        F.split(value, ";"),
        lambda part: F.struct(
            F.lower(F.trim(F.split_part(part, F.lit("="), F.lit(1)))).alias("name"),
            F.lower(F.trim(F.replace(F.split_part(part, F.lit("="), F.lit(2)), F.lit('"')))).alias("value"),
        ),
    )
    given = F.filter(named, lambda part: (part["name"] == "charset") & (part["value"] != ""))
    return F.when(value.isNotNull(), F.coalesce(F.get(given, F.lit(0))["value"], F.lit("utf-8")))


def charset_supported(value: Column) -> Column:
    return holds(charset(value).isin("utf-8", "utf8"))


def is_html(media_type: Column) -> Column:
    return holds(media_type_essence(media_type) == "text/html")


def bounded_display(value: Column, limit: int) -> Column:
    return F.when(
        F.char_length(value) > limit,
        F.concat(F.substring(value, 1, limit - 1), F.lit(ELLIPSIS)),
    ).otherwise(value)


def nul_safe(value: Column) -> Column:
    return F.replace(value, F.lit("\u0000"), F.lit("�"))


def redact_paths(message: Column, paths: Column, token: str = "[local file]") -> Column:
    """Replace each listed path, longest first, so a prefix cannot hide a longer one."""
    longest_first = F.array_sort(
        F.filter(paths, lambda path: F.char_length(path) > 0),
        lambda a, b: F.char_length(b) - F.char_length(a),
    )
    return F.aggregate(longest_first, message, lambda text, path: F.replace(text, path, F.lit(token)))


def utf8_truncate(value: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, cut between code points and marked with an ellipsis."""
    room = limit - len(ELLIPSIS.encode())
    content = value.cast("binary")
    # A code point has at most four bytes, so one of four neighbouring cuts is valid.
    cuts = [F.substring(content, 1, room - back) for back in range(4)]
    kept = F.coalesce(*[F.when(F.is_valid_utf8(cut), cut.cast("string")) for cut in cuts])
    return F.when(F.octet_length(value) <= limit, value).otherwise(
        F.concat(kept, F.lit(ELLIPSIS))
    )


def query_valid(query: Column, max_bytes: int | None = None) -> Column:
    """A search query is not blank and within its byte bound."""
    return holds(F.char_length(trim_whitespace(query)) > 0) & at_most(F.octet_length(query), max_bytes)


def limit_valid(limit: Column, maximum: int = 1000) -> Column:
    return holds(limit.between(1, maximum))
