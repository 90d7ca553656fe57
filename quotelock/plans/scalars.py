"""Queries for the scalar helpers (F01-F23), over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.functions import digests, instants, records, semver, text, urls
from quotelock.operators.html_view import citation_text as attach_text
from quotelock.operators.html_view import html_text_views
from quotelock.plans.registry import query, table
from quotelock.plans.views import (
    PAGE_VIEWS_SQL,
    SNAPSHOTS_SQL,
    iso,
    iso_sql,
    page_sources,
    snapshots,
    version_of,
    version_sql,
)

c = F.col


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_hex(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", digests.sha256_hex(c("text")).alias("digest"))


@query(
    """SELECT doc_id, sha256('{"docId":' || doc_id || ',"lang":' || to_json(lang) || ',"meta":{"chars":' || n_chars
         || ',"missing":null,"source":' || to_json(source) || '},"text":' || to_json(text) || '}') AS digest
       FROM documents"""
)
def canonical_digest(spark: SparkSession, folder: str) -> DataFrame:
    members = {
        "text": c("text"),
        "lang": c("lang"),
        "docId": c("doc_id"),
        "meta": {"source": c("source"), "missing": F.lit(None).cast("string"), "chars": c("n_chars")},
    }
    return _documents(spark, folder).select("doc_id", digests.canonical_digest(members).alias("digest"))


def _stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Instant texts of every valid and invalid form, by ``event_id % 8``."""
    base = iso(c("event_id") * 37)
    head = F.substring(base, 1, 19)
    fraction = F.lpad(F.pmod(c("event_id") * 7919, F.lit(1000000000)).cast("string"), 9, "0")
    form = F.pmod("event_id", F.lit(8))
    stamp = (
        F.when(form == 0, base)
        .when(form == 1, F.concat(head, F.lit("."), fraction, F.lit("Z")))
        .when(form == 2, F.concat(head, F.lit("+05:30")))
        .when(form == 3, F.concat(head, F.lit("."), F.substring(fraction, 1, 2), F.lit("-00:45")))
        .when(form == 4, F.substring(base, 1, 10))
        .when(form == 5, F.concat(F.lit("2026-02-30"), F.substring(base, 11, 20)))
        .when(form == 6, F.concat(F.substring(base, 1, 17), F.lit("60Z")))
        .otherwise(F.concat(head, F.lit("+24:00")))
    )
    return table(spark, folder, "events").select("event_id", stamp.alias("stamp"))


_STAMPS_SQL = f"""stamps AS (
  SELECT event_id, event_id % 8 AS form, {iso_sql('event_id * 37')} AS base,
         lpad(CAST((event_id * 7919) % 1000000000 AS VARCHAR), 9, '0') AS fraction FROM events)"""


@query(
    f"""WITH {_STAMPS_SQL}
    SELECT event_id, CASE
        WHEN form IN (0, 1, 2, 3) THEN CAST(CAST(epoch(CAST(substr(base, 1, 19) AS TIMESTAMP)) AS HUGEINT) * 1000000000
          + CASE form WHEN 1 THEN CAST(fraction AS HUGEINT) WHEN 2 THEN -19800 * CAST(1000000000 AS HUGEINT)
                 WHEN 3 THEN 2700 * CAST(1000000000 AS HUGEINT) + CAST(substr(fraction, 1, 2) AS HUGEINT) * 10000000
                 ELSE 0 END AS VARCHAR) END AS instant_ns,
      CASE WHEN form = 4 THEN CAST(CAST(epoch(CAST(substr(base, 1, 10) AS TIMESTAMP)) AS HUGEINT) * 1000000000
           AS VARCHAR) END AS date_ns
    FROM stamps"""
)
def instant_ns(spark: SparkSession, folder: str) -> DataFrame:
    stamp = c("stamp")
    return _stamps(spark, folder).select(
        "event_id",
        instants.instant_ns(stamp).cast("string").alias("instant_ns"),
        F.when(
            F.char_length(stamp) == 10, instants.instant_ns(stamp, allow_date_only=True).cast("string")
        ).alias("date_ns"),
    )


@query(f"WITH {_STAMPS_SQL} SELECT event_id, form = 0 AS canonical FROM stamps")
def is_canonical_instant(spark: SparkSession, folder: str) -> DataFrame:
    return _stamps(spark, folder).select(
        "event_id", instants.is_canonical_instant(c("stamp")).alias("canonical")
    )


_OCCURRENCES_SQL = """found AS (
  SELECT doc_id, list_filter(range(1, len(chars) + 1),
      lambda i: starts_with(chars[i] || coalesce(chars[i + 1], ''), query)) AS hits
  FROM (SELECT doc_id, string_split(text, '') AS chars,
      CASE WHEN length(text) < 80 THEN substr(text, 1, 2) ELSE substr(text, 10, 2) END AS query FROM documents))"""


def _quote() -> Column:
    """Sixty characters of a text, or all of a short one."""
    return F.when(F.char_length("text") < 80, c("text")).otherwise(F.substring("text", 10, 60))


def _with_hits(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    return _documents(spark, folder).select(
        "doc_id", text.exact_occurrences(c("text"), F.substring(_quote(), 1, 2), limit).alias("hits")
    )


@query(
    f"""WITH {_OCCURRENCES_SQL}
    SELECT doc_id, CAST(len(hits) AS BIGINT) AS found, array_to_string(hits, ',') AS offsets
    FROM found"""
)
def exact_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return _with_hits(spark, folder).select(
        "doc_id",
        F.size("hits").cast("bigint").alias("found"),
        F.array_join("hits", ",").alias("offsets"),
    )


@query(
    f"""WITH {_OCCURRENCES_SQL}
    SELECT doc_id, array_to_string(hits[1:20], ',') AS offsets, len(hits) > 20 AS truncated FROM found"""
)
def bounded_matches(spark: SparkSession, folder: str) -> DataFrame:
    kept, truncated = text.bounded_matches(c("hits"))
    return _with_hits(spark, folder, text.MAX_MATCHES).select(
        "doc_id", F.array_join(kept, ",").alias("offsets"), truncated.alias("truncated")
    )


@query(
    r"""WITH queries AS (
      SELECT doc_id, text, regexp_replace(text, '\s+', ' ', 'g') AS flat,
        trim(regexp_replace(quote, '\s+', ' ', 'g')) AS flat_query,
        array_to_string(list_transform(
          string_split_regex(regexp_replace(quote, '^\s+|\s+$', '', 'g'), '\s+'),
          lambda w: regexp_escape(w)), '\s+') AS pattern
      FROM (SELECT *, CASE WHEN length(text) < 80 THEN text ELSE substr(text, 10, 60) END AS quote FROM documents)),
    starts AS (
      SELECT doc_id, text, flat, flat_query, pattern, list_filter(range(1, len(chars) + 1),
        lambda i: starts_with(chars[i] || coalesce(chars[i + 1], ''), substr(flat_query, 1, 2))) AS likely
      FROM (SELECT *, string_split(flat, '') AS chars FROM queries))
    SELECT doc_id, CAST(len(list_filter(likely,
        lambda i: substr(flat, i, length(flat_query)) = flat_query)) AS BIGINT) AS found,
      nullif(regexp_extract(text, pattern), '') AS first_match FROM starts"""
)
def ws_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Queries are quotes with every blank run widened to three blanks."""
    widened = F.regexp_replace(_quote(), r"\s+", "   ")
    found = text.ws_occurrences(c("text"), widened)
    return (
        _documents(spark, folder)
        .select("doc_id", found.alias("found"))
        .select(
            "doc_id",
            F.size("found").cast("bigint").alias("found"),
            F.get("found", F.lit(0)).alias("first_match"),
        )
    )


@query(
    """SELECT doc_id, substr(text, greatest(1, 101 - 32), 100 - greatest(1, 101 - 32) + 1) AS before_32,
         substr(text, greatest(1, 101 - 280), 100 - greatest(1, 101 - 280) + 1) AS before_280,
         substr(text, 111, 32) AS after_32, substr(text, 111, 80) AS after_80, substr(text, 111, 280) AS after_280
       FROM documents"""
)
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    body, start, size = c("text"), F.lit(101), F.lit(10)
    return _documents(spark, folder).select(
        "doc_id",
        text.context_before(body, start, 32).alias("before_32"),
        text.context_before(body, start, 280).alias("before_280"),
        text.context_after(body, start, size, 32).alias("after_32"),
        text.context_after(body, start, size, 80).alias("after_80"),
        text.context_after(body, start, size, 280).alias("after_280"),
    )


@query(
    f"""WITH {PAGE_VIEWS_SQL} SELECT page_id, view_text, view_sha256, view_byte_length FROM page_views"""
)
def html_text_view(spark: SparkSession, folder: str) -> DataFrame:
    pages = page_sources(spark, folder)
    views = html_text_views(pages.select("snapshot_ref", "sha256", "content"))
    return pages.join(views, c("sha256") == c("source_sha256")).select(
        "page_id", "view_text", "view_sha256", "view_byte_length"
    )


@query(
    f"""WITH {PAGE_VIEWS_SQL}
    SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'CITATION_VIEW_HASH_MISMATCH' WHEN 2 THEN 'CITATION_VIEW_INVALID'
        WHEN 4 THEN 'CITATION_VIEW_INVALID' END AS text_failure,
      CASE page_id % 5 WHEN 0 THEN view_sha256 WHEN 3 THEN source_sha256 END AS text_sha256
    FROM page_views"""
)
def citation_text(spark: SparkSession, folder: str) -> DataFrame:
    """By ``page_id % 5``: 0 bound view, 1 other digest, 2 no view, 3 plain, 4 plain with view."""
    pages = page_sources(spark, folder)
    views = html_text_views(pages.select("snapshot_ref", "sha256", "content"))
    kind = F.pmod("page_id", F.lit(5))
    bound = pages.join(views.select("source_sha256", "view_sha256", "view_byte_length"), c("sha256") == c("source_sha256"))
    view = F.struct(
        c("source_sha256"),
        F.when(kind == 1, c("sha256")).otherwise(c("view_sha256")).alias("sha256"),
        c("view_byte_length").alias("byte_length"),
    )
    citations = bound.select(
        "page_id",
        "snapshot_ref",
        "sha256",
        F.when(kind >= 3, "text/plain").otherwise("Text/HTML; charset=utf-8").alias("media_type"),
        F.when(~kind.isin(2, 3), view).alias("citation_view"),
    )
    plain = pages.select("snapshot_ref", c("content").alias("text"))
    return attach_text(citations, plain, views).select(
        "page_id", "text_failure", F.sha2("citation_text", 256).alias("text_sha256")
    )


_MEDIA_FORMS = (
    "text/html; charset=utf-8",
    ' Text/HTML ;Charset="UTF8"',
    "application/json",
    "text/plain;charset=iso-8859-1",
)


@query(
    """SELECT page_id, ['text/html', 'text/html', 'application/json', 'text/plain'][page_id % 4 + 1] AS essence,
         ['utf-8', 'utf8', 'utf-8', 'iso-8859-1'][page_id % 4 + 1] AS charset, page_id % 4 <> 3 AS supported
       FROM pages"""
)
def media_type(spark: SparkSession, folder: str) -> DataFrame:
    form = F.pmod("page_id", F.lit(4))
    declared = F.when(form == 0, _MEDIA_FORMS[0])
    for number in (1, 2, 3):
        declared = declared.when(form == number, _MEDIA_FORMS[number])
    return table(spark, folder, "pages").select(
        "page_id",
        text.media_type_essence(declared).alias("essence"),
        text.charset(declared).alias("charset"),
        text.charset_supported(declared).alias("supported"),
    )


_VERSION_PAIRS_SQL = f"""pairs AS (
  SELECT o_orderkey, o_orderkey AS a, (o_orderkey * 7 + 3) % 5000 AS b FROM orders), versions AS (
  SELECT o_orderkey, {version_sql('a')} AS left_version, {version_sql('b')} AS right_version,
    [a // 1000, (a // 10) % 100, a % 10, CASE WHEN a % 3 = 0 THEN 0 ELSE 1 END,
     CASE WHEN a % 3 = 0 THEN a % 12 ELSE 0 END] AS left_key,
    [b // 1000, (b // 10) % 100, b % 10, CASE WHEN b % 3 = 0 THEN 0 ELSE 1 END,
     CASE WHEN b % 3 = 0 THEN b % 12 ELSE 0 END] AS right_key FROM pairs)"""


def _version_pairs(spark: SparkSession, folder: str) -> DataFrame:
    other = F.pmod(c("o_orderkey") * 7 + 3, F.lit(5000))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        version_of(c("o_orderkey")).alias("left_version"),
        version_of(other).alias("right_version"),
    )


@query(
    f"""WITH {_VERSION_PAIRS_SQL}
    SELECT o_orderkey, left_version, right_version, CAST(CASE WHEN left_key < right_key THEN -1
      WHEN left_key > right_key THEN 1 ELSE 0 END AS BIGINT) AS ordering FROM versions"""
)
def semver_key(spark: SparkSession, folder: str) -> DataFrame:
    left, right = semver.semver_key(c("left_version")), semver.semver_key(c("right_version"))
    return (
        _version_pairs(spark, folder)
        .withColumns({"_left": left, "_right": right})
        .select(
            "o_orderkey",
            "left_version",
            "right_version",
            F.when(c("_left") < c("_right"), -1)
            .when(c("_left") > c("_right"), 1)
            .when(c("_left") == c("_right"), 0)
            .cast("bigint")
            .alias("ordering"),
        )
    )


@query(
    f"""WITH {_VERSION_PAIRS_SQL}
    SELECT o_orderkey, CASE WHEN left_key[1] <> right_key[1] THEN 'major'
      WHEN left_key[2] <> right_key[2] THEN 'minor' ELSE 'patch' END AS bump FROM versions"""
)
def semver_bump(spark: SparkSession, folder: str) -> DataFrame:
    return _version_pairs(spark, folder).select(
        "o_orderkey", semver.semver_bump(c("left_version"), c("right_version")).alias("bump")
    )


@query(
    """SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 239) || '…' ELSE text END AS shown
       FROM documents"""
)
def bounded_display(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", text.bounded_display(c("text"), 240).alias("shown"))


_SOURCES_SQL = """sources AS (
  SELECT page_id, url, CASE page_id % 5 WHEN 1 THEN replace(url, '://', '://user:pw@')
         WHEN 2 THEN regexp_replace(url, '^(https?)://([^/]+)', '\\1://\\2:8080')
         WHEN 3 THEN 'file:///tmp/' || page_id WHEN 4 THEN 'page ' || page_id ELSE url END AS source FROM pages)"""


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    form = F.pmod("page_id", F.lit(5))
    url = c("url")
    number = c("page_id").cast("string")
    source = (
        F.when(form == 1, F.replace(url, F.lit("://"), F.lit("://user:pw@")))
        .when(form == 2, F.regexp_replace(url, "^(https?)://([^/]+)", "$1://$2:8080"))
        .when(form == 3, F.concat(F.lit("file:///tmp/"), number))
        .when(form == 4, F.concat(F.lit("page "), number))
        .otherwise(url)
    )
    return table(spark, folder, "pages").select("page_id", source.alias("source"))


@query(
    f"""WITH {_SOURCES_SQL}
    SELECT page_id, CASE WHEN page_id % 5 = 3 THEN 'local snapshot' WHEN page_id % 5 = 4 THEN 'stored snapshot'
        ELSE regexp_replace(regexp_replace(source, '://[^/]*@', '://'), '[?#].*$', '') END AS shown,
      CASE WHEN page_id % 5 IN (3, 4) THEN 'local' ELSE 'web' END AS source_kind FROM sources"""
)
def display_source(spark: SparkSession, folder: str) -> DataFrame:
    return _sources(spark, folder).select(
        "page_id",
        urls.display_source(c("source")).alias("shown"),
        urls.source_kind(c("source")).alias("source_kind"),
    )


@query(
    """SELECT doc_id, sha256(substr(text, 1, 20) || '�' || substr(text, 21) || '�') AS safe_sha256,
         CAST(length(text) + 2 AS BIGINT) AS chars FROM documents"""
)
def nul_safe(spark: SparkSession, folder: str) -> DataFrame:
    nul = F.lit("\u0000")
    raw = F.concat(F.substring("text", 1, 20), nul, F.substring("text", F.lit(21), F.char_length("text")), nul)
    return _documents(spark, folder).select(
        "doc_id",
        F.sha2(text.nul_safe(raw), 256).alias("safe_sha256"),
        F.char_length(text.nul_safe(raw)).cast("bigint").alias("chars"),
    )


@query(
    """SELECT doc_id, 'candidate_web_' || sha256('["doc:' || doc_id || '",' || to_json(text) || ']') AS long_id,
         'evt_' || substr(sha256('promotion:' || doc_id), 1, 24) AS short_id FROM documents"""
)
def deterministic_id(spark: SparkSession, folder: str) -> DataFrame:
    reference = F.concat(F.lit("doc:"), c("doc_id").cast("string"))
    return _documents(spark, folder).select(
        "doc_id",
        digests.deterministic_id("candidate_web_", [reference, c("text")]).alias("long_id"),
        digests.short_id("evt_", F.concat(F.lit("promotion:"), c("doc_id").cast("string"))).alias("short_id"),
    )


@query("SELECT doc_id, doc_id % 4 = 0 AS canonical FROM documents")
def base64_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """By ``doc_id % 4``: 0 canonical, 1 a line break inside, 2 other size, 3 last digit gone."""
    form = F.pmod("doc_id", F.lit(4))
    encoded = digests.to_base64(c("text").cast("binary"))
    given = (
        F.when(form == 1, F.concat(F.substring(encoded, 1, 4), F.lit("\n"), F.substring(encoded, F.lit(5), F.char_length(encoded))))
        .when(form == 3, F.substring(encoded, F.lit(1), F.char_length(encoded) - 1))
        .otherwise(encoded)
    )
    size = F.octet_length("text") + F.when(form == 2, 1).otherwise(0)
    return (
        _documents(spark, folder)
        .select("doc_id", given.alias("given"), size.alias("size"), F.sha2("text", 256).alias("sha"))
        .select("doc_id", digests.base64_canonical(c("given"), c("size"), c("sha")).alias("canonical"))
    )


@query(
    """SELECT doc_id, replace(replace('cannot read /data/' || doc_id || '/page.html near /data/' || doc_id || ': ' ||
         text, '/data/' || doc_id || '/page.html', '[local file]'), '/data/' || doc_id, '[local file]')
         AS message FROM documents"""
)
def redact_paths(spark: SparkSession, folder: str) -> DataFrame:
    root = F.concat(F.lit("/data/"), c("doc_id").cast("string"))
    page = F.concat(root, F.lit("/page.html"))
    message = F.concat(F.lit("cannot read "), page, F.lit(" near "), root, F.lit(": "), c("text"))
    return _documents(spark, folder).select(
        "doc_id", text.redact_paths(message, F.array(root, page, F.lit(""))).alias("message")
    )


@query(
    """SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE substr(text, 1,
         list_max(list_filter(range(0, 98), lambda k: strlen(substr(text, 1, k)) <= 97))) || '…' END AS shown
       FROM documents"""
)
def utf8_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", text.utf8_truncate(c("text"), 100).alias("shown"))


@query(
    f"""WITH {SNAPSHOTS_SQL}
    SELECT doc_id, 'packet:source' AS object_path, 'urn:quotelock:source:sha256:' || sha256 AS source_uri,
      captured_at FROM snapshots"""
)
def portable_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshots(spark, folder)
    snapshot = F.struct("sha256", "object_path", "source_uri", "captured_at")
    return rows.select("doc_id", records.portable_rewrite(snapshot).alias("s")).select(
        "doc_id", "s.object_path", "s.source_uri", "s.captured_at"
    )


@query(
    """SELECT page_id, 'content-type,etag' || CASE WHEN page_id % 2 = 0 THEN ',date' ELSE '' END AS kept
       FROM pages"""
)
def header_allowlist(spark: SparkSession, folder: str) -> DataFrame:
    optional = F.when(F.pmod("page_id", F.lit(2)) == 0, F.lit("date")).otherwise(F.lit("server"))
    headers = F.map_from_arrays(
        F.array(F.lit("content-type"), F.lit("set-cookie"), F.lit("etag"), optional),
        F.array(F.lit("text/html"), F.lit("secret"), c("url"), F.lit("x")),
    )
    return table(spark, folder, "pages").select(
        "page_id", F.array_join(F.map_keys(records.header_allowlist(headers)), ",").alias("kept")
    )


@query(
    r"""SELECT doc_id, rtrim(regexp_replace(sha256(text), '(.{4})', '\1 ', 'g')) AS fingerprint FROM documents"""
)
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select(
        "doc_id", digests.fingerprint(F.sha2("text", 256)).alias("fingerprint")
    )


@query(
    """WITH words AS (
      SELECT doc_id, 1 AS side, unnest(string_split(text, ' ')) AS word FROM documents UNION ALL
      SELECT doc_id, 2, unnest(string_split(substr(text, 51), ' ')) FROM documents),
    sides AS (SELECT doc_id, word, min(side) AS low, max(side) AS high FROM words GROUP BY 1, 2)
    SELECT doc_id, count(*) FILTER (low = 2) AS added, count(*) FILTER (high = 1) AS removed FROM sides GROUP BY 1"""
)
def set_delta(spark: SparkSession, folder: str) -> DataFrame:
    before, after = (F.split(F.substring("text", F.lit(start), F.char_length("text")), " ") for start in (1, 51))
    added, removed = records.set_delta(before, after)
    return _documents(spark, folder).select(
        "doc_id", added.cast("bigint").alias("added"), removed.cast("bigint").alias("removed")
    )


@query(
    """WITH words AS (SELECT doc_id, string_split(text, ' ') AS names FROM documents)
    SELECT doc_id, names = list_sort(list_distinct(names)) AS canonical FROM words"""
)
def canonical_order(spark: SparkSession, folder: str) -> DataFrame:
    names: Column = F.split("text", " ")
    return _documents(spark, folder).select("doc_id", records.is_canonical_order(names).alias("canonical"))


@query(
    """SELECT doc_id, doc_id % 3 <> 1 AND length(trim(text, ' ' || chr(10) || chr(9))) > 0 AS valid FROM documents"""
)
def query_validate(spark: SparkSession, folder: str) -> DataFrame:
    """By ``doc_id % 3``: 0 the text, 1 blanks only, 2 the text after a blank."""
    form = F.pmod("doc_id", F.lit(3))
    asked = (
        F.when(form == 1, F.lit(" \n\t\u00a0"))
        .when(form == 2, F.concat(F.lit(" "), c("text")))
        .otherwise(c("text"))
    )
    return _documents(spark, folder).select("doc_id", text.query_valid(asked).alias("valid"))
