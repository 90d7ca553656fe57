"""Trust and release queries: policies, signatures, manifests, packs, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelock.functions.digests import canonical_digest, packed, unpacked
from quotelock.operators import audits, releases, trust
from quotelock.plans.registry import query, table
from quotelock.plans.views import (
    RELEASES_SQL,
    UPGRADES_SQL,
    iso,
    iso_sql,
    upgrades,
)
from quotelock.plans.views import releases as release_view

c = F.col


def _key(number: Column) -> Column:
    return F.sha2(F.concat(F.lit("key:"), number.cast("string")), 256)


@query(
    """SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN 'POLICY_KEYS_INVALID' WHEN 2 THEN 'POLICY_KEY_DUPLICATE'
         WHEN 3 THEN 'POLICY_KEYS_UNSORTED' WHEN 4 THEN 'POLICY_THRESHOLD_INVALID' WHEN 5 THEN 'POLICY_REVOKED_INVALID'
         WHEN 6 THEN 'POLICY_KEY_REVOKED' WHEN 7 THEN 'POLICY_TIME_INVALID' WHEN 8 THEN 'POLICY_WINDOW_INVALID' END
         AS failure_code FROM part"""
)
def trust_policy_validate(spark: SparkSession, folder: str) -> DataFrame:
    """One manual policy per part; by ``p_partkey % 10`` one rule is broken."""
    form = F.pmod("p_partkey", F.lit(10))
    keys = F.array_sort(F.array(*[_key(c("p_partkey") * 3 + i) for i in range(3)]))
    other = F.array(_key(c("p_partkey") * 3 + 9))
    first = F.get(keys, F.lit(0))
    policies = table(spark, folder, "part").select(
        "p_partkey",
        F.when(form == 1, F.array(F.lit("key")))
        .when(form == 2, F.array(first, first))
        .when(form == 3, F.reverse(keys))
        .otherwise(keys)
        .alias("trusted_key_ids"),
        F.when(form == 4, 4).otherwise(2).alias("threshold"),
        F.when(form == 5, F.array(F.lit("key")))
        .when(form == 6, F.array(first))
        .when(form == 9, F.lit(None).cast("array<string>"))
        .otherwise(other)
        .alias("revoked_key_ids"),
        F.when(form == 7, F.lit("2026-01-01")).otherwise(F.lit("2026-01-01T00:00:00.000Z")).alias("valid_from"),
        F.when(form == 8, F.lit("2026-01-01T00:00:00.000Z"))
        .when(form == 9, F.lit(None).cast("string"))
        .otherwise(F.lit("2026-12-31T00:00:00.000Z"))
        .alias("valid_until"),
    )
    return trust.trust_policy_validate(policies).select("p_partkey", "failure_code")


def _order_days(spark: SparkSession, folder: str) -> DataFrame:
    day = F.datediff(c("o_orderdate").cast("timestamp_ntz").cast("date"), F.lit("1970-01-01").cast("date"))
    return table(spark, folder, "orders").select(
        c("o_custkey").alias("policy_key"), "o_orderkey", (day * 86400).cast("bigint").alias("effective")
    )


@query(
    """WITH policies AS (SELECT o_custkey AS policy_key, o_orderkey AS policy_id, CAST(epoch(o_orderdate) AS BIGINT) AS effective,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders),
    probes AS (SELECT c_custkey AS policy_key, unnest([883612800, 946684800]) AS at FROM customer),
    totals AS (SELECT policy_key, count(*) AS n FROM policies GROUP BY 1)
    SELECT p.policy_key, CAST(p.at AS BIGINT) AS at, a.sequence, a.policy_id,
      CAST(coalesce(t.n, 0) - coalesce(a.sequence, 0) AS BIGINT) AS scheduled_count,
      CASE WHEN a.sequence IS NULL THEN 'POLICY_NOT_YET_ACTIVE' END AS failure_code
    FROM probes p LEFT JOIN totals t ON t.policy_key = p.policy_key
    LEFT JOIN policies a ON a.policy_key = p.policy_key AND a.sequence = (SELECT count(*) FROM policies x
      WHERE x.policy_key = p.policy_key AND x.effective <= p.at)"""
)
def active_policy_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's orders are policies, in force from the order date; two probes each."""
    from quotelock.plans.blocks import running_sum

    policies = _order_days(spark, folder)
    numbered = running_sum(
        policies.withColumn("_day", F.floor(c("effective") / 86400)),
        ["policy_key"],
        "_day",
        F.lit(1),
        "sequence",
        tiebreak=["o_orderkey"],
        block_rows=30,
    ).select("policy_key", "effective", c("sequence").cast("bigint").alias("sequence"), c("o_orderkey").alias("policy_id"))
    probes = table(spark, folder, "customer").select(
        c("c_custkey").alias("policy_key"),
        F.explode(F.array(F.lit(883612800), F.lit(946684800)).cast("array<bigint>")).alias("at"),
    )
    return trust.active_policy_asof(
        numbered, probes, ["policy_key"], "effective", "at", ["sequence", "policy_id"]
    )


# -- signatures from lineitem --------------------------------------------------------------


def _signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Line items sign their order; the supplier is the signer. In every eleventh order a line is there twice."""
    report = F.sha2(F.concat(F.lit("report:"), c("l_orderkey").cast("string")), 256)
    twice = (F.pmod("l_orderkey", F.lit(11)) == 3) & (c("l_linenumber") == 2)
    lines = table(spark, folder, "lineitem").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1))))
    return lines.select(
        c("l_orderkey").alias("report_id"),
        c("l_suppkey").alias("key_id"),
        F.when(F.pmod("l_partkey", F.lit(13)) == 5, F.sha2(report, 256)).otherwise(report).alias("report_sha256"),
        F.coalesce(c("l_linenumber") > 1, F.lit(False)).alias("signature_valid"),
        # A line number may repeat within an order, so the part breaks ties.
        F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax").alias(
            "signature_order"
        ),
    )


def _filtered(spark: SparkSession, folder: str) -> DataFrame:
    reports = table(spark, folder, "orders").select(
        c("o_orderkey").alias("report_id"),
        F.sha2(F.concat(F.lit("report:"), c("o_orderkey").cast("string")), 256).alias("expected_sha256"),
    )
    keys = table(spark, folder, "supplier").select(c("s_suppkey").alias("key_id"))
    return trust.signature_filter(
        _signatures(spark, folder),
        reports,
        keys.where(F.pmod("key_id", F.lit(4)) != 0),
        keys.where(F.pmod("key_id", F.lit(25)) == 7),
    )


_SIGNATURES_SQL = """signatures AS (
  SELECT l_orderkey AS report_id, l_suppkey AS key_id, l_partkey % 13 = 5 AS foreign_report, l_linenumber > 1 AS valid,
    l_linenumber, l_partkey, l_suppkey % 4 <> 0 AS trusted, l_suppkey % 25 = 7 AS revoked,
    rank() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity,
      l_shipdate, l_discount, l_tax) + count(*) OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber, l_partkey,
      l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS nth,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity,
      l_shipdate, l_discount, l_tax) AS place
  FROM lineitem, unnest(range(CASE WHEN l_orderkey % 11 = 3 AND l_linenumber = 2 THEN 2 ELSE 1 END))), filtered AS (
  SELECT *, CASE WHEN foreign_report OR report_id NOT IN (SELECT o_orderkey FROM orders) THEN 'SIGNATURE_REPORT_MISMATCH'
      WHEN revoked THEN 'SIGNATURE_KEY_REVOKED' WHEN trusted AND nth > 1 THEN 'SIGNATURE_SIGNER_DUPLICATE'
      WHEN NOT valid THEN 'SIGNATURE_INVALID' END AS failure_code FROM signatures)"""


@query(
    f"""WITH {_SIGNATURES_SQL}
    SELECT report_id, key_id, l_linenumber AS line, l_partkey AS part, failure_code,
      failure_code IS NULL AND trusted AS counted FROM filtered"""
)
def signature_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder).select(
        "report_id",
        "key_id",
        c("signature_order.l_linenumber").alias("line"),
        c("signature_order.l_partkey").alias("part"),
        "failure_code",
        "counted",
    )


def _quorums(spark: SparkSession, folder: str) -> DataFrame:
    form = F.pmod("o_orderkey", F.lit(10))
    policies = table(spark, folder, "orders").select(
        c("o_orderkey").alias("report_id"),
        F.when(form == 1, 0).when(form == 2, 90).otherwise(2).cast("bigint").alias("threshold"),
        F.lit(75).alias("trusted_count"),
        F.when(form == 3, F.lit("2026-06-01T00:00:00.000Z")).alias("valid_from"),
        F.when(form == 4, F.lit("2026-02-01T00:00:00.000Z")).alias("valid_until"),
    )
    return trust.signer_quorum(
        _filtered(spark, folder), policies, F.lit("2026-03-01T00:00:00.000Z"), strict=False
    )


_QUORUM_SQL = f"""{_SIGNATURES_SQL}, counted AS (
  SELECT report_id, count(DISTINCT key_id) AS n FROM filtered WHERE failure_code IS NULL AND trusted GROUP BY 1), quorums AS (
  SELECT o_orderkey AS report_id, coalesce(n, 0) AS verified_signers, o_orderkey % 10 AS form,
    CASE o_orderkey % 10 WHEN 1 THEN 0 WHEN 2 THEN 90 ELSE 2 END AS threshold
  FROM orders LEFT JOIN counted ON report_id = o_orderkey), results AS (
  SELECT *, CASE WHEN form = 1 THEN 'POLICY_THRESHOLD_INVALID' WHEN form = 3 THEN 'POLICY_NOT_YET_VALID'
      WHEN form = 4 THEN 'POLICY_EXPIRED' WHEN form = 2 THEN 'POLICY_THRESHOLD_UNREACHABLE'
      WHEN verified_signers < threshold THEN 'SIGNATURE_THRESHOLD_NOT_MET' END AS failure_code FROM quorums)"""


@query(f"WITH {_QUORUM_SQL} SELECT report_id, verified_signers, failure_code FROM results")
def signer_quorum(spark: SparkSession, folder: str) -> DataFrame:
    return _quorums(spark, folder).select("report_id", "verified_signers", "failure_code")


@query(
    f"""WITH {_QUORUM_SQL}, policy AS (SELECT *, sha256('key:' || report_id) AS key, sha256('hist:' || report_id) AS hist FROM results),
    coded AS (SELECT *, CASE WHEN report_id % 7 = 1 THEN 'REPORT_UNPROTECTED' WHEN report_id % 7 = 2
        THEN 'TRUST_SETTINGS_MIXED' WHEN report_id % 7 = 3 THEN 'TRUST_SETTINGS_MISSING' ELSE failure_code END AS code,
      sha256('{{"revokedKeyIds":[],"threshold":' || threshold || ',"trustedKeyIds":["' || key || '"]}}') AS policy_digest FROM policy)
    SELECT report_id, code AS failure_code, CASE WHEN code IS NULL THEN sha256('{{"bundle":{{"bundleSha256":"' ||
        sha256('bundle:' || report_id) || '","version":1}},"outcome":"verified","report":{{"reportSha256":"' ||
        sha256('report:' || report_id) || '"}},"signatures":{{"algorithm":"ed25519","threshold":' || threshold ||
        ',"verifiedSignerCount":' || verified_signers || '}},"trust":{{' || CASE WHEN report_id % 7 = 4 THEN
        '"activeSequence":1,"historySha256":"' || hist || '","mode":"rotation-history"' ELSE
        '"mode":"manual","policySha256":"' || policy_digest || '"' END ||
        '}},"verifiedAt":"2026-03-01T00:00:00.000Z","version":1}}') END AS receipt_sha256 FROM coded"""
)
def review_receipt(spark: SparkSession, folder: str) -> DataFrame:
    """By ``report_id % 7``: 1 unprotected, 2 mixed settings, 3 none, 4 rotation, else manual."""
    form = F.pmod("report_id", F.lit(7))
    number = c("report_id").cast("string")
    requests = _quorums(spark, folder).select(
        "report_id",
        "verified_signers",
        "threshold",
        c("failure_code").alias("quorum_code"),
        (form != 1).alias("report_protected"),
        F.sha2(F.concat(F.lit("report:"), number), 256).alias("report_sha256"),
        F.sha2(F.concat(F.lit("bundle:"), number), 256).alias("bundle_sha256"),
        F.when(~form.isin(3, 4), F.array(_key(c("report_id")))).alias("trusted_key_ids"),
        F.lit(None).cast("array<string>").alias("revoked_key_ids"),
        F.lit(None).cast("string").alias("valid_from"),
        F.lit(None).cast("string").alias("valid_until"),
        F.when(form.isin(2, 4), F.sha2(F.concat(F.lit("hist:"), number), 256)).alias("history_sha256"),
        F.when(form.isin(2, 4), 1).alias("active_sequence"),
        F.lit("2026-03-01T00:00:00.000Z").alias("verified_at"),
    )
    return trust.review_receipt(requests).select("report_id", "failure_code", "receipt_sha256")


@query(
    f"""WITH {RELEASES_SQL}, timed AS (
      SELECT product_id, sequence, {iso_sql('sequence * 86400')} AS effective_at,
        ['a' || (sequence % 3), 'b' || (sequence % 2)] AS keys FROM releases),
    paired AS (SELECT *, lag(keys) OVER (PARTITION BY product_id ORDER BY sequence) AS before,
      count(*) OVER (PARTITION BY product_id) AS entry_count FROM timed)
    SELECT product_id, entry_count, sequence AS active_sequence, sequence - 1 AS completed_rotations,
      entry_count - sequence AS scheduled_count, effective_at AS latest_effective_at,
      CAST(CASE WHEN before IS NULL THEN 0 ELSE len(list_filter(keys, lambda k: NOT list_contains(before, k))) END AS BIGINT)
        AS latest_added_key_count,
      CAST(CASE WHEN before IS NULL THEN 0 ELSE len(list_filter(before, lambda k: NOT list_contains(keys, k))) END AS BIGINT)
        AS latest_removed_key_count
    FROM paired WHERE sequence = least(8, entry_count)"""
)
def rotation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A product's releases are its rotations, one a day, seen nine days after the start."""
    entries = release_view(spark, folder).select(
        "product_id",
        "sequence",
        iso(c("sequence") * 86400).alias("effective_at"),
        F.array(
            F.concat(F.lit("a"), F.pmod("sequence", F.lit(3)).cast("string")),
            F.concat(F.lit("b"), F.pmod("sequence", F.lit(2)).cast("string")),
        ).alias("key_ids"),
    )
    return trust.rotation_summary(entries, ["product_id"], F.lit("2026-01-09T12:00:00.000Z")).drop("failure_code")


@query(
    f"""WITH {RELEASES_SQL}
    SELECT product_id, count(*) AS verified_pack_count, CAST(sum(verified_signer_count) AS BIGINT) AS review_verified_count,
      count(*) FILTER (trust_mode = 'manual') AS manual_count, count(*) FILTER (trust_mode <> 'manual')
        AS rotation_history_count FROM releases GROUP BY 1"""
)
def trust_mode_counts(spark: SparkSession, folder: str) -> DataFrame:
    return audits.trust_mode_counts(release_view(spark, folder), ["product_id"])


# -- manifests, packs and upgrades -----------------------------------------------------------


@query(
    """WITH sides AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 10 <> 0 THEN sha256(p_name) END AS old,
         CASE WHEN p_partkey % 7 <> 0 THEN sha256(CASE WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END) END AS new FROM part),
    diff AS (SELECT *, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'changed'
      ELSE 'unchanged' END AS change FROM sides WHERE old IS NOT NULL OR new IS NOT NULL),
    totals AS (SELECT p_brand, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
      count(*) FILTER (change = 'changed') AS changed FROM diff GROUP BY 1)
    SELECT d.p_brand, d.p_partkey, d.change, CASE WHEN removed + changed > 0 THEN 'breaking' ELSE 'compatible' END AS outcome,
      CASE WHEN removed + changed > 0 THEN 'major' WHEN added > 0 THEN 'minor' ELSE 'patch' END AS required_bump,
      removed + changed = 0 AS satisfied
    FROM diff d JOIN totals t ON t.p_brand = d.p_brand"""
)
def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Parts are manifest items, a brand is a package going from 1.0.0 to 1.1.0."""
    part = table(spark, folder, "part")
    number = c("p_partkey")
    renamed = F.when(F.pmod(number, F.lit(5)) == 0, F.concat("p_name", F.lit("!"))).otherwise(c("p_name"))
    keys = ["p_brand", "p_partkey"]
    previous = part.where(F.pmod(number, F.lit(10)) != 0).select(*keys, F.sha2("p_name", 256).alias("digest"))
    current = part.where(F.pmod(number, F.lit(7)) != 0).select(*keys, F.sha2(renamed, 256).alias("digest"))
    diff = releases.manifest_diff(previous, current, keys)
    versions = part.select(
        "p_brand", F.lit("1.0.0").alias("previous_version"), F.lit("1.1.0").alias("current_version")
    ).distinct()
    outcome = releases.manifest_compatibility(diff, versions, ["p_brand"]).select(
        "p_brand", "outcome", "required_bump", "satisfied"
    )
    return diff.select(*keys, "change").join(outcome, "p_brand")


@query(
    """SELECT o_orderkey AS pack_id, CASE o_orderkey % 11 WHEN 1 THEN 'STATEMENT_PACKAGE_MISMATCH'
         WHEN 2 THEN 'STATEMENT_BUNDLE_MISMATCH' WHEN 3 THEN 'STATEMENT_MANIFEST_MISMATCH' WHEN 4 THEN 'STATEMENT_RECEIPT_MISMATCH'
         WHEN 5 THEN 'RECEIPT_BUNDLE_MISMATCH' WHEN 6 THEN 'RECEIPT_REPORT_MISMATCH' WHEN 7 THEN 'RECEIPT_MANIFEST_MISMATCH'
         WHEN 8 THEN 'RECEIPT_MODE_MISMATCH' WHEN 9 THEN 'RECEIPT_POLICY_MISMATCH' WHEN 10 THEN 'STATEMENT_PACKAGE_MISMATCH'
         END AS failure_code FROM orders"""
)
def pack_crosslinks(spark: SparkSession, folder: str) -> DataFrame:
    """Packs of five artifacts; by ``pack_id % 11`` one link is broken, 10 lost its package."""
    orders = table(spark, folder, "orders").select(c("o_orderkey").alias("pack_id"))
    form = F.pmod("pack_id", F.lit(11))

    def head(kind: str) -> Column:
        return F.sha2(F.concat(F.lit(f"{kind}:"), c("pack_id").cast("string")), 256)

    def link(kind: str, broken: int) -> Column:
        return F.when(form == broken, F.sha2(head(kind), 256)).otherwise(head(kind))

    statements = orders.select(
        "pack_id",
        link("package", 1).alias("stated_package"),
        link("bundle", 2).alias("stated_bundle"),
        link("manifest", 3).alias("stated_manifest"),
        link("receipt", 4).alias("stated_receipt"),
    )
    bundles = orders.select("pack_id", head("bundle").alias("bundle_sha256"), head("report").alias("report_sha256"))
    manifests = orders.select(
        "pack_id",
        head("manifest").alias("manifest_sha256"),
        head("policy").alias("policy_sha256"),
        F.lit("manual").alias("trust_mode"),
    )
    receipts = orders.select(
        "pack_id",
        head("receipt").alias("receipt_sha256"),
        link("bundle", 5).alias("receipt_bundle"),
        link("report", 6).alias("receipt_report"),
        link("manifest", 7).alias("receipt_manifest"),
        F.when(form == 8, "rotation-history").otherwise("manual").alias("receipt_mode"),
        link("policy", 9).alias("receipt_policy"),
    )
    packages = orders.where(form != 10).select("pack_id", head("package").alias("package_sha256"))
    linked = releases.pack_crosslinks(statements, bundles, manifests, receipts, packages)
    return linked.select("pack_id", "failure_code")


@query(
    f"""WITH {UPGRADES_SQL}
    SELECT release_key AS binding_id, CASE release_key % 6 WHEN 1 THEN 'UPGRADE_BINDING_EVIDENCE_MISSING'
      WHEN 2 THEN 'UPGRADE_BINDING_VERSION_MISMATCH' WHEN 3 THEN 'UPGRADE_BINDING_MANIFEST_MISMATCH' END AS failure_code
    FROM upgrades"""
)
def upgrade_binding_check(spark: SparkSession, folder: str) -> DataFrame:
    """By ``release_key % 6``: 1 no evidence, 2 another version, 3 another manifest."""
    form = F.pmod("release_key", F.lit(6))
    moves = upgrades(spark, folder)
    index = release_view(spark, folder).select(
        c("pack_sha256").alias("release_id"), c("release_version").alias("version"), "manifest_sha256"
    )
    heads = ["previous_pack_sha256", "current_pack_sha256", "upgrade_evidence_sha256"]
    packs = index.select(packed(c("release_id")).alias("pack"), packed(c("manifest_sha256")).alias("manifest"))
    old = packs.select(c("pack").alias("previous_pack_sha256"), c("manifest").alias("previous_manifest"))
    new = packs.select(c("pack").alias("current_pack_sha256"), c("manifest").alias("current_manifest"))
    evidence = (
        moves.where(form != 1)
        .withColumns({name: packed(c(name)) for name in heads})
        .join(old, "previous_pack_sha256")
        .join(new, "current_pack_sha256")
        .withColumn("current_manifest_sha256", unpacked(c("current_manifest")))
        .select(
            unpacked(c("upgrade_evidence_sha256")).alias("evidence_id"),
            F.when(form == 2, F.lit("0.0.1")).otherwise(c("previous_package_version")).alias("previous_version"),
            c("current_package_version").alias("current_version"),
            unpacked(c("previous_manifest")).alias("previous_manifest_sha256"),
            F.when(form == 3, F.sha2("current_manifest_sha256", 256))
            .otherwise(c("current_manifest_sha256"))
            .alias("current_manifest_sha256"),
        )
    )
    bindings = moves.select(
        c("release_key").alias("binding_id"),
        c("previous_pack_sha256").alias("previous_release"),
        c("current_pack_sha256").alias("current_release"),
        c("upgrade_evidence_sha256").alias("evidence_id"),
    )
    return releases.upgrade_binding_check(bindings, index, evidence).select("binding_id", "failure_code")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 1 THEN 'STATEMENT_SCHEMA_INVALID' WHEN 2 THEN 'STATEMENT_REVISION_INVALID'
         WHEN 3 THEN 'STATEMENT_ARTIFACTS_INVALID' WHEN 4 THEN 'STATEMENT_ASSURANCE_INVALID' WHEN 5 THEN 'STATEMENT_INTEGRITY_INVALID'
         WHEN 6 THEN 'STATEMENT_SIGNATURE_MISSING' WHEN 7 THEN 'STATEMENT_SIGNATURE_UNEXPECTED' WHEN 8 THEN 'STATEMENT_SIGNATURE_DOWNGRADE'
         WHEN 9 THEN 'STATEMENT_KEY_REQUIRED' WHEN 10 THEN 'STATEMENT_KEY_MISMATCH' WHEN 11 THEN 'STATEMENT_SIGNATURE_INVALID' END
         AS failure_code FROM orders"""
)
def statement_assurance(spark: SparkSession, folder: str) -> DataFrame:
    """One statement per order; by ``o_orderkey % 12`` one rule is broken."""
    form = F.pmod("o_orderkey", F.lit(12))
    number = c("o_orderkey").cast("string")

    def head(kind: str) -> Column:
        return F.sha2(F.concat(F.lit(f"{kind}:"), number), 256)

    unsigned = form.isin(7, 8)
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(form == 1, "1.0").otherwise("1.2.3").alias("package_version"),
        head("package").alias("package_sha256"),
        *[F.substring(head(name), 1, 40).alias(f"{name}_commit") for name in releases.REVISIONS],
        *[
            F.when((form == 2) & F.lit(name == "ledger"), F.lit(False)).otherwise(F.lit(True)).alias(f"{name}_clean")
            for name in releases.REVISIONS
        ],
        F.when(form == 3, 3).otherwise(4).alias("event_count"),
        head("bundle").alias("bundle_sha256"),
        head("manifest").alias("manifest_sha256"),
        head("receipt").alias("receipt_sha256"),
        F.when(form == 4, "rsa").when(unsigned, "none").otherwise("ed25519").alias("assurance"),
        F.when(~form.isin(6, 8), head("key")).alias("signature_key_id"),
        F.when(form == 10, head("other")).when(~form.isin(7, 9), head("key")).alias("expected_key_id"),
        (form != 11).alias("signature_valid"),
    )
    own = canonical_digest(releases.statement_members())
    sealed = rows.withColumn("statement_sha256", F.when(form == 5, F.sha2(own, 256)).otherwise(own))
    return releases.statement_assurance(sealed).select("o_orderkey", "failure_code")


# -- benchmarks from line items ----------------------------------------------------------------

_SAMPLES_SQL = """samples AS (
  SELECT l_suppkey AS suite, l_linenumber AS packet_count, l_quantity AS append_ms, l_extendedprice AS verify_ms FROM lineitem)"""


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        c("l_suppkey").alias("suite"),
        c("l_linenumber").alias("packet_count"),
        c("l_quantity").alias("append_ms"),
        c("l_extendedprice").alias("verify_ms"),
    )


@query(
    f"""WITH {_SAMPLES_SQL} SELECT suite, packet_count, median(append_ms) AS append_ms, median(verify_ms) AS verify_ms
    FROM samples GROUP BY 1, 2"""
)
def sample_median(spark: SparkSession, folder: str) -> DataFrame:
    return releases.sample_median(_samples(spark, folder), ["suite", "packet_count"], ["append_ms", "verify_ms"])


@query(
    """WITH base AS (SELECT l_suppkey AS suite, l_linenumber AS packet_count, CAST(sum(l_quantity) AS BIGINT) AS append_ms,
         count(*) AS verify_ms, count(*) AS lineage_bytes FROM lineitem GROUP BY 1, 2),
    ratios AS (SELECT coalesce(b.suite, n.suite) AS suite, coalesce(b.packet_count, n.packet_count) AS packet_count,
        round(n.append_ms / b.append_ms, 4) AS append_ratio,
        round(n.verify_ms / b.verify_ms, 4) AS verification_ratio,
        CASE WHEN n.suite IS NULL OR b.suite IS NULL THEN 'BENCHMARK_CHECKPOINT_MISSING' END AS code
      FROM base b FULL JOIN (SELECT suite - 1 AS suite, packet_count, append_ms, verify_ms FROM base) n
        ON n.suite = b.suite AND n.packet_count = b.packet_count),
    limits AS (SELECT *, coalesce(append_ratio <= 1.25 AND verification_ratio <= 1.25, false) AS within FROM ratios)
    SELECT suite, count(*) AS checkpoints, count(*) FILTER (NOT within) AS exceeded,
      arg_min(code, packet_count) FILTER (code IS NOT NULL) AS failure_code,
      CASE WHEN count(*) FILTER (code IS NOT NULL) > 0 THEN 'invalid'
        WHEN count(*) FILTER (NOT within) >= 2 OR NOT arg_max(within, packet_count) THEN 'regressed' ELSE 'verified' END
        AS outcome
    FROM limits GROUP BY suite"""
)
def regression_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """A supplier's line totals are a suite's checkpoints; the next supplier is the candidate."""
    base = table(spark, folder, "lineitem").groupBy(
        c("l_suppkey").alias("suite"), c("l_linenumber").alias("packet_count")
    ).agg(
        F.sum("l_quantity").cast("bigint").alias("append_ms"),
        F.count("*").alias("verify_ms"),
    )
    baseline = base.withColumn("lineage_bytes", F.lit(1))
    candidate = baseline.withColumn("suite", c("suite") - 1)
    checkpoints = releases.regression_checkpoints(baseline, candidate, ["suite"])
    return releases.regression_verdict(checkpoints, ["suite"])
