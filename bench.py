"""Headline queries over the given tables; prints one JSON line.

Reads BENCH_SF_DIR and BENCH_CPUS. One query runs for warm-up, then each is built and
run to the end for the clock; results go to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelock.operators.chains import chain_build, chain_verify
from quotelock.operators.lineage import append_packets, packet_payload
from quotelock.plans import catalog
from quotelock.plans.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "promotion_gate",
    "citation_preview",
    "quote_locate",
    "content_dedupe",
    "html_text_view",
    "chain_build",
    "chain_verify",
    "collection_audit",
    "lineage_verify",
    "review_list",
    "signer_quorum",
    "active_policy_asof",
    "coverage_adjacency",
    "manifest_diff",
)


def drain(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def order_chains(spark: SparkSession) -> DataFrame:
    """Every order is a packet; customers are dealt to chains of about a hundred orders."""
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    chains = max(1, orders.count() // 100)
    head = F.sha2(F.concat_ws(":", "o_orderkey", "o_orderdate", "o_orderpriority"), 256)
    chain = F.pmod(F.xxhash64("o_custkey"), F.lit(chains))
    return orders.select(
        chain.alias("collection_id"),
        F.row_number().over(Window.partitionBy(chain).orderBy("o_orderkey")).cast("bigint").alias("sequence"),
        head.alias("packet_sha256"),
        head.alias("source_sha256"),
        F.octet_length("o_orderpriority").cast("bigint").alias("source_byte_length"),
        F.concat(F.lit("c"), "o_orderkey").alias("candidate_id"),
        F.concat(F.lit("e"), "o_orderkey").alias("evidence_id"),
    )


def chain_rates(spark: SparkSession, scratch: str) -> dict[str, float]:
    """Verification rate, and the time of one batch append of n and of 2n packets."""
    built = chain_build(order_chains(spark), ["collection_id"], packet_payload())
    built.write.mode("overwrite").parquet(f"{scratch}/entries")
    stored = spark.read.parquet(f"{scratch}/entries")
    lines = stored.count()

    def verify() -> None:
        drain(chain_verify(stored, ["collection_id"], packet_payload()))

    def append(part: int) -> None:
        first = stored.where("sequence <= 2")
        added = (
            stored.where((F.col("sequence") > 2) & (F.col("sequence") <= 2 + part))
            .withColumn("append_order", F.col("sequence") - 2)
            .drop("sequence", "previous_entry_sha256", "entry_sha256")
        )
        drain(append_packets(first, added, ["collection_id"]))

    verify()
    append(10)
    return {
        "chain_entries": lines,
        "chain_verify_seconds": timed(verify),
        "batch_append_48": timed(lambda: append(48)),
        "batch_append_96": timed(lambda: append(96)),
    }


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="quotelock-bench-")
    spark = build_session(
        "quotelock-bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=f"file://{scratch}/shared",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.load()
    names = sys.argv[1:] or list(HEADLINES)
    seconds: dict[str, float] = {}
    drain(registered["promotion_gate"].build(spark, FOLDER))
    for name in names:
        build = registered[name].build
        seconds[name] = round(timed(lambda: drain(build(spark, FOLDER))), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    extra: dict[str, float] = {}
    if not sys.argv[1:]:
        rates = chain_rates(spark, scratch)
        candidates = registered["promotion_gate"].build(spark, FOLDER).count()
        extra = {
            "citations_gated_per_sec": round(candidates / seconds["promotion_gate"], 1),
            "chain_entries_verified_per_sec": round(rates["chain_entries"] / rates["chain_verify_seconds"], 1),
            "append_96_over_48": round(rates["batch_append_96"] / rates["batch_append_48"], 3),
        }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                **extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
