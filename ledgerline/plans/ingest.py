"""Timings of the store's life: first ingest, an identical repeat, a small change, and a full listing."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import coordinator, reconcile
from ledgerline.plans.fixtures import NOW

SOUND = dict(traversal="SUCCESS", skipped_known_empty=True, freshness="FRESH_DIRECT", assurance="STRONG_FAILURE_VISIBILITY", used_cache=False)


def listing(spark: SparkSession, sf_dir: str, rows: int, change: bool = False) -> DataFrame:
    """The first `rows` orders as files; with change, one has another hash and one is new."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(k < rows + change)
    key = k.cast("string")
    return o.select(
        F.lit("bench").alias("root_id"), F.lit("s").alias("snapshot_id"), F.concat(F.lit("e"), key).alias("entry_id"), F.lit("/").alias("parent_ref"), F.concat(F.lit("f"), F.lpad(key, 9, "0"), F.lit(".txt")).alias("name"), F.lit(False).alias("is_dir"),
        (k % 1000).alias("size"), (F.lit(NOW) + k * 1_000_000).alias("mtime"), F.concat(F.lit("h"), key, F.when(F.lit(change) & (k == 7), "x").otherwise("")).alias("hash"), F.lit("md5").alias("alg"), F.lit(None).cast("string").alias("content_type"),
        F.concat(F.lit("P"), key).alias("provider_id"), F.lit("drive").alias("provider_scope"), F.lit("STABLE_WITHIN_SCOPE").alias("assurance"),
    )


def timings(spark: SparkSession, sf_dir: str, folder: str, rows: int = 20_000) -> dict[str, float]:
    store, cfg, took = coordinator.Store(spark, folder), reconcile.Config(), {}

    def timed(name: str, f) -> None:
        start = time.perf_counter()
        f()
        took[name] = round(time.perf_counter() - start, 3)

    def put(seq: int, want: str, change: bool = False) -> None:
        got = coordinator.process(store, "bench", seq, SOUND | {"snapshot_id": f"s{seq}", "observed_at": NOW + seq}, listing(spark, sf_dir, rows, change), cfg)
        assert got == want, got

    timed("ingest_20k_add", lambda: put(1, coordinator.APPLIED))
    timed("ingest_20k_repeat", lambda: put(2, coordinator.NOOP))
    timed("ingest_20k_delta", lambda: put(3, coordinator.APPLIED, True))
    head = store.load("bench")

    def read_all() -> None:
        assert sum(t.num_rows for t, _ in store.pages(head, 1000)) == rows + 1

    timed("pagination_20k", read_all)
    return took
