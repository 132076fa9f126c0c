"""How far a snapshot can be trusted: the completeness cascade and shrink corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.paths import entry_path  # noqa: F401
from ledgerline.functions.values import FRESH, blank, defaulted
from ledgerline.operators import ordered

SHRINK_RATIO = 0.5


def shrink(prior: Column, entries: Column, ratio: float = SHRINK_RATIO) -> Column:
    """A drop of at least `ratio` of a non-empty prior inventory."""
    return (prior > 0) & (prior > entries) & ((prior - entries) / F.nullif(prior, F.lit(0)) >= ratio)


def acceptance(snapshots: DataFrame, ratio: float = SHRINK_RATIO) -> DataFrame:
    """snapshots plus acceptance; the first rule that holds decides.

    Reads traversal, error_summary, skipped_scopes, skipped_known_empty, freshness, assurance, used_cache, entries,
    prior_present, corroboration. An empty skip list is no skip. Missing freshness and assurance count as unknown.
    """
    c = F.col
    freshness, assurance = defaulted(c("freshness"), "UNKNOWN"), defaulted(c("assurance"), "UNKNOWN_FAILURE_VISIBILITY")
    skipped = ~blank(c("skipped_scopes")).isin("", "[]")
    success = c("traversal") == "SUCCESS"
    cascade = (
        F.when(c("traversal") == "FAILED", "FAILED")
        .when(c("traversal").isin("INTERRUPTED", "PARTIAL"), "PARTIAL")
        .when(c("error_summary").isNotNull(), "PARTIAL")
        .when(skipped, "PARTIAL")
        .when((freshness == "STALE") | ((freshness == "UNKNOWN") & F.coalesce(c("used_cache"), F.lit(False))), "STALE")
        .when(success & shrink(c("prior_present"), c("entries"), ratio) & (blank(c("corroboration")) != "CORROBORATED"), "SUSPICIOUS")
        .when(success & (c("prior_present") > 0) & (c("entries") == 0), "SUSPICIOUS")
        .when(success & c("skipped_known_empty") & freshness.isin(*FRESH) & (assurance == "STRONG_FAILURE_VISIBILITY"), "COMPLETE")
        .when(success & assurance.isin("WEAK_FAILURE_VISIBILITY", "UNKNOWN_FAILURE_VISIBILITY"), "SUSPICIOUS")
        .otherwise("PARTIAL")
    )
    return snapshots.withColumn("acceptance", cascade)


def scope_signature(entries: DataFrame, by: list[str]) -> DataFrame:
    """One digest per snapshot of its set of (parent, name, hash, algorithm) lines; equal sets, equal digests.

    Order-free and without a list per snapshot: two sums of line hashes and a count.
    """
    line = F.concat_ws("\0", blank(F.col("parent_ref")), F.col("name"), blank(F.col("hash")), blank(F.col("alg")))
    return entries.groupBy(*by).agg(
        F.concat_ws(
            "-",
            F.count("*").cast("string"),
            F.sum(F.xxhash64(line).cast("decimal(20,0)")).cast("string"),
            F.sum(F.xxhash64(line, F.lit(1)).cast("decimal(20,0)")).cast("string"),
        ).alias("signature")
    )


def corroborated(snapshots: DataFrame) -> DataFrame:
    """(root_id, snapshot_id) of snapshots whose shrink an earlier one bears out.

    The earlier one is SUSPICIOUS itself, uncorroborated, clean, fresh, strongly visible, has the same signature, and no
    evaluated snapshot between the two has another. snapshots: root_id, snapshot_id, admission_seq, lifecycle, acceptance,
    corroboration, traversal, error_summary, skipped_known_empty, freshness, assurance, signature.

    "No other signature between" is a run of equal signatures in admission order, so ordered scans of a root's snapshots
    replace the pairwise search.
    """
    c = F.col
    seen = c("lifecycle").isin("EVALUATED", "RECONCILED")
    anchor = (
        seen & (c("acceptance") == "SUSPICIOUS") & (blank(c("corroboration")).isin("", "NONE")) & (c("traversal") == "SUCCESS") & c("error_summary").isNull()
        & c("skipped_known_empty") & c("freshness").isin(*FRESH) & (c("assurance") == "STRONG_FAILURE_VISIBILITY")
    )
    key = ["root_id"]
    scan = ordered.spread(snapshots, key, ["admission_seq", "snapshot_id"])
    # an evaluated snapshot that differs from the evaluated one before it opens a run
    scan = ordered.running(scan, key, F.when(seen, c("signature")), "last", "__before", itself=False)
    scan = scan.withColumn("__opens", F.when(seen & ~c("signature").eqNullSafe(c("__before")), 1).otherwise(0))
    scan = ordered.running(scan, key, c("__opens"), "sum", "__own")
    scan = ordered.running(scan, key, F.when(anchor, F.struct(c("__own").alias("run"), c("signature").alias("sig"))), "max", "__anchor", itself=False)
    return scan.filter((c("__anchor.run") == c("__own") - c("__opens")) & (c("__anchor.sig") == c("signature"))).select("root_id", "snapshot_id")
