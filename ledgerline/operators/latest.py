"""Latest-per-key reads, sequences, heads of line, and journal folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import ordered


def latest(rows: DataFrame, key: list[str], order: str, carry: list[str]) -> DataFrame:
    """One row per key: the values of `carry` at the greatest `order`. An aggregate, so tasks keep one row a key."""
    best = F.max(F.struct(order, *carry)).alias("__b")
    return rows.groupBy(*key).agg(best).select(*key, f"__b.{order}", *[f"__b.{c}" for c in carry])


def with_latest_evidence(inventory: DataFrame, evidence: DataFrame) -> DataFrame:
    """Inventory rows beside their latest identity evidence, nulls where they have none."""
    return inventory.join(latest(evidence, ["resource_id"], "observation_id", ["provider_id", "assurance"]), "resource_id", "left")


def sequence_bounds(rows: DataFrame, key: str = "root_id", seq: str = "seq") -> DataFrame:
    return rows.groupBy(key).agg(F.max(seq).alias("last_seq"), (F.coalesce(F.max(seq), F.lit(0)) + 1).alias("next_seq"))


def head_of_line(admissions: DataFrame) -> DataFrame:
    """Per root the pending admission with the lowest number."""
    pending = admissions.filter("status = 'PENDING'")
    return pending.groupBy("root_id").agg(F.min(F.struct("seq", "snapshot_id")).alias("h")).select("root_id", "h.seq", "h.snapshot_id")


def pending_roots(admissions: DataFrame, limit: int | None = None) -> DataFrame:
    roots = admissions.filter("status = 'PENDING'").select("root_id").distinct()
    return roots if limit is None else roots.orderBy("root_id").limit(limit)


def gaps(journal: DataFrame, key: str = "root_id", seq: str = "event_seq") -> DataFrame:
    """Rows whose number isn't one above the one before (0 before the first)."""
    scan = ordered.running(ordered.spread(journal, [key], [seq]), [key], F.col(seq), "last", "previous", itself=False)
    return ordered.bare(scan).withColumn("previous", F.coalesce("previous", F.lit(0))).filter(F.col(seq) != F.col("previous") + 1)


def terminal_presence(journal: DataFrame) -> DataFrame:
    """What the journal says last of each resource: the fold of its events."""
    kind = F.when(F.col("event_type") == "resource-removed", "REMOVED").when(F.col("event_type").startswith("resource-"), "PRESENT")
    rows = journal.filter("resource_id is not null").withColumn("terminal", kind).filter("terminal is not null")
    return latest(rows, ["root_id", "resource_id"], "event_seq", ["terminal"])


def presence_mismatches(inventory: DataFrame, journal: DataFrame) -> DataFrame:
    """Resources on which inventory and journal differ, either way round."""
    both = inventory.select("root_id", "resource_id", "presence").join(terminal_presence(journal).select("root_id", "resource_id", "terminal"), ["root_id", "resource_id"], "full")
    return both.filter(~F.col("presence").eqNullSafe(F.col("terminal")))


def unadmitted(snapshots: DataFrame, admissions: DataFrame) -> DataFrame:
    """Submitted snapshots that nothing admitted."""
    return snapshots.join(admissions.select("root_id", "snapshot_id"), ["root_id", "snapshot_id"], "left_anti")


def unadmitted_by_root(rows: DataFrame) -> DataFrame:
    """Per root: how many are stranded, and the one if it is alone (several are ambiguous and stay)."""
    return rows.groupBy("root_id").agg(F.count("*").alias("n"), F.min("snapshot_id").alias("only")).select("root_id", "n", F.when(F.col("n") == 1, F.col("only")).alias("admit"), (F.col("n") > 1).alias("ambiguous"))


def missing_runs(observations: DataFrame) -> DataFrame:
    """Consecutive-missing count and start per resource and admission: gaps and islands over the presence flag.

    observations: root_id, resource_id, seq, at, missing.
    """
    key = Window.partitionBy("root_id", "resource_id").orderBy("seq")
    island = F.sum(F.when(F.col("missing"), 0).otherwise(1)).over(key)
    own = Window.partitionBy("root_id", "resource_id", "island").orderBy("seq")
    out = observations.withColumn("island", island)
    return out.withColumn("consecutive", F.sum(F.when(F.col("missing"), 1).otherwise(0)).over(own)).withColumn("missing_since", F.when(F.col("missing"), F.min(F.when(F.col("missing"), F.col("at"))).over(own))).drop("island")
