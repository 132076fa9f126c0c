"""Applying transitions: journal events, generations, and the new version of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.paths import dirname
from ledgerline.functions.values import lookup
from ledgerline.operators import ordered
from ledgerline.operators.reconcile import GENERATION_KINDS

# Journal event type of each kind that has one.
EVENT_TYPES = {"ADD": "resource-added", "UPDATE": "resource-updated", "RENAME": "resource-renamed", "MOVE": "resource-moved", "CONFIRMED_REMOVED": "resource-removed"}
CANDIDATE = "REMOVAL_CANDIDATE"


def generations(roots: DataFrame, transitions: DataFrame) -> DataFrame:
    """(root_id, generation): one up where some transition is generation-producing, else as it was."""
    moved = transitions.groupBy("root_id").agg(F.bool_or(F.col("kind").isin(*GENERATION_KINDS)).alias("m"))
    return roots.join(moved, "root_id", "left").select("root_id", (F.col("generation") + F.when(F.coalesce("m", F.lit(False)), 1).otherwise(0)).alias("generation"))


def events(transitions: DataFrame, generation: DataFrame, last_seq: DataFrame | None = None) -> DataFrame:
    """Journal events: root_id, generation, intra_seq, event_seq, event_type, resource_id, payload.

    Numbered per root by (entry, resource, ordinal), after last_seq (root_id, event_seq) where given.
    """
    c = F.col
    e = transitions.withColumn("event_type", lookup(c("kind"), EVENT_TYPES)).filter("event_type is not null").join(generation.select("root_id", "generation"), "root_id")
    e = ordered.bare(ordered.number(ordered.spread(e, ["root_id"], [c("entry_id").asc_nulls_last(), "resource_id", "ordinal"]), ["root_id"], "intra_seq"))
    if last_seq is not None:
        e = e.join(last_seq.select("root_id", c("event_seq").alias("__last")), "root_id", "left")
    else:
        e = e.withColumn("__last", F.lit(0))
    return e.select("root_id", "generation", "intra_seq", (F.coalesce("__last", F.lit(0)) + c("intra_seq")).alias("event_seq"), "event_type", "resource_id", F.to_json(F.struct(c("reason"))).alias("payload"))


def apply_transitions(prior: DataFrame, entries: DataFrame, transitions: DataFrame, generation: DataFrame) -> DataFrame:
    """The inventory after the transitions: one merge of the prior rows with their transitions, and the added rows.

    A resource's transitions apply in the order of its entries' ids and their ordinals: the last path, and the last
    attributes, win. Rows without transitions stay as they are.
    """
    c = F.col
    e = entries.select("root_id", "entry_id", *[c(x).alias(f"e_{x}") for x in ("size", "mtime", "hash", "alg", "content_type", "is_dir")])
    t = transitions.join(e, ["root_id", "entry_id"], "left").withColumn("__at", F.struct(F.coalesce("entry_id", F.lit("")).alias("a"), c("ordinal").alias("b")))
    on = lambda *k: c("kind").isin(*k)
    new = F.struct("e_size", "e_mtime", "e_hash", "e_alg", "e_content_type", "e_is_dir")
    evidence = F.struct("kind", "missing_since", "consecutive", "missing_first", "missing_last")
    per = t.filter("resource_id is not null").groupBy("root_id", "resource_id").agg(
        F.bool_or(on("ADD")).alias("added"),
        F.max_by(F.when(on("ADD", "UPDATE"), new), F.when(on("ADD", "UPDATE"), c("__at"))).alias("attrs"),
        F.max_by(F.when(on("ADD", "RENAME", "MOVE"), c("new_path")), F.when(on("ADD", "RENAME", "MOVE"), c("__at"))).alias("to_path"),
        F.bool_or(on("RESET_REMOVAL_EVIDENCE")).alias("reset"),
        F.max_by(F.when(on("MISSING_EVIDENCE", CANDIDATE, "CONFIRMED_REMOVED"), evidence), F.when(on("MISSING_EVIDENCE", CANDIDATE, "CONFIRMED_REMOVED"), c("__at"))).alias("ev"),
    ).join(generation.select("root_id", "generation"), "root_id", "left")
    m = prior.join(per, ["root_id", "resource_id"], "full")
    upd, moved = c("attrs").isNotNull(), c("to_path").isNotNull()
    removed = F.coalesce(c("ev.kind") == "CONFIRMED_REMOVED", F.lit(False))
    has_ev, reset = c("ev").isNotNull(), F.coalesce("reset", F.lit(False))
    attr = lambda name: F.when(upd, c(f"attrs.e_{name}")).otherwise(c(name)).alias(name)
    return m.select(
        "root_id", "resource_id", F.when(moved, c("to_path")).otherwise(c("path")).alias("path"), F.coalesce("is_dir", "attrs.e_is_dir").alias("is_dir"),
        attr("size"), attr("mtime"), attr("hash"), attr("alg"), attr("content_type"),
        F.when(removed, "REMOVED").otherwise(F.coalesce("presence", F.lit("PRESENT"))).alias("presence"),
        F.when(has_ev, F.when(c("ev.kind") == "MISSING_EVIDENCE", "MISSING_CONFIRMED_BY_COMPLETE_SNAPSHOT").otherwise(CANDIDATE)).when(reset, "NONE").otherwise(F.coalesce("evidence", F.lit("NONE"))).alias("evidence"),
        F.when(has_ev, c("ev.missing_since")).when(~reset, c("missing_since")).alias("missing_since"),
        F.when(has_ev, c("ev.consecutive")).when(reset, 0).otherwise(F.coalesce("consecutive", F.lit(0))).cast("long").alias("consecutive"),
        F.when(has_ev, c("ev.missing_first")).when(~reset, c("missing_first")).alias("missing_first"),
        F.when(has_ev, c("ev.missing_last")).when(~reset, c("missing_last")).alias("missing_last"),
        F.when(upd | moved | reset | removed, c("generation")).otherwise(c("confirmed_generation")).cast("long").alias("confirmed_generation"),
    )


def parents(inventory: DataFrame) -> DataFrame:
    """inventory plus parent_resource_id: the one present directory at the path's directory, else null."""
    one = inventory.filter("presence = 'PRESENT' and is_dir").groupBy("root_id", F.col("path").alias("__dir")).agg(F.count("*").alias("__n"), F.min("resource_id").alias("parent_resource_id")).filter("__n = 1").drop("__n")
    return inventory.withColumn("__dir", dirname(F.col("path"))).join(one, ["root_id", "__dir"], "left").drop("__dir")


def numbered(rows: DataFrame, key: str, *order: str, name: str = "seq") -> DataFrame:
    """rows plus a dense number from 1 per key, in the given order, which must be total. A key's rows are many tasks' work."""
    return ordered.bare(ordered.number(ordered.spread(rows, [key], list(order)), [key], name))


def already_applied(candidates: DataFrame, applied: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates whose whole identity was applied at exactly the root's current generation (a repeat changes nothing)."""
    four = ["traversal_digest", "entry_digest", "context_digest", "evidence_digest"]
    now = applied.join(roots.select("root_id", "generation"), ["root_id", "generation"]).select("root_id", *four)
    return candidates.join(now, ["root_id", *four], "left_semi")


def stale_input(admissions: DataFrame) -> DataFrame:
    """admissions plus stale: its number isn't above the root's highest applied one."""
    top = admissions.filter("status = 'APPLIED'").groupBy("root_id").agg(F.max("seq").alias("__top"))
    return admissions.join(top, "root_id", "left").withColumn("stale", F.coalesce(F.col("seq") <= F.col("__top"), F.lit(False)) & (F.col("status") == "PENDING")).drop("__top")


def next_intra(journal: DataFrame) -> DataFrame:
    """(root_id, generation, next_intra): the next free number inside each generation."""
    return journal.groupBy("root_id", "generation").agg((F.coalesce(F.max("intra_seq"), F.lit(0)) + 1).alias("next_intra"))


def apply_order(journal: DataFrame) -> DataFrame:
    """journal plus apply_order: the place of each event in a root's replay, by generation, number in it, event number."""
    return ordered.bare(ordered.number(ordered.spread(journal, ["root_id"], ["generation", "intra_seq", "event_seq"]), ["root_id"], "apply_order"))


def present_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("root_id").agg(F.count_if(F.col("presence") == "PRESENT").alias("present"))


def last_generation_of(applied: DataFrame) -> DataFrame:
    """The highest generation that each identity was applied at. applied: root_id, identity, generation."""
    return applied.groupBy("root_id", "identity").agg(F.max("generation").alias("generation"))
