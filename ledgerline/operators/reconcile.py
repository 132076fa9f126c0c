"""Snapshot against inventory: transitions, missing evidence, directory mirrors, counts, removal context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.paths import ancestors, dirname
from ledgerline.functions.values import MISSING_STATES, blank, same
from ledgerline.operators.digests import stream_digest
from ledgerline.operators.identity import resolve

# Kinds that raise the generation, and reason texts.
GENERATION_KINDS = ("ADD", "UPDATE", "RENAME", "MOVE", "CONFIRMED_REMOVED")
FIRST_MISSING = "first MISSING observation (evidence only)"
SAME_SNAPSHOT = "same-snapshot re-admission is not independent confirmation"
ALREADY_COUNTED = "observation already counted; not an independent confirmation"
MISSING = "MISSING in COMPLETE snapshot"
RESET = "observed again; reset removal evidence"
MIRRORED = "source mirror: absent from complete fresh direct-child coverage"


@dataclass(frozen=True)
class Config:
    """Intervals in microseconds. Grace never ends before the horizon; one independent confirmation is all that is supported."""

    removal_grace: int = 0
    move_horizon: int = 0
    min_consecutive: int = 1
    min_independent: int = 1

    def __post_init__(self):
        if self.min_independent > 1:
            raise ValueError("more than one independent confirmation is not supported")
        if self.move_horizon > 0 and self.removal_grace < self.move_horizon:
            raise ValueError("removal_grace must be at least move_horizon")

    @property
    def grace(self) -> int:
        return max(self.removal_grace, self.move_horizon)


COLUMNS = ["root_id", "kind", "ordinal", "resource_id", "entry_id", "new_path", "reason", "missing_since", "consecutive", "missing_first", "missing_last"]


def new_id(root: Column, snapshot: Column, entry: Column) -> Column:
    """Resource id of an ADD: a digest of where it was first seen, so that a retry gives the same one."""
    return F.md5(F.concat_ws("\0", root, snapshot, entry))


def had_evidence(p: Column) -> Column:
    return p["evidence"].isin(*MISSING_STATES) | p["missing_since"].isNotNull() | (p["consecutive"] > 0)


def entry_transitions(resolved: DataFrame) -> DataFrame:
    """Transitions of resolved entries; `ordinal` orders those of one entry: reset, path change, update or unchanged."""
    c, p = F.col, F.col("match")
    matched = c("status") == "MATCHED"
    moved = (blank(p["path"]) != "") & (p["path"] != c("path"))
    changed = ~same(p["size"], c("size")) | ~same(p["mtime"], c("mtime")) | (blank(p["hash"]) != blank(c("hash"))) | (blank(p["content_type"]) != blank(c("content_type")))
    path_kind = F.when(dirname(p["path"]) != dirname(c("path")), "MOVE").otherwise("RENAME")

    def step(ordinal: int, when: Column, kind: Column | str, reason: Column | None, path: Column | None = None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.when(when, F.struct(F.lit(ordinal).alias("ordinal"), kind.alias("kind"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"), (F.lit(None).cast("string") if path is None else path).alias("new_path")))

    steps = F.array(
        step(0, matched & had_evidence(p), "RESET_REMOVAL_EVIDENCE", F.lit(RESET)),
        step(1, matched & moved, path_kind, F.lit("path change"), c("path")),
        step(2, matched & changed, "UPDATE", F.lit("attribute change")),
        step(2, matched & ~moved & ~changed, "UNCHANGED", None),
        step(0, c("status") == "NEW_RESOURCE", "ADD", c("reason"), c("path")),
        step(0, c("status").isin("CONFLICT", "UNRESOLVED"), "CONFLICT", c("reason")),
    )
    rid = F.when(matched, p["resource_id"]).when(c("status") == "NEW_RESOURCE", new_id(c("root_id"), c("snapshot_id"), c("entry_id")))
    return resolved.select("root_id", "entry_id", rid.alias("resource_id"), F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select(
        "root_id", "s.kind", "s.ordinal", "resource_id", "entry_id", "s.new_path", "s.reason",
        F.lit(None).cast("long").alias("missing_since"), F.lit(None).cast("long").alias("consecutive"), F.lit(None).cast("string").alias("missing_first"), F.lit(None).cast("string").alias("missing_last"),
    )


def unobserved(prior: DataFrame, resolved: DataFrame) -> DataFrame:
    """Present prior rows that no entry matched."""
    seen = resolved.filter("status = 'MATCHED'").select("root_id", F.col("match.resource_id").alias("resource_id"))
    return prior.filter("presence = 'PRESENT'").join(seen, ["root_id", "resource_id"], "left_anti")


def missing_transitions(gone: DataFrame, snapshot: Column, now: Column, cfg: Config) -> DataFrame:
    """What a COMPLETE snapshot says about resources it doesn't hold: evidence, a removal candidate, or a removal.

    Only a later snapshot than the first miss confirms; one snapshot never counts twice.
    """
    c = F.col
    first, last = blank(c("missing_first")), c("missing_last")
    fresh, again, counted = first == "", first == snapshot, F.coalesce(last == snapshot, F.lit(False))
    since = F.when(fresh, now).when(again | counted, c("missing_since")).otherwise(F.coalesce(c("missing_since"), now))
    runs = F.when(fresh, F.lit(1)).when(again | counted, c("consecutive")).otherwise(c("consecutive") + 1)
    advance = ~fresh & ~again & ~counted & (runs >= max(1, cfg.min_consecutive))
    over = F.lit(cfg.grace <= 0) | (now - since >= cfg.grace)
    return gone.select(
        "root_id",
        F.when(advance & over, "CONFIRMED_REMOVED").when(advance, "REMOVAL_CANDIDATE").otherwise("MISSING_EVIDENCE").alias("kind"),
        F.lit(0).alias("ordinal"),
        "resource_id",
        F.lit(None).cast("string").alias("entry_id"),
        F.lit(None).cast("string").alias("new_path"),
        F.when(fresh, FIRST_MISSING).when(again, SAME_SNAPSHOT).when(counted, ALREADY_COUNTED).otherwise(MISSING).alias("reason"),
        since.cast("long").alias("missing_since"),
        runs.cast("long").alias("consecutive"),
        F.when(fresh, snapshot).otherwise(c("missing_first")).alias("missing_first"),
        F.when(again | counted, last).otherwise(snapshot).alias("missing_last"),
    )


def reconcile(prior: DataFrame, entries: DataFrame, acceptance: str, cfg: Config, now: Column, snapshot: Column, resolved: DataFrame | None = None) -> DataFrame:
    """Transitions of one accepted snapshot (per root). FAILED gives none; only COMPLETE says anything of what is absent.

    resolved: the entries' resolution where it is known already.
    """
    resolved = resolve(prior, entries, now, cfg.move_horizon) if resolved is None else resolved
    out = entry_transitions(resolved)
    if acceptance == "COMPLETE":
        out = out.unionByName(missing_transitions(unobserved(prior, resolved), snapshot, now, cfg))
    return out.filter(F.lit(acceptance != "FAILED"))


def reconcile_directory(prior: DataFrame, entries: DataFrame, scope: Column, cfg: Config, now: Column, snapshot: Column) -> DataFrame:
    """As reconcile of a PARTIAL snapshot, and removal of what validated full coverage of directory `scope` lacks.

    A direct child without an entry at its path goes, unless matched elsewhere; an absent directory takes its subtree
    along, found by exploding ancestors into an equi-join rather than comparing prefixes pairwise.
    """
    c = F.col
    resolved = resolve(prior, entries, now, cfg.move_horizon)
    gone = unobserved(prior, resolved).filter("path is not null")
    absent = gone.filter(dirname(c("path")) == scope).join(resolved.select("root_id", "path"), ["root_id", "path"], "left_anti")
    dirs = absent.filter("is_dir").select("root_id", c("path").alias("top")).distinct()
    below = gone.select("root_id", "resource_id", F.explode(ancestors(c("path"))).alias("top")).join(dirs, ["root_id", "top"]).select("root_id", "resource_id")
    removed = absent.select("root_id", "resource_id").union(below).distinct()
    mirrored = removed.select(
        "root_id", F.lit("CONFIRMED_REMOVED").alias("kind"), F.lit(0).alias("ordinal"), "resource_id", F.lit(None).cast("string").alias("entry_id"), F.lit(None).cast("string").alias("new_path"),
        F.lit(MIRRORED).alias("reason"), now.cast("long").alias("missing_since"), F.lit(1).cast("long").alias("consecutive"), snapshot.alias("missing_first"), snapshot.alias("missing_last"),
    )
    return entry_transitions(resolved).unionByName(mirrored)


def counts(transitions: DataFrame) -> DataFrame:
    """The eight counters per root; a moved entry with changed attributes counts as both."""
    k = F.col("kind")
    names = {"added": k == "ADD", "updated": k == "UPDATE", "renamed": k == "RENAME", "moved": k == "MOVE", "unchanged": k == "UNCHANGED", "removed": k == "CONFIRMED_REMOVED", "missing_evidence": k.isin("MISSING_EVIDENCE", "REMOVAL_CANDIDATE"), "conflict": k == "CONFLICT"}
    return transitions.groupBy("root_id").agg(*[F.count_if(v).alias(n) for n, v in names.items()], F.bool_or(k.isin(*GENERATION_KINDS)).alias("mutates"))


def removal_context(prior: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per root a digest of what the snapshot decides about removal: reappearing and absent resources with their evidence.

    `context` has the sorted lines' digest, made as a stream.
    """
    c = F.col
    seen = resolved.filter("status = 'MATCHED'").select("root_id", c("match.resource_id").alias("resource_id"), had_evidence(c("match")).alias("reset")).distinct()
    rows = prior.filter("presence = 'PRESENT'").join(seen, ["root_id", "resource_id"], "left").filter("reset is null or reset")
    line = F.concat_ws(
        "|", F.when(c("reset"), "reappears_reset").otherwise("absent"), F.concat(F.lit("rid="), c("resource_id")), F.concat(F.lit("state="), c("evidence")),
        F.concat(F.lit("consec="), c("consecutive").cast("string")), F.concat(F.lit("first="), F.when(blank(c("missing_first")) != "", "1").otherwise("0")),
    )
    return stream_digest(rows, "root_id", [line], line.cast("binary"), between=b"\n").withColumnsRenamed({"digest": "context", "n": "lines"})
