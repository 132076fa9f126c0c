"""Identity resolution: which prior resource, if any, a snapshot entry is.

The prior inventory is indexed by four aggregates (provider id, path, content hash, size with time), each of one row per
key; entries join them by key and one CASE applies the rules in their order. Nothing is collected or looped over, and a
hot key (a file that is everywhere) is a single index row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.paths import entry_path
from ledgerline.functions.values import MISSING_STATES, STABLE, blank, comparable_hash, hashes_agree, same

# Reason texts that are part of the result.
REASONS = {
    "provider": "R1 provider_object_id",
    "provider_changed": "R10 provider_object_id changed at a continuous path",
    "provider_many": "R1 multiple provider_object_id matches",
    "path_many": "R4 multiple rows at path",
    "path_hash": "R3 same-path content_hash",
    "imposter": "R8 imposter (different content_hash)",
    "copy": "R3 distinct live content copy",
    "move_ambiguous": "R3 ambiguous move observation",
    "move_hash": "R3/R5 cross-path content_hash within horizon",
    "move_late": "R3 cross-path content_hash outside horizon",
    "hash_many": "R3 multiple content_hash matches",
    "path_size_time": "R4 path+size+mtime",
    "time_differs": "R4/R8 same path+size, mtime differs",
    "insufficient": "R4 insufficient (size mismatch or mtime absent)",
    "new": "no candidate -> new resource",
    "move_size_time": "R5 move (size+mtime within horizon, hash absent)",
    "move_many": "R7 multiple moved candidates",
}

CARRIED = ["resource_id", "path", "size", "mtime", "hash", "alg", "content_type", "evidence", "missing_since", "consecutive"]


def resolve(prior: DataFrame, entries: DataFrame, now: Column, horizon_us: int) -> DataFrame:
    """entries plus path, status, reason, and `match`, a struct of the matched prior row (null unless MATCHED).

    status: MATCHED, NEW_RESOURCE, UNRESOLVED or CONFLICT. One prior row may match several entries; each entry keeps its
    row. now: the snapshot's time in microseconds; horizon_us 0 disables move recognition. Keys are per root_id.
    """
    c = F.col
    live = prior.filter("presence = 'PRESENT'").withColumn("__path", blank(c("path")))
    missing = c("evidence").isin(*MISSING_STATES)
    picked = F.struct(*CARRIED)
    some_hash = blank(c("hash")) != ""
    within = lambda since: (F.lit(horizon_us) > 0) & since.isNotNull() & (now - since <= horizon_us)

    by_provider = live.filter((c("assurance") == STABLE) & c("provider_id").isNotNull() & c("provider_scope").isNotNull()).groupBy("root_id", "provider_scope", "provider_id").agg(F.count("*").alias("n_prov"), F.min(picked).alias("prov"))
    by_path = live.groupBy("root_id", c("__path").alias("path")).agg(F.count("*").alias("n_path"), F.min(picked).alias("at_path"), F.min("provider_id").alias("least_prov"), F.max("provider_id").alias("most_prov"))
    by_hash = live.filter(some_hash).groupBy("root_id", blank(c("alg")).alias("__alg"), c("hash").alias("__hash")).agg(F.count("*").alias("n_hash"), F.count_if(missing).alias("n_missing"), F.min(picked).alias("at_hash"))
    by_size = live.filter(missing & c("size").isNotNull() & c("mtime").isNotNull() & within(c("missing_since"))).groupBy("root_id", "size", "mtime").agg(F.count("*").alias("n_moved"), F.min(picked).alias("moved"))

    e = entries.withColumn("path", entry_path(c("parent_ref"), c("name"))).withColumn("__alg", blank(c("alg"))).withColumn("__hash", F.when(comparable_hash(c("hash"), c("alg")), c("hash")))
    seen_path = e.groupBy("root_id", "path").agg(F.count("*").alias("n_seen"))
    seen_hash = e.filter(c("__hash").isNotNull()).groupBy("root_id", "__alg", "__hash").agg(F.count("*").alias("n_seen_hash"))
    j = (
        e.join(by_provider, ["root_id", "provider_scope", "provider_id"], "left")
        .join(by_path, ["root_id", "path"], "left")
        .join(by_hash, ["root_id", "__alg", "__hash"], "left")
        .join(by_size, ["root_id", "size", "mtime"], "left")
        .join(seen_path, ["root_id", "path"], "left")
        .join(seen_hash, ["root_id", "__alg", "__hash"], "left")
        .withColumn("__there", blank(c("at_hash.path")))
        .join(seen_path.select("root_id", c("path").alias("__there"), c("n_seen").alias("n_there")), ["root_id", "__there"], "left")
    )
    n = lambda name: F.coalesce(c(name), F.lit(0))
    hashed = c("__hash").isNotNull()
    stable = F.coalesce(c("assurance") == STABLE, F.lit(False)) & c("provider_id").isNotNull() & c("provider_scope").isNotNull()
    other_provider = F.coalesce((c("least_prov") != c("provider_id")) | (c("most_prov") != c("provider_id")), F.lit(False))
    one = n("n_path") == 1
    live_copies = (n("n_hash") > 0) & (n("n_missing") == 0)
    size_same = same(c("at_path.size"), c("size"))
    times = c("at_path.mtime").isNotNull() & c("mtime").isNotNull()
    nobody = F.lit(None).cast(j.schema["at_path"].dataType)
    rule = lambda status, why, match=nobody: F.struct(F.lit(status).alias("status"), F.lit(REASONS[why]).alias("reason"), match.alias("match"))
    decision = (
        F.when(stable & (n("n_prov") == 1), rule("MATCHED", "provider", c("prov")))
        .when(stable & (n("n_prov") > 1), rule("CONFLICT", "provider_many"))
        .when(stable & other_provider, rule("UNRESOLVED", "provider_changed"))
        .when((n("n_path") > 1) | (n("n_seen") > 1), rule("CONFLICT", "path_many"))
        .when(hashed & one & hashes_agree(c("at_path.hash"), c("at_path.alg"), c("hash"), c("alg")), rule("MATCHED", "path_hash", c("at_path")))
        .when(hashed & one & (blank(c("at_path.hash")) != ""), rule("NEW_RESOURCE", "imposter"))
        .when(hashed & live_copies & ~one, rule("NEW_RESOURCE", "copy"))
        .when(hashed & ~live_copies & (n("n_hash") > 1), rule("CONFLICT", "hash_many"))
        .when(hashed & ~live_copies & (n("n_hash") == 1) & ((n("n_seen_hash") > 1) | (n("n_there") > 0) | one), rule("CONFLICT", "move_ambiguous"))
        .when(hashed & ~live_copies & (n("n_hash") == 1) & within(c("at_hash.missing_since")), rule("MATCHED", "move_hash", c("at_hash")))
        .when(hashed & ~live_copies & (n("n_hash") == 1), rule("UNRESOLVED", "move_late"))
        .when(one & size_same & times & same(c("at_path.mtime"), c("mtime")), rule("MATCHED", "path_size_time", c("at_path")))
        .when(one & size_same & times, rule("UNRESOLVED", "time_differs"))
        .when(one, rule("UNRESOLVED", "insufficient"))
        .when(hashed | (n("n_moved") == 0), rule("NEW_RESOURCE", "new"))
        .when(n("n_moved") == 1, rule("MATCHED", "move_size_time", c("moved")))
        .otherwise(rule("CONFLICT", "move_many"))
    )
    return j.select(*[c(x) for x in entries.columns if x != "path"], "path", decision.alias("__d")).select("*", "__d.*").drop("__d")
