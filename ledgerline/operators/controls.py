"""Decisions of the control plane as relations: dependencies, receipts, coverage, fences, bindings, lifecycles, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.paths import ancestors, dirname, entry_path
from ledgerline.functions.values import blank, comparable_hash
from ledgerline.operators import digests

# Lifecycle steps that are allowed, and those that write an event.
ROOT_STEPS = {("NEW", "ACTIVE"), ("ACTIVE", "DEPRECATED"), ("ACTIVE", "DELETED"), ("DEPRECATED", "DELETED")}
ROOT_EVENTS = {"DEPRECATED": "root-deprecated", "DELETED": "root-deleted"}


# The closed sets of the control plane's columns.
CLOSED = {
    "watch_state": ("HOT", "WARM", "COLD", "DISABLED"),
    "work_state": ("PENDING", "IN_FLIGHT", "VERIFIED", "RETRY_WAIT", "BLOCKED", "SUSPENDED"),
    "priority": ("URGENT", "HIGH", "NORMAL", "LOW"),
    "trigger_source": ("POLL_SCHEDULE", "MUTATION_HINT", "MANUAL_OPERATOR", "PROVIDER_EVENT", "RECOVERY", "FULL_VERIFY_BACKSTOP"),
    "watch_source": ("OPERATOR_POLICY", "ADAPTIVE_POLICY", "MIGRATED", "BACKSTOP_ENROLL"),
    "trigger_reason": ("POSSIBLE_CHANGE", "DELETE_HINT", "MOVE_UNCERTAIN", "METADATA_UNCERTAIN", "MANUAL_VERIFY", "DRIFT_VERIFY", "RETRY"),
    "error_class": ("TRANSIENT_PROVIDER", "THROTTLED", "AUTH_OR_PERMISSION", "SCOPE_TOO_LARGE", "INVALID_SCOPE", "ROOT_INACTIVE", "CONFIG_INVALID", "INTERNAL"),
}


def in_set(value: Column, name: str) -> Column:
    """Whether a value is of the closed set of that name; null for null."""
    return value.isin(*CLOSED[name])


def create_roots(roots: DataFrame, new: DataFrame) -> DataFrame:
    """roots with those of new (root_id, created_at) that aren't there yet, NEW and at generation 0. A root that repeats
    counts once, as the earliest."""
    fresh = new.groupBy("root_id").agg(F.min("created_at").alias("created_at")).join(roots.select("root_id"), "root_id", "left_anti")
    made = fresh.withColumns({"generation": F.lit(0).cast("long"), "lifecycle": F.lit("NEW")})
    return roots.unionByName(made.select(*[c for c in roots.columns if c in made.columns]), allowMissingColumns=True)


def valid_step(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for a, b in sorted(ROOT_STEPS):
        out = out | ((before == a) & (after == b))
    return F.coalesce(out, F.lit(False))


def change_lifecycle(roots: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots after valid requests, events). A valid change always raises the generation; two of them write an event.

    requests: root_id, target, one per root.
    """
    c = F.col
    m = roots.join(requests.select("root_id", "target"), "root_id", "left")
    ok = valid_step(c("lifecycle"), c("target"))
    after = m.select(*[F.when(ok, c("target")).otherwise(c("lifecycle")).alias("lifecycle") if x == "lifecycle" else (c("generation") + F.when(ok, 1).otherwise(0)).alias(x) if x == "generation" else c(x) for x in roots.columns])
    event = F.when(c("target") == "DEPRECATED", ROOT_EVENTS["DEPRECATED"]).when(c("target") == "DELETED", ROOT_EVENTS["DELETED"])
    return after, m.filter(ok).select("root_id", (c("generation") + 1).alias("generation"), event.alias("event_type")).filter("event_type is not null")


def dependencies(inventory: DataFrame, entries: DataFrame) -> DataFrame:
    """Inventory rows that resolving these entries can depend on, each once.

    Same path, below or above an entry's path, same hash, same size, same provider id, or any removal evidence. One
    equi-join or semi-join a clause, united; prefixes go through exploded ancestors, not through a pairwise test.
    """
    c = F.col
    live = inventory.filter("presence = 'PRESENT'").select("root_id", "resource_id", "path", "hash", "size", "provider_id", "evidence")
    e = entries.withColumn("path", entry_path(c("parent_ref"), c("name")))
    ids = ["root_id", "resource_id"]
    own = lambda col: live.filter(c(col).isNotNull()).join(e.filter(c(col).isNotNull()).select("root_id", col).distinct(), ["root_id", col], "left_semi").select(*ids)
    at = e.select("root_id", "path").distinct()
    below = live.select(*ids, F.explode(ancestors(c("path"))).alias("top")).join(at.withColumnRenamed("path", "top"), ["root_id", "top"], "left_semi").select(*ids)
    above = live.join(at.select("root_id", F.explode(ancestors(c("path"))).alias("path")).distinct(), ["root_id", "path"], "left_semi").select(*ids)
    evident = live.filter("evidence <> 'NONE'").join(at.select("root_id").distinct(), "root_id", "left_semi").select(*ids)
    return own("path").union(below).union(above).union(own("hash")).union(own("size")).union(own("provider_id")).union(evident).distinct()


def coverage_ok(listings: DataFrame, now: Column, most: int | None = 10_000) -> DataFrame:
    """Per listing of one directory whether it proves full coverage of its direct children.

    listings: root_id, scope, generation, current_generation, declared, traversal, freshness, observed_at, and one row per
    name. Generation as now, declared count met, names unique, at most `most` (None: however many), observed from two
    minutes ago to thirty seconds ahead, traversal PARTIAL and freshly refreshed.
    """
    c = F.col
    g = listings.groupBy("root_id", "scope").agg(
        F.count("name").alias("n"), F.countDistinct("name").alias("distinct_names"), F.max("declared").alias("declared"), F.max("generation").alias("generation"), F.max("current_generation").alias("current_generation"),
        F.max("traversal").alias("traversal"), F.max("freshness").alias("freshness"), F.max("observed_at").alias("observed_at"), F.bool_or(c("name").contains("/") | c("name").isin("", ".", "..")).alias("bad_name"),
    )
    ok = (
        (c("n") == c("declared")) & (c("n") == c("distinct_names")) & (F.lit(True) if most is None else c("n") <= most) & (c("generation") == c("current_generation")) & (c("traversal") == "PARTIAL") & (c("freshness") == "FRESH_REFRESHED")
        & (c("observed_at") >= now - 120_000_000) & (c("observed_at") <= now + 30_000_000) & ~F.coalesce("bad_name", F.lit(False))
    )
    return g.select("root_id", "scope", "n", F.coalesce(ok, F.lit(False)).alias("covered"))


def receipts(snapshots: DataFrame, admissions: DataFrame, results: DataFrame, applied: DataFrame) -> DataFrame:
    """Snapshots whose lifecycle and records agree: RECONCILED has one admission, one result and one application; REJECTED
    one admission, one result and none; anything else has no result."""
    c = F.col
    count = lambda df, name: df.groupBy("root_id", "snapshot_id").agg(F.count("*").alias(name))
    m = snapshots.join(count(admissions, "n_admissions"), ["root_id", "snapshot_id"], "left").join(count(results, "n_results"), ["root_id", "snapshot_id"], "left").join(count(applied, "n_applied"), ["root_id", "snapshot_id"], "left")
    n = lambda name: F.coalesce(c(name), F.lit(0))
    done = (n("n_admissions") == 1) & (n("n_results") == 1)
    ok = F.when(c("lifecycle") == "RECONCILED", done & (n("n_applied") == 1)).when(c("lifecycle") == "REJECTED", done & (n("n_applied") == 0)).otherwise(n("n_results") == 0)
    return m.select("root_id", "snapshot_id", "lifecycle", ok.alias("consistent"))


def fenced(claims: DataFrame, roots: DataFrame, now: Column) -> DataFrame:
    """Scoped results that may still be committed: the root's generation, frontier, adapter revision and claim epoch are
    those they were read under, and they are from two minutes ago to thirty seconds ahead.

    claims: root_id, scope, generation, frontier, revision, epoch, claimed_epoch, read_at; roots hold the current ones.
    """
    c = F.col
    m = claims.join(roots.select("root_id", *[c(x).alias(f"now_{x}") for x in ("generation", "frontier", "revision")], "lifecycle"), "root_id", "left")
    rules = [
        ("ROOT_INACTIVE", ~F.coalesce(c("lifecycle") == "ACTIVE", F.lit(False))), ("GENERATION", c("generation") != c("now_generation")), ("FRONTIER", c("frontier") != c("now_frontier")), ("ADAPTER", c("revision") != c("now_revision")),
        ("CLAIM", c("epoch") != c("claimed_epoch")), ("EXPIRED", c("read_at") < now - 120_000_000), ("FUTURE", c("read_at") > now + 30_000_000),
    ]
    why = F.coalesce(*[F.when(F.coalesce(when, F.lit(True)), F.lit(code)) for code, when in rules])
    return m.select("root_id", "scope", why.isNull().alias("committable"), why.alias("refused"))


def retire_bindings(bindings: DataFrame, inventory: DataFrame, journal: DataFrame) -> DataFrame:
    """Bindings whose directory the journal shows removed and that no present row holds; with the latest such event.

    bindings: root_id, scope, path, resource_id, lifecycle.
    """
    gone = journal.filter("event_type = 'resource-removed'").groupBy("root_id", "resource_id").agg(F.max("event_seq").alias("proof_seq"))
    removed = inventory.filter("presence = 'REMOVED'").select("root_id", "resource_id")
    live = inventory.filter("presence = 'PRESENT'").select("root_id", "path")
    return bindings.filter("lifecycle <> 'RETIRED'").join(removed, ["root_id", "resource_id"], "left_semi").join(gone, ["root_id", "resource_id"]).join(live, ["root_id", "path"], "left_anti").select("root_id", "scope", "resource_id", "proof_seq")


def step_bindings(bindings: DataFrame, watches: DataFrame, now: Column, lease_us: int) -> DataFrame:
    """Next state of bindings. bindings: root_id, scope, resource_id, path, digest, revision, lifecycle, lease_until, epoch.
    watches: root_id, scope, and the resource, path, digest and revision seen now.

    No binding: BIND. Another identity: REBIND with the next epoch. Past its lease: EXPIRE. Else RENEW. RETIRED stays.
    """
    c = F.col
    four = ["resource_id", "path", "digest", "revision"]
    m = watches.select("root_id", "scope", *[c(x).alias(f"new_{x}") for x in four]).join(bindings, ["root_id", "scope"], "left")
    same = F.lit(True)
    for x in four:
        same = same & c(x).eqNullSafe(c(f"new_{x}"))
    step = F.when(c("lifecycle").isNull(), "BIND").when(c("lifecycle") == "RETIRED", "KEEP").when(~same, "REBIND").when(c("lease_until") < now, "EXPIRE").otherwise("RENEW")
    epoch = F.when(step == "BIND", 1).when(step == "REBIND", c("epoch") + 1).otherwise(c("epoch"))
    lease = F.when(step.isin("BIND", "REBIND", "RENEW"), now + lease_us).otherwise(c("lease_until"))
    return m.select("root_id", "scope", step.alias("step"), epoch.alias("epoch"), lease.alias("lease_until"))


def observation_scope(observations: DataFrame, adapters: DataFrame) -> DataFrame:
    """ROOT, CHILD or UNTRACKED: what an observation looked at, by its provenance and its adapter's base path."""
    c = F.col
    m = observations.join(adapters.select("root_id", "base_path"), "root_id", "left")
    at = lambda key: F.coalesce(F.get_json_object("provenance", f"$.{key}") == c("base_path"), F.lit(False))
    scoped = F.coalesce(F.get_json_object("provenance", "$.mode") == "scoped_refresh", F.lit(False))
    kind = F.when(scoped, F.when(at("scope"), "ROOT").otherwise("CHILD")).when(at("path"), "ROOT").otherwise("UNTRACKED")
    return m.select("root_id", "snapshot_id", kind.alias("observed"))


#: What a digest of entries begins with: a name space and a version, so that digests of two formats never agree.
NAMESPACE, DIGEST_VERSION = "ledgerline/entries", "v2"


def entry_digest(entries: DataFrame, by: str = "root_id", evidence: tuple[str | None, ...] = (), namespace: str = NAMESPACE, version: str = DIGEST_VERSION) -> DataFrame:
    """(by, digest, entries): of a snapshot's entries, which any order of the same entries shares and no other multiset.

    A SHA-256 over length-prefixed fields: name space, version, each entry in a total order of its fields (nulls first,
    false before true, a null string counts as empty), then `evidence` (traversal, error summary, skipped scopes, freshness,
    assurance, corroboration, removal context). Times go in as nanoseconds.
    """
    c = F.col
    text = lambda f: F.coalesce(c(f), F.lit(""))
    mtime = c("mtime") * 1000
    order = [text("parent_ref"), text("name"), F.coalesce("is_dir", F.lit(False)), c("size"), mtime, *[text(f) for f in ("hash", "alg", "content_type", "provider_id", "provider_scope", "assurance")]]
    fields = [digests.tag(F.lit("entry")), digests.tag(c("parent_ref")), digests.tag(c("name")), digests.flag(c("is_dir")), digests.optional(c("size")), digests.optional(mtime)]
    fields += [digests.tag(c(f)) for f in ("hash", "alg", "content_type", "provider_id", "provider_scope", "assurance")]
    tail = b"".join(digests.tag_bytes(x or "") for x in ("evidence", *evidence))
    return digests.stream_digest(entries, by, order, F.concat(*fields), digests.tag_bytes(namespace) + digests.tag_bytes(version), tail).withColumnRenamed("n", "entries")


#: What a directory digest begins with.
DIRECTORY_VERSION = "ledgerline/directory-v1"


def directory_digest(coverage: DataFrame, version: str = DIRECTORY_VERSION) -> DataFrame:
    """coverage (digest, path, adapter_digest, entry_count, topology_digest) plus directory_digest, chained on the entries'
    digest. Generation and clocks fence a decision but aren't part of what was seen, so they don't count."""
    c = F.col
    return coverage.withColumn("directory_digest", F.sha2(F.concat(digests.tag(F.lit(version)), *[digests.tag(c(x)) for x in ("digest", "path", "adapter_digest", "entry_count", "topology_digest")]), 256))


def topology_digest(mounts: DataFrame, drivers: list[str]) -> DataFrame:
    """(root_id, digest, refused) of a root's storage mounts: refused if one nests in another, repeats, or has a driver not allowed.

    Mounts are few per root (they are storage configuration, not content).
    """
    c = F.col
    m = mounts.select("root_id", "mount", "driver")
    repeats = m.groupBy("root_id", "mount").agg(F.count("*").alias("n")).filter("n > 1").select("root_id")
    nested = m.select("root_id", F.explode(ancestors(c("mount"))).alias("mount")).join(m.select("root_id", "mount"), ["root_id", "mount"], "left_semi").select("root_id")
    refused = repeats.union(nested).union(m.filter(~c("driver").isin(*drivers)).select("root_id")).distinct().withColumn("refused", F.lit(True))
    digest = m.groupBy("root_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("mount", "driver")))), 256).alias("digest"))
    return digest.join(refused, "root_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


def violations(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of integrity rules: rows for which a rule is false; null counts as kept."""
    one = table.agg(*[F.count_if(~F.coalesce(v, F.lit(True))).alias(k) for k, v in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("x")).select("x.*")


def inventory_rules() -> dict[str, Column]:
    c = F.col
    return {
        "hash_with_algorithm": c("hash").isNull() == c("alg").isNull(),
        "provider_with_scope": c("provider_id").isNull() == c("provider_scope").isNull(),
        "removed_is_terminal": (c("presence") != "REMOVED") | (c("evidence") != "NONE"),
    }


def watch_rules() -> dict[str, Column]:
    c = F.col
    return {
        "scheduled_has_times": ~c("watch_state").isin("HOT", "WARM") | (c("interval_s").isNotNull() & c("next_due").isNotNull()),
        "cold_has_no_times": ~c("watch_state").isin("COLD", "DISABLED") | (c("interval_s").isNull() & c("next_due").isNull()),
        "known_state": c("watch_state").isin("HOT", "WARM", "COLD", "DISABLED"),
    }


def work_rules() -> dict[str, Column]:
    c = F.col
    return {
        "retry_has_wait": (c("work_state") != "RETRY_WAIT") | c("not_before").isNotNull(),
        "claim_only_in_flight": (c("work_state") == "IN_FLIGHT") == c("started").isNotNull(),
        "known_state": c("work_state").isin("PENDING", "IN_FLIGHT", "RETRY_WAIT", "VERIFIED", "BLOCKED", "SUSPENDED"),
        "known_priority": c("priority").isin("URGENT", "HIGH", "NORMAL", "LOW"),
    }


def schema_difference(required: DataFrame, applied: DataFrame) -> DataFrame:
    """(name, problem): required migrations that are missing, and applied ones that are unknown."""
    return required.select("name").exceptAll(applied.select("name")).withColumn("problem", F.lit("missing")).unionByName(applied.select("name").exceptAll(required.select("name")).withColumn("problem", F.lit("unexpected")))


def replay_floor(cursors: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per root the first event a consumer may start at: after its checkpoint where that meets the floor, else the start."""
    c = F.col
    m = cursors.join(checkpoints, "root_id", "left")
    usable = (c("floor") <= 1) | F.coalesce(c("checkpoint_seq") == c("floor") - 1, F.lit(False))
    return m.select("root_id", "floor", usable.alias("replayable"), F.when(usable, F.greatest(c("last_seq"), F.coalesce("checkpoint_seq", F.lit(0)))).alias("resume_after"))


def parent_directories(entries: DataFrame) -> DataFrame:
    """Directories that entries lie in, with how many lie directly in each."""
    return entries.select("root_id", dirname(entry_path(F.col("parent_ref"), F.col("name"))).alias("scope")).groupBy("root_id", "scope").agg(F.count("*").alias("n"))


def config_digest(kind: Column, config: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit("\0"), blank(config)), 256)


def path_proofs(inventory: DataFrame) -> DataFrame:
    """What the present rows at each path prove of it: how many, whether all are sound directories, the last change, an id."""
    c = F.col
    return inventory.filter("presence = 'PRESENT'").groupBy("root_id", "path").agg(F.count("*").alias("n"), F.bool_and(c("is_dir") & (c("evidence") == "NONE")).alias("good"), F.max("mtime").alias("changed_at"), F.min("resource_id").alias("resource_id"))


def settled(admissions: DataFrame) -> DataFrame:
    """(root_id, n, settled): whether all of a root's admissions have ended."""
    return admissions.groupBy("root_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("status") != "PENDING"), F.lit(False)).alias("settled"))


def observed_hashes(entries: DataFrame) -> DataFrame:
    """How often a snapshot holds each hash that can be compared."""
    return entries.filter(comparable_hash(F.col("hash"), F.col("alg"))).groupBy("root_id", "alg", "hash").agg(F.count("*").alias("n"))
