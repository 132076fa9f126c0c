"""Dirty-scope work: coalescing signals, claiming, completing, failing, recovering. Batch forms of a keyed state machine.

Work rows: root_id, scope, work_state, signal_seq, sources, reasons, priority, first_seen, not_before (the pending
bucket), claimed_sources, claimed_reasons, claimed_priority, claimed_first_seen, claimed_not_before, claimed_seq (the
claimed one), last_seen, verified_at, verified_seq, attempts, failures, error_class, started, version. Sets are sorted
distinct arrays; a null set is no set, which differs from an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.values import error_state, lookup, priority_rank

RANK_NAME = {4: "URGENT", 3: "HIGH", 2: "NORMAL", 1: "LOW"}
KEEPS_WAIT = ("RETRY_WAIT", "BLOCKED", "SUSPENDED")


def union_set(a: Column, b: Column) -> Column:
    """Sorted distinct union; null only if both are."""
    none = F.array().cast("array<string>")
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none))))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def higher(a: Column, b: Column) -> Column:
    return lookup(F.greatest(priority_rank(a), priority_rank(b)), RANK_NAME)


def coalesce_signals(signals: DataFrame) -> DataFrame:
    """One row per (root, scope): the fold of its signals into a pending bucket.

    Union, maximum, minimum and count don't depend on order, so the fold is one aggregate with partial sums.
    """
    return signals.groupBy("root_id", "scope").agg(
        F.count("*").alias("signal_seq"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
        lookup(F.max(priority_rank(F.col("priority"))), RANK_NAME).alias("priority"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.min("not_before").alias("not_before"),
    )


def new_work(signals: DataFrame, roots: DataFrame) -> DataFrame:
    """Work opened by signals alone: pending on ACTIVE roots, suspended on others."""
    active = roots.select("root_id", (F.col("lifecycle") == "ACTIVE").alias("__a"))
    return coalesce_signals(signals).join(active, "root_id").withColumn("work_state", F.when(F.col("__a"), "PENDING").otherwise("SUSPENDED")).drop("__a")


def merge_signals(work: DataFrame, signals: DataFrame, roots: DataFrame) -> DataFrame:
    """Work after its signals. VERIFIED work starts a new epoch; a wait of RETRY_WAIT, BLOCKED or SUSPENDED work stays.

    Signals of scopes without work open it, those of unknown roots are dropped.
    """
    s = coalesce_signals(signals)
    n = {c: f"s_{c}" for c in s.columns if c not in ("root_id", "scope")}
    active = roots.select("root_id", (F.col("lifecycle") == "ACTIVE").alias("__a"))
    m = work.join(s.withColumnsRenamed(n), ["root_id", "scope"], "full").join(active, "root_id")
    c = F.col
    hit, fresh = c("s_signal_seq").isNotNull(), c("work_state").isNull() | (c("work_state") == "VERIFIED")
    opened, keeps = hit & fresh, c("work_state").isin(*KEEPS_WAIT)
    pick = lambda new, merged, old: F.when(opened, new).when(hit, merged).otherwise(old)
    out = {
        "work_state": F.when(opened, F.when(c("__a"), "PENDING").otherwise("SUSPENDED")).otherwise(c("work_state")),
        "signal_seq": F.coalesce("signal_seq", F.lit(0)) + F.coalesce("s_signal_seq", F.lit(0)),
        "sources": pick(c("s_sources"), union_set(c("sources"), c("s_sources")), c("sources")),
        "reasons": pick(c("s_reasons"), union_set(c("reasons"), c("s_reasons")), c("reasons")),
        "priority": pick(c("s_priority"), higher(c("priority"), c("s_priority")), c("priority")),
        "first_seen": pick(c("s_first_seen"), F.least("first_seen", "s_first_seen"), c("first_seen")),
        "not_before": pick(c("s_not_before"), F.when(keeps, c("not_before")).otherwise(F.least("not_before", "s_not_before")), c("not_before")),
        "last_seen": pick(c("s_last_seen"), F.greatest("last_seen", "s_last_seen"), c("last_seen")),
    }
    return m.select("root_id", "scope", *[out[x].alias(x) if x in out else c(x) for x in work.columns if x not in ("root_id", "scope")])


def claim(work: DataFrame, picked: DataFrame, now: Column, roots: DataFrame | None = None) -> DataFrame:
    """Picked pending rows (root_id, scope, version) go IN_FLIGHT; a row whose version moved on stays as it is. With roots,
    picked rows of a root that isn't ACTIVE are suspended instead."""
    c = F.col
    m = work.join(picked.select("root_id", "scope", c("version").alias("__v")), ["root_id", "scope"], "left")
    m = m.withColumn("__a", F.lit(True)) if roots is None else m.join(roots.select("root_id", (c("lifecycle") == "ACTIVE").alias("__a")), "root_id", "left")
    hit = (c("__v") == c("version")) & (c("work_state") == "PENDING")
    take, off = hit & F.coalesce("__a", F.lit(False)), hit & ~F.coalesce("__a", F.lit(False))
    swap = {"sources": None, "reasons": None, "priority": None, "first_seen": None, "not_before": None}
    out = {x: F.when(take, F.lit(v)).otherwise(c(x)) for x, v in swap.items()}
    out |= {f"claimed_{x}": F.when(take, c(x)).otherwise(c(f"claimed_{x}")) for x in swap}
    out |= {"claimed_seq": F.when(take, c("signal_seq")).otherwise(c("claimed_seq")), "work_state": F.when(take, "IN_FLIGHT").when(off, "SUSPENDED").otherwise(c("work_state")), "attempts": c("attempts") + F.when(take, 1).otherwise(0), "started": F.when(take, now).otherwise(c("started")), "version": c("version") + F.when(hit, 1).otherwise(0)}
    return m.select(*[out[x].alias(x) if x in out else c(x) for x in work.columns])


def _release(work: DataFrame, out: dict, when: Column) -> DataFrame:
    claimed = ["sources", "reasons", "priority", "first_seen", "not_before", "seq"]
    out |= {f"claimed_{x}": F.when(~when, F.col(f"claimed_{x}")) for x in claimed}
    out["version"] = F.col("version") + F.when(when, 1).otherwise(0)
    return work.select(*[out[x].alias(x) if x in out else F.col(x) for x in work.columns])


def complete(work: DataFrame, when: Column, now: Column) -> DataFrame:
    """Claimed work that succeeded: verified, or pending again if signals came meanwhile."""
    c = F.col
    when = when & (c("work_state") == "IN_FLIGHT")
    more = c("signal_seq") > c("claimed_seq")
    return _release(
        work,
        {
            "work_state": F.when(when, F.when(more, "PENDING").otherwise("VERIFIED")).otherwise(c("work_state")), "verified_at": F.when(when, now).otherwise(c("verified_at")), "verified_seq": F.when(when, c("claimed_seq")).otherwise(c("verified_seq")),
            "failures": F.when(when, 0).otherwise(c("failures")), "error_class": F.when(~when, c("error_class")),
        },
        when,
    )


def fail(work: DataFrame, when: Column, error: Column, retry_at: Column, now: Column) -> DataFrame:
    """Claimed work that failed: what was claimed is pending again, in the state that the error leads to.

    A retry waits for the latest of its barriers. ROOT_INACTIVE isn't a failure of the provider.
    """
    c = F.col
    when = when & (c("work_state") == "IN_FLIGHT")
    to = error_state(error)
    wait = F.when(to == "RETRY_WAIT", F.greatest(retry_at, c("claimed_not_before"), c("not_before"), now + 1)).otherwise(F.greatest("claimed_not_before", "not_before"))
    return _release(
        work,
        {
            "work_state": F.when(when, to).otherwise(c("work_state")), "sources": F.when(when, union_set(c("claimed_sources"), c("sources"))).otherwise(c("sources")), "reasons": F.when(when, union_set(c("claimed_reasons"), c("reasons"))).otherwise(c("reasons")),
            "priority": F.when(when, higher(c("claimed_priority"), c("priority"))).otherwise(c("priority")), "first_seen": F.when(when, F.least("claimed_first_seen", "first_seen")).otherwise(c("first_seen")), "not_before": F.when(when, wait).otherwise(c("not_before")),
            "failures": c("failures") + F.when(when & (error != "ROOT_INACTIVE"), 1).otherwise(0), "error_class": F.when(when, error).otherwise(c("error_class")),
        },
        when,
    )


def recover_stale(work: DataFrame, roots: DataFrame, before: Column) -> DataFrame:
    """Claims begun before an instant are given back: a crash is no failure. A claim that could run at once still can."""
    c = F.col
    w = work.join(roots.select("root_id", (c("lifecycle") == "ACTIVE").alias("__a")), "root_id", "left")
    when = (c("work_state") == "IN_FLIGHT") & (c("started") < before)
    wait = F.when(c("claimed_not_before").isNull(), F.lit(None)).otherwise(F.least("claimed_not_before", "not_before"))
    return _release(
        w,
        {
            "work_state": F.when(when, F.when(F.coalesce("__a", F.lit(False)), "PENDING").otherwise("SUSPENDED")).otherwise(c("work_state")), "sources": F.when(when, union_set(c("claimed_sources"), c("sources"))).otherwise(c("sources")), "reasons": F.when(when, union_set(c("claimed_reasons"), c("reasons"))).otherwise(c("reasons")),
            "priority": F.when(when, higher(c("claimed_priority"), c("priority"))).otherwise(c("priority")), "first_seen": F.when(when, F.least("claimed_first_seen", "first_seen")).otherwise(c("first_seen")), "not_before": F.when(when, wait).otherwise(c("not_before")),
        },
        when,
    ).drop("__a")


def _again(work: DataFrame, roots: DataFrame | None, when: Column, not_before: Column | None = None) -> DataFrame:
    """Work that may run again is pending, on ACTIVE roots only."""
    c = F.col
    m = work.withColumn("__a", F.lit(True)) if roots is None else work.join(roots.select("root_id", (c("lifecycle") == "ACTIVE").alias("__a")), "root_id", "left")
    go = F.coalesce(when & c("__a"), F.lit(False))
    out = {"work_state": F.when(go, "PENDING").otherwise(c("work_state"))}
    if not_before is not None:
        out["not_before"] = F.when(go, not_before).otherwise(c("not_before"))
    if "version" in work.columns:
        out["version"] = c("version") + F.when(go, 1).otherwise(0)
    return m.select(*[out[x].alias(x) if x in out else c(x) for x in work.columns])


def retry_ready(work: DataFrame, now: Column, roots: DataFrame | None = None) -> DataFrame:
    """Retries whose wait is over are pending, without a wait."""
    return _again(work, roots, (F.col("work_state") == "RETRY_WAIT") & (F.col("not_before") <= now), F.lit(None).cast("long"))


def resume_suspended(work: DataFrame, roots: DataFrame) -> DataFrame:
    """Suspended work of roots that are ACTIVE again is pending."""
    return _again(work, roots, F.col("work_state") == "SUSPENDED")


def repair_blocked(work: DataFrame, picked: DataFrame, roots: DataFrame) -> DataFrame:
    """Picked blocked rows (root_id, scope, version) are pending: the only way out of BLOCKED."""
    m = work.join(picked.select("root_id", "scope", F.col("version").alias("__v")), ["root_id", "scope"], "left")
    return _again(m, roots, (F.col("work_state") == "BLOCKED") & (F.col("__v") == F.col("version"))).drop("__v")


def budget_defer(work: DataFrame, picked: DataFrame, until: Column) -> DataFrame:
    """Picked pending rows (root_id, scope, version) wait until an instant; a later wait stays."""
    c = F.col
    m = work.join(picked.select("root_id", "scope", c("version").alias("__v")), ["root_id", "scope"], "left")
    hit = F.coalesce((c("__v") == c("version")) & (c("work_state") == "PENDING") & (c("not_before").isNull() | (c("not_before") < until)), F.lit(False))
    out = {"not_before": F.when(hit, until).otherwise(c("not_before")), "version": c("version") + F.when(hit, 1).otherwise(0)}
    return m.select(*[out[x].alias(x) if x in out else c(x) for x in work.columns])


def watch_effects(watches: DataFrame, work: DataFrame, now: Column) -> DataFrame:
    """watches after what befell the work of their scopes. work: root_id, scope, claimed_sources, step (STARTED, SUCCEEDED,
    FAILED), error_class. Only work that the poll schedule asked for counts; a root that is not active is no failure of the
    provider. watches: attempt_at, finished_at, fresh_at, failures, last_error, version and whatever else."""
    c = F.col
    polled = work.filter(F.array_contains("claimed_sources", "POLL_SCHEDULE")).select("root_id", "scope", c("step").alias("__step"), c("error_class").alias("__error"))
    m = watches.join(polled, ["root_id", "scope"], "left")
    on = lambda step: F.coalesce(c("__step") == step, F.lit(False))
    ok, bad = on("SUCCEEDED"), on("FAILED")
    out = {
        "attempt_at": F.when(on("STARTED"), now).otherwise(c("attempt_at")),
        "finished_at": F.when(ok | bad, now).otherwise(c("finished_at")),
        "fresh_at": F.when(ok, now).otherwise(c("fresh_at")),
        "failures": F.when(ok, 0).otherwise(c("failures") + F.when(bad & (c("__error") != "ROOT_INACTIVE"), 1).otherwise(0)),
        "last_error": F.when(ok, None).when(bad, c("__error")).otherwise(c("last_error")),
        "version": c("version") + F.when(c("__step").isNotNull(), 1).otherwise(0),
    }
    return m.select(*[out[x].alias(x) if x in out else c(x) for x in watches.columns])


def due_polls(watches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(signals of due watches, watches with their next due time). Missed ticks collapse: the next is now + interval."""
    from ledgerline.operators.selectors import is_due

    signals = watches.filter(is_due(now)).select("root_id", "scope", F.lit("POLL_SCHEDULE").alias("source"), F.lit("POSSIBLE_CHANGE").alias("reason"), "priority", now.alias("seen_at"), F.lit(None).cast("long").alias("not_before"))
    return signals, watches.withColumn("next_due", F.when(is_due(now), now + F.col("interval_s") * 1_000_000).otherwise(F.col("next_due")))


def child_signals(verified: DataFrame, entries: DataFrame, now: Column, priority_top: str | None = None) -> DataFrame:
    """Signals for the directories directly below verified scopes: at most eight levels deep, each once."""
    from ledgerline.functions.paths import depth, dirname, is_below

    tops = verified.select("root_id", F.col("scope").alias("__up"))
    kids = entries.filter("is_dir").select("root_id", F.col("path").alias("scope"), dirname(F.col("path")).alias("__up")).join(tops, ["root_id", "__up"], "left_semi").select("root_id", "scope").distinct()
    high = F.lit(False) if priority_top is None else (F.col("scope") == priority_top) | is_below(F.col("scope"), F.lit(priority_top))
    return kids.filter(depth(F.col("scope")) <= 8).select("root_id", "scope", F.lit("RECOVERY").alias("source"), F.lit("POSSIBLE_CHANGE").alias("reason"), F.when(high, "HIGH").otherwise("NORMAL").alias("priority"), now.alias("seen_at"), F.lit(None).cast("long").alias("not_before"))


def admit_children(children: DataFrame, now: Column, interval_s: int) -> DataFrame:
    """children plus verdict: what a mirror does with each child scope; all but the reused and the queued are merged.

    children: root_id, scope, child_priority, proof_ok, changed_at, and the child's watch (watch_* columns as in
    selectors.covers) and work (work_state null for none, verified_at, verified_seq, signal_seq, attempts, error_class,
    work_priority, not_before).
    """
    from ledgerline.functions.paths import depth
    from ledgerline.operators.selectors import covers

    c = F.col
    unsure = ~F.coalesce("proof_ok", F.lit(False)) | F.coalesce(c("changed_at") > now, F.lit(True)) | (depth(c("scope")) > 8)
    covered = F.coalesce(covers(now, interval_s), F.lit(False))
    sound = c("verified_at").isNotNull() & (F.coalesce("verified_seq", F.lit(0)) > 0) & (c("verified_seq") <= c("signal_seq")) & (c("attempts") > 0) & c("error_class").isNull()
    queued = c("error_class").isNull() & (priority_rank(c("work_priority")) >= priority_rank(c("child_priority"))) & (c("not_before").isNull() | (c("not_before") <= now))
    verdict = (
        F.when(c("child_priority") != "NORMAL", "EXPLICIT")
        .when(unsure, "UNCERTAIN")
        .when(c("work_state").isNull(), "NEW")
        .when(~covered, "UNCERTAIN")
        .when(F.coalesce(c("verified_at") > now, F.lit(False)), "UNCERTAIN")
        .when(F.coalesce(c("changed_at") > c("verified_at"), F.lit(False)), "CHANGED")
        .when((c("work_state") == "VERIFIED") & sound, "VERIFIED_REUSED")
        .when(c("work_state") == "VERIFIED", "UNCERTAIN")
        .when((c("work_state") == "PENDING") & queued, "ALREADY_QUEUED")
        .when((c("work_state") == "PENDING") & c("verified_at").isNull(), "UNVERIFIED")
        .otherwise("PROTECTED")
    )
    return children.withColumn("verdict", verdict)
