"""Bounded diagnostics of persisted state: facts per root, coded checks, an overall verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity order of check states, and error classes that a provider causes.
SEVERITY = {"OK": 0, "NOT_TRACKED": 1, "UNKNOWN": 1, "WARN": 2, "ERROR": 2}
SOURCE_ERRORS = ("TRANSIENT_PROVIDER", "THROTTLED", "AUTH_OR_PERMISSION")
STATES = ("PENDING", "IN_FLIGHT", "RETRY_WAIT", "VERIFIED", "BLOCKED", "SUSPENDED")


def work_facts(work: DataFrame) -> DataFrame:
    """Per root: counts by state, oldest due and in-flight times, provider failures, INTERNAL retries at their cap."""
    c = F.col
    due = F.coalesce("not_before", "first_seen")
    return work.groupBy("root_id").agg(
        *[F.count_if(c("work_state") == s).alias(s.lower()) for s in STATES],
        F.min(F.when(c("work_state").isin("PENDING", "RETRY_WAIT"), due)).alias("oldest_due"),
        F.min(F.when(c("work_state") == "IN_FLIGHT", c("started"))).alias("oldest_in_flight"),
        F.count_if((c("failures") > 0) & c("error_class").isin(*SOURCE_ERRORS)).alias("source_failures"),
        F.count_if((c("scope") == "/") & (c("work_state") == "RETRY_WAIT") & (c("error_class") == "INTERNAL") & (c("failures") >= 3)).alias("retry_cap"),
    )


def work_checks(facts: DataFrame, now: Column, stale_after_us: int) -> DataFrame:
    """(root_id, code, status) of the work checks that apply."""
    c = F.col
    old = now - stale_after_us
    rules = [
        ("SOURCE_UNAVAILABLE_WORK", "WARN", c("source_failures") > 0),
        ("BLOCKED_WORK", "WARN", c("blocked") + c("suspended") > 0),
        ("RETRY_BUDGET_EXHAUSTED", "WARN", c("retry_cap") > 0),
        ("RETRY_WAIT", "WARN", c("retry_wait") > 0),
        ("IN_FLIGHT", "UNKNOWN", c("in_flight") > 0),
        ("STALE_IN_FLIGHT", "WARN", c("oldest_in_flight") < old),
        ("WORK_LAG", "WARN", c("oldest_due") < old),
    ]
    return _checks(facts, rules)


def _checks(facts: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    found = F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"))) for code, status, when in rules])
    return facts.select("root_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("root_id", "x.code", "x.status")


def root_checks(roots: DataFrame) -> DataFrame:
    return _checks(roots, [("ROOT_ACTIVE", "OK", F.col("lifecycle") == "ACTIVE"), ("ROOT_INACTIVE", "WARN", F.col("lifecycle") != "ACTIVE")])


def watch_checks(watches: DataFrame, now: Column, stale_after_us: int) -> DataFrame:
    """Checks of root watches (one row per root): root_id, watch_state, next_due, deferred_until, failures, last_error."""
    c = F.col
    off = c("watch_state").isin("DISABLED", "COLD")
    due = F.greatest("next_due", "deferred_until")
    return _checks(
        watches,
        [
            ("WATCH_DISABLED", "WARN", off),
            ("WATCH_LAG", "WARN", ~off & (due < now - stale_after_us)),
            ("WATCH_DUE", "OK", ~off & (due >= now - stale_after_us) & (due <= now)),
            ("WATCH_SCHEDULED", "OK", ~off & (due.isNull() | (due > now))),
            ("WATCH_FAILURE", "WARN", ~off & (c("failures") > 0)),
            ("SOURCE_UNAVAILABLE", "WARN", ~off & (c("failures") > 0) & c("last_error").isin(*SOURCE_ERRORS)),
        ],
    )


def inventory_checks(inventory: DataFrame, journal: DataFrame, roots: DataFrame) -> DataFrame:
    """Ambiguous paths, and whether journal and inventory agree: presence both ways, sequence, generation bound."""
    from ledgerline.operators.latest import gaps, presence_mismatches
    from ledgerline.operators.reader import ambiguous_paths

    dup = ambiguous_paths(inventory).select("root_id").distinct().withColumn("dup", F.lit(True))
    bad = presence_mismatches(inventory, journal).select("root_id").union(gaps(journal).select("root_id"))
    bad = bad.union(journal.join(roots.select("root_id", F.col("generation").alias("__g")), "root_id").filter("generation > __g").select("root_id")).distinct().withColumn("bad", F.lit(True))
    facts = roots.select("root_id").join(dup, "root_id", "left").join(bad, "root_id", "left")
    no = lambda name: F.coalesce(F.col(name), F.lit(False))
    return _checks(facts, [("IDENTITY_AMBIGUITY", "WARN", no("dup")), ("IDENTITY_CHECK", "OK", ~no("dup")), ("CANONICAL_JOURNAL_MISMATCH", "ERROR", no("bad")), ("BOUNDED_CONSISTENCY", "OK", ~no("bad"))])


def overall(checks: DataFrame) -> DataFrame:
    """Per root DEGRADED if any check warns or errs, else UNKNOWN if any is unknown or untracked, else OK."""
    worst = F.max(F.when(F.col("status").isin("WARN", "ERROR"), 2).when(F.col("status").isin("UNKNOWN", "NOT_TRACKED"), 1).otherwise(0))
    return checks.groupBy("root_id").agg(F.when(worst == 2, "DEGRADED").when(worst == 1, "UNKNOWN").otherwise("OK").alias("overall"), F.count("*").alias("n_checks"))
