"""Further check queries: work transitions, small aggregates, set functions, projections, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import paths, values
from ledgerline.operators import apply, controls, latest, reader, runtime, selectors, work
from ledgerline.plans.fixtures import MINUTE, NOW, fixture, with_sql
from ledgerline.plans.reads import admissions, journal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def at():
    return F.lit(NOW)

C = F.col


def check(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_JRN = with_sql("inv_journal", "inv_admission") + ", journal AS (SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY made_at, tie) AS event_seq, event_type, resource_id FROM inv_journal), admission AS (SELECT root_id, snapshot_id, status, row_number() OVER (PARTITION BY root_id ORDER BY made_at, tie) AS seq FROM inv_admission)"


@check(_JRN + " SELECT root_id, event_seq // 4 AS generation, coalesce(max(event_seq % 4 + 1), 0) + 1 AS next_intra FROM journal GROUP BY 1, 2")
def a3_next_intra_seq(spark, d):
    j = journal(spark, d).select("root_id", F.floor(C("event_seq") / 4).alias("generation"), (C("event_seq") % 4 + 1).alias("intra_seq"))
    return apply.next_intra(j)


@check(_JRN + " SELECT * FROM (SELECT root_id, event_seq, event_seq // 4 AS generation, event_type, row_number() OVER (PARTITION BY root_id ORDER BY event_seq // 4, event_seq % 4, event_seq) AS apply_order FROM journal)")
def l10_apply_order(spark, d):
    j = journal(spark, d).withColumn("generation", F.floor(C("event_seq") / 4)).withColumn("intra_seq", C("event_seq") % 4)
    return apply.apply_order(j).select("root_id", "event_seq", "generation", "event_type", "apply_order")


@check(with_sql("inv_prior") + " SELECT root_id, count(*) FILTER (WHERE presence = 'PRESENT') AS present FROM inv_prior GROUP BY 1")
def a1_present_count(spark, d):
    return apply.present_counts(fixture(spark, d, "inv_prior"))


@check(with_sql("inv_prior") + " SELECT root_id, path, count(*) AS n, bool_and(is_dir AND evidence = 'NONE') AS good, max(mtime) AS changed_at, min(resource_id) AS resource_id FROM inv_prior WHERE presence = 'PRESENT' GROUP BY 1, 2")
def a7_path_proof(spark, d):
    return controls.path_proofs(fixture(spark, d, "inv_prior"))


@check(_JRN + " SELECT root_id, count(*) AS n, coalesce(bool_and(status <> 'PENDING'), false) AS settled FROM admission GROUP BY 1")
def a8_receipt_flags(spark, d):
    return controls.settled(admissions(spark, d))


@check(with_sql("inv_entries") + " SELECT root_id, alg, hash, count(*) AS n FROM inv_entries WHERE coalesce(hash, '') <> '' AND coalesce(alg, '') <> '' GROUP BY 1, 2, 3")
def a10_observed_hashes(spark, d):
    return controls.observed_hashes(fixture(spark, d, "inv_entries"))


@check(_JRN + " SELECT root_id, seq % 4 AS identity, max(seq) AS generation FROM admission WHERE status = 'APPLIED' GROUP BY 1, 2")
def k17_last_generation_of_identity(spark, d):
    a = admissions(spark, d).filter("status = 'APPLIED'")
    return apply.last_generation_of(a.select("root_id", (C("seq") % 4).alias("identity"), C("seq").alias("generation")))


@check(_JRN + ", s AS (SELECT root_id, max(seq) AS seq FROM admission GROUP BY 1), o AS (SELECT root_id, seq, seq % 3 <> 0 AS ok, seq % 2 = 0 AS shrunk FROM admission), f AS (SELECT root_id, arg_min(shrunk, seq) AS shrunk FROM o WHERE ok GROUP BY 1) SELECT root_id, CASE WHEN s.seq % 5 = 0 OR f.shrunk IS NULL THEN 'NONE' WHEN f.shrunk THEN 'CORROBORATED' ELSE 'CONTRADICTED' END AS corroboration FROM s LEFT JOIN f USING (root_id)")
def k3_derive_corroboration(spark, d):
    a = admissions(spark, d)
    ok = C("seq") % 3 != 0
    obs = a.select("root_id", "seq", ok.alias("fresh"), ok.alias("no_error"), ok.alias("no_skips"), ok.alias("strong"), (C("seq") % 2 == 0).alias("shrunk"))
    return runtime.derive_corroboration(a.groupBy("root_id").agg(F.max("seq").alias("seq")).select("root_id", (C("seq") % 5 != 0).alias("significant")), obs)


@check(_JRN + " SELECT 'root1' AS root_id, 9 AS generation, 1 AS intra_seq, coalesce(max(event_seq), 0) + 1 AS event_seq, 'resource-removed' AS event_type, 'r1' AS resource_id, '{\"reason\":\"repair\"}' AS payload FROM journal WHERE root_id = 'root1'")
def k19_journal_repair(spark, d):
    j = journal(spark, d).withColumn("generation", F.lit(8)).withColumn("intra_seq", C("event_seq"))
    return runtime.repair_event(j, "root1", 9, "resource-removed", "r1", "repair")


@check("SELECT event_id, CASE event_type WHEN 'error' THEN 'RETRY_WAIT' WHEN 'purchase' THEN 'BLOCKED' WHEN 'signup' THEN 'SUSPENDED' ELSE 'BLOCKED' END AS work_state, CASE event_type WHEN 'error' THEN 45 END AS retry_s FROM events")
def p23_error_states(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    cls = F.when(C("event_type") == "error", "THROTTLED").when(C("event_type") == "purchase", "INVALID_SCOPE").when(C("event_type") == "signup", "ROOT_INACTIVE").otherwise("SOMETHING_NEW")
    return e.select("event_id", values.error_state(cls).alias("work_state"), runtime.retry_delay(cls).alias("retry_s"))


@check(with_sql("inv_path") + ", f AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM inv_path) SELECT page_id, starts_with(regexp_replace(p, '/$', '') || '/', '/en/') AS inside FROM f")
def p22_path_within(spark, d):
    return fixture(spark, d, "inv_path").select("page_id", paths.within(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit("/en/")).alias("inside"))


@check(with_sql("inv_prior") + ", k AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent_resource_id FROM inv_prior), r AS (SELECT * FROM k WHERE root_id = 'root0' AND parent_resource_id = '/en' AND presence = 'PRESENT') SELECT resource_id, path FROM r ORDER BY path, resource_id LIMIT 10")
def p4_list_children(spark, d):
    inv = fixture(spark, d, "inv_prior").withColumn("parent_resource_id", F.regexp_replace("path", "/[^/]*$", ""))
    roots = spark.createDataFrame([("root0", "ACTIVE")], "root_id string, lifecycle string")
    return reader.page(reader.list_children(inv, roots, "root0", "/en"), "root0", 1, 10).select("resource_id", "path")


@check(with_sql("inv_prior") + " SELECT to_json(struct_pack(resource_id := resource_id, path := path, size := size)) AS body FROM inv_prior WHERE presence = 'PRESENT'")
def s17_json_rows(spark, d):
    return reader.json_rows(fixture(spark, d, "inv_prior").filter("presence = 'PRESENT'"), "resource_id", "path", "size")


@check(with_sql("inv_entries") + " SELECT root_id, entry_id, row_number() OVER (PARTITION BY root_id ORDER BY parent_ref, name, entry_id) AS place FROM inv_entries")
def s13_entry_scan(spark, d):
    from ledgerline.operators.apply import numbered

    return numbered(fixture(spark, d, "inv_entries"), "root_id", "parent_ref", "name", "entry_id", name="place").select("root_id", "entry_id", "place")


@check(with_sql("inv_signal") + ", a AS (SELECT scope, list_sort(list(DISTINCT source)) AS x FROM inv_signal WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT scope, list_sort(list(DISTINCT source)) AS y FROM inv_signal WHERE event_id % 2 = 1 GROUP BY 1) SELECT scope, array_to_string(list_sort(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))), ',') AS both, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN len(list_filter(x, lambda s: NOT list_contains(y, s))) = 0 END AS subset FROM a FULL JOIN b USING (scope)")
def u3_set_functions(spark, d):
    s = fixture(spark, d, "inv_signal")
    side = lambda k, n: s.filter(f"event_id % 2 = {k}").groupBy("scope").agg(F.array_sort(F.collect_set("source")).alias(n))
    return side(0, "x").join(side(1, "y"), "scope", "full").select("scope", F.array_join(work.union_set(C("x"), C("y")), ",").alias("both"), work.is_subset(C("x"), C("y")).alias("subset"))


def _state(spark, d) -> DataFrame:
    """Work with pending and claimed buckets."""
    w = fixture(spark, d, "inv_work")
    flight, none = C("work_state") == "IN_FLIGHT", F.lit(None)
    both = F.array(F.lit("POLL_SCHEDULE"))
    return w.select(
        "root_id", "scope", "tie", "work_state", (C("tie") % 9 + 1).alias("signal_seq"), F.when(~flight | (C("tie") % 4 == 0), F.array(F.lit("RECOVERY"))).alias("sources"), F.when(~flight, F.array(F.lit("POSSIBLE_CHANGE"))).alias("reasons"), F.when(~flight | (C("tie") % 4 == 0), C("priority")).alias("priority"),
        F.when(~flight, C("first_seen")).alias("first_seen"), F.when(~flight, C("not_before")).alias("not_before"), F.when(flight, both).alias("claimed_sources"), F.when(flight, F.array(F.lit("RETRY"))).alias("claimed_reasons"), F.when(flight, "NORMAL").alias("claimed_priority"), F.when(flight, C("first_seen")).alias("claimed_first_seen"),
        F.when(flight, C("not_before")).alias("claimed_not_before"), F.when(flight, C("tie") % 5 + 1).alias("claimed_seq"), C("first_seen").alias("last_seen"), none.cast("long").alias("verified_at"), none.cast("long").alias("verified_seq"), F.lit(1).alias("attempts"), "failures", "error_class", "started", F.lit(1).alias("version"),
    )


_ST = with_sql("inv_work", "inv_root") + """, s AS (SELECT root_id, scope, tie, work_state, tie % 9 + 1 AS signal_seq, tie % 5 + 1 AS cs, work_state = 'IN_FLIGHT' AS fl, tie % 4 = 0 AS q, priority, first_seen, not_before, failures, error_class, started FROM inv_work)"""
_R = "CASE {0} WHEN 'URGENT' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'NORMAL' THEN 2 ELSE 1 END"


@check(_ST + f" SELECT root_id, scope, tie, CASE WHEN fl THEN CASE WHEN signal_seq > cs THEN 'PENDING' ELSE 'VERIFIED' END ELSE work_state END AS work_state, CASE WHEN fl THEN {NOW} END AS verified_at, CASE WHEN fl THEN cs END AS verified_seq, CASE WHEN fl THEN 0 ELSE failures END AS failures, CASE WHEN fl THEN NULL ELSE error_class END AS error_class, CASE WHEN fl THEN 2 ELSE 1 END AS version FROM s")
def t5_complete(spark, d):
    return work.complete(_state(spark, d), F.lit(True), at()).select("root_id", "scope", "tie", "work_state", "verified_at", "verified_seq", "failures", "error_class", "version")


_SRC = "CASE WHEN fl THEN CASE WHEN q THEN 'POLL_SCHEDULE,RECOVERY' ELSE 'POLL_SCHEDULE' END ELSE 'RECOVERY' END"
_PRI = f"CASE WHEN fl THEN CASE WHEN q AND {_R.format('priority')} > 2 THEN priority ELSE 'NORMAL' END ELSE priority END"


@check(_ST + f" SELECT root_id, scope, tie, CASE WHEN fl THEN 'RETRY_WAIT' ELSE work_state END AS work_state, {_SRC} AS sources, {_PRI} AS priority, CASE WHEN fl THEN greatest({NOW} + 45000000, not_before) ELSE not_before END AS not_before, failures + CASE WHEN fl THEN 1 ELSE 0 END AS failures, CASE WHEN fl THEN 'THROTTLED' ELSE error_class END AS error_class FROM s")
def t6_fail(spark, d):
    out = work.fail(_state(spark, d), F.lit(True), F.lit("THROTTLED"), at() + 45_000_000, at())
    return out.select("root_id", "scope", "tie", "work_state", F.array_join("sources", ",").alias("sources"), "priority", "not_before", "failures", "error_class")


@check(_ST + f", r AS (SELECT s.*, fl AND started < {NOW - 10 * MINUTE} AS back, coalesce(lifecycle = 'ACTIVE', false) AS act FROM s LEFT JOIN inv_root USING (root_id)) SELECT root_id, scope, tie, CASE WHEN back THEN CASE WHEN act THEN 'PENDING' ELSE 'SUSPENDED' END ELSE work_state END AS work_state, CASE WHEN fl AND NOT back THEN NULL ELSE first_seen END AS first_seen, CASE WHEN fl AND NOT back THEN NULL ELSE not_before END AS not_before, failures FROM r")
def t8_recover_stale(spark, d):
    return work.recover_stale(_state(spark, d), fixture(spark, d, "inv_root"), at() - 10 * MINUTE).select("root_id", "scope", "tie", "work_state", "first_seen", "not_before", "failures")


_GO = "coalesce(lifecycle = 'ACTIVE', false)"


@check(_ST + f", r AS (SELECT s.*, work_state = 'RETRY_WAIT' AND not_before <= {NOW} AND {_GO} AS go FROM s LEFT JOIN inv_root USING (root_id)) SELECT root_id, scope, tie, CASE WHEN go THEN 'PENDING' ELSE work_state END AS work_state, CASE WHEN fl OR go THEN NULL ELSE not_before END AS not_before, CASE WHEN go THEN 2 ELSE 1 END AS version FROM r")
def t7_retry_ready(spark, d):
    return work.retry_ready(_state(spark, d), at(), fixture(spark, d, "inv_root")).select("root_id", "scope", "tie", "work_state", "not_before", "version")


@check(_ST + f", r AS (SELECT s.*, work_state = 'SUSPENDED' AND {_GO} AS go FROM s LEFT JOIN inv_root USING (root_id)) SELECT root_id, scope, tie, CASE WHEN go THEN 'PENDING' ELSE work_state END AS work_state, CASE WHEN go THEN 2 ELSE 1 END AS version FROM r")
def t7_resume_suspended(spark, d):
    return work.resume_suspended(_state(spark, d), fixture(spark, d, "inv_root")).select("root_id", "scope", "tie", "work_state", "version")


def _picked(spark, d, state):
    """One row for each scope in a state; every third has been changed meanwhile."""
    w = _state(spark, d).filter(C("work_state") == state)
    return w.groupBy("root_id", "scope").agg(F.min("tie").alias("t")).select("root_id", "scope", F.when(C("t") % 3 == 0, 9).otherwise(1).alias("version"))


_PICK = ", p AS (SELECT root_id, scope, CASE WHEN min(tie) % 3 = 0 THEN 9 ELSE 1 END AS v FROM s WHERE work_state = '{0}' GROUP BY 1, 2)"


@check(_ST + _PICK.format("BLOCKED") + f", r AS (SELECT s.*, work_state = 'BLOCKED' AND coalesce(v = 1, false) AND {_GO} AS go FROM s LEFT JOIN p USING (root_id, scope) LEFT JOIN inv_root USING (root_id)) SELECT root_id, scope, tie, CASE WHEN go THEN 'PENDING' ELSE work_state END AS work_state, CASE WHEN go THEN 2 ELSE 1 END AS version FROM r")
def t7_repair_blocked(spark, d):
    return work.repair_blocked(_state(spark, d), _picked(spark, d, "BLOCKED"), fixture(spark, d, "inv_root")).select("root_id", "scope", "tie", "work_state", "version")


@check(_ST + _PICK.format("PENDING") + f", r AS (SELECT s.*, work_state = 'PENDING' AND coalesce(v = 1, false) AND (not_before IS NULL OR not_before < {NOW}) AS go FROM s LEFT JOIN p USING (root_id, scope)) SELECT root_id, scope, tie, CASE WHEN go THEN {NOW} WHEN fl THEN NULL ELSE not_before END AS not_before, CASE WHEN go THEN 2 ELSE 1 END AS version FROM r")
def t7_budget_defer(spark, d):
    return work.budget_defer(_state(spark, d), _picked(spark, d, "PENDING"), at()).select("root_id", "scope", "tie", "not_before", "version")


@check(
    _ST + _PICK.format("PENDING")
    + f", r AS (SELECT s.*, work_state = 'PENDING' AND coalesce(v = 1, false) AS hit, {_GO} AS act FROM s LEFT JOIN p USING (root_id, scope) LEFT JOIN inv_root USING (root_id)) SELECT root_id, scope, tie, CASE WHEN hit AND act THEN 'IN_FLIGHT' WHEN hit THEN 'SUSPENDED' ELSE work_state END AS work_state, CASE WHEN hit AND act THEN signal_seq WHEN fl THEN cs END AS claimed_seq, CASE WHEN hit AND act THEN NULL WHEN NOT fl OR q THEN 'RECOVERY' END AS sources, CASE WHEN hit AND act THEN 'RECOVERY' WHEN fl THEN 'POLL_SCHEDULE' END AS claimed_sources, CASE WHEN hit AND act THEN 2 ELSE 1 END AS attempts, CASE WHEN hit THEN 2 ELSE 1 END AS version FROM r"
)
def t4_claim(spark, d):
    out = work.claim(_state(spark, d), _picked(spark, d, "PENDING"), at(), fixture(spark, d, "inv_root"))
    return out.select("root_id", "scope", "tie", "work_state", "claimed_seq", F.array_join("sources", ",").alias("sources"), F.array_join("claimed_sources", ",").alias("claimed_sources"), "attempts", "version")


@check(_ST + " SELECT DISTINCT root_id, scope, tie FROM s WHERE fl AND scope = '/w1/' || tie AND cs >= 2")
def t12_background_claims(spark, d):
    w = _state(spark, d)
    b = w.filter("scope = concat('/w1/', tie)").select("root_id", C("scope").alias("outstanding"), F.lit(2).alias("outstanding_seq")).distinct()
    return runtime.background_claims(w, b).select("root_id", "scope", "tie").distinct()


@check(_ST + " SELECT root_id, scope, tie, row_number() OVER (PARTITION BY root_id ORDER BY started, scope, tie) AS place FROM s WHERE fl")
def l12_claim_order(spark, d):
    from ledgerline.operators.apply import numbered

    return numbered(fixture(spark, d, "inv_work").filter("work_state = 'IN_FLIGHT'"), "root_id", "started", "scope", "tie", name="place").select("root_id", "scope", "tie", "place")


@check(with_sql("inv_work") + " SELECT *, (SELECT count(*) <= 12 FROM inv_work WHERE root_id = 'root7') AS whole FROM inv_work WHERE root_id = 'root7' ORDER BY scope, tie LIMIT 12")
def l14_bounded_sample(spark, d):
    rows, whole = selectors.bounded_sample(fixture(spark, d, "inv_work").filter("root_id = 'root7'"), 12, "scope", "tie")
    return rows.withColumn("whole", F.lit(whole))


@check("SELECT event_id, user_id % 50 + 1 AS share, 100 * 8 * 100 / (user_id % 50 + 1)::DOUBLE AS spacing_ms FROM events")
def f25_admission_spacing(spark, d):
    share = C("user_id") % 50 + 1
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", share.alias("share"), values.admission_spacing(100, share).alias("spacing_ms"))


@check(with_sql("inv_snapshot") + " SELECT snapshot_id, CASE WHEN skipped_known_empty THEN 'CONFIRMED_EMPTY' WHEN coalesce(skipped_scopes, '') IN ('', '[]') THEN 'UNKNOWN' ELSE skipped_scopes END AS skipped, coalesce(freshness, 'UNKNOWN') AS freshness, coalesce(assurance, 'UNKNOWN_FAILURE_VISIBILITY') AS assurance, sha256('rclone' || chr(0) || coalesce(skipped_scopes, '')) AS config FROM inv_snapshot")
def f13_defaults(spark, d):
    s = fixture(spark, d, "inv_snapshot")
    return s.select("snapshot_id", values.skipped_form(C("skipped_scopes"), C("skipped_known_empty")).alias("skipped"), values.defaulted(C("freshness"), "UNKNOWN").alias("freshness"), values.defaulted(C("assurance"), "UNKNOWN_FAILURE_VISIBILITY").alias("assurance"), controls.config_digest(F.lit("rclone"), C("skipped_scopes")).alias("config"))


@check("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'POSSIBLE_CHANGE' WHEN 1 THEN 'DELETE_HINT' WHEN 2 THEN 'MOVE_UNCERTAIN' ELSE 'POSSIBLE_CHANGE' END AS reason FROM events WHERE event_id % 5 <> 3")
def t13_hints(spark, d):
    from ledgerline.streaming.signals import hints

    k = C("event_id") % 5
    e = spark.read.parquet(f"{d}/events.parquet").select(C("event_id").cast("string").alias("root_id"), F.lit("/").alias("scope"), F.when(k == 0, "").when(k == 1, "DELETE_HINT").when(k == 2, "MOVE_UNCERTAIN").when(k == 3, "NONSENSE").alias("reason"), F.lit(1).alias("seen_at"))
    return hints(e).select(C("root_id").cast("long").alias("event_id"), "reason")


@check(with_sql("inv_watch") + " SELECT 'scheduled_has_times' AS rule, count(*) FILTER (WHERE watch_state IN ('HOT', 'WARM') AND (interval_s IS NULL OR next_due IS NULL)) AS violations FROM inv_watch UNION ALL SELECT 'cold_has_no_times', count(*) FILTER (WHERE watch_state IN ('COLD', 'DISABLED') AND (interval_s IS NOT NULL OR next_due IS NOT NULL)) FROM inv_watch UNION ALL SELECT 'known_state', 0")
def x9_watch_rules(spark, d):
    return controls.violations(fixture(spark, d, "inv_watch"), controls.watch_rules())


@check(with_sql("inv_prior", "inv_evidence") + ", p AS (SELECT root_id, 'r' || (row_number() OVER (ORDER BY resource_id)) AS resource_id FROM inv_prior), l AS (SELECT resource_id, max(observation_id) AS o, arg_max(provider_id, observation_id) AS provider_id, arg_max(assurance, observation_id) AS assurance FROM inv_evidence GROUP BY 1) SELECT p.resource_id, p.root_id, o AS observation_id, provider_id, assurance FROM p LEFT JOIN l USING (resource_id)")
def j1_inventory_with_evidence(spark, d):
    from pyspark.sql import Window

    p = fixture(spark, d, "inv_prior").select("root_id", F.concat(F.lit("r"), F.row_number().over(Window.orderBy("resource_id"))).alias("resource_id"))
    return latest.with_latest_evidence(p, fixture(spark, d, "inv_evidence")).select("resource_id", "root_id", "observation_id", "provider_id", "assurance")
