"""Check queries of the control loop: rolling polls, watch effects, statistics, discovery, source pages, closed sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import controls, coordinator, cycle, diagnose, identity, latest, work
from ledgerline.plans import kernel_sql
from ledgerline.plans.controls import _ENTRY, _HEAD, _ORDER, _hex
from ledgerline.plans.fixtures import MINUTE, NOW, fixture, with_sql
from ledgerline.plans.ingest import SOUND
from ledgerline.plans.kernel import HORIZON
from ledgerline.plans.reads import _JOURNAL, journal
from ledgerline.plans.works import _watches
from ledgerline.sources import listings

QUERIES: dict = {}
SQL: dict[str, str] = {}
C = F.col


def check(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_LOOP = with_sql("inv_watch") + f""", w AS (SELECT *, failures AS f, interval_s AS i FROM inv_watch),
wk AS (SELECT root_id, scope, CASE f % 4 WHEN 0 THEN 'PENDING' ELSE 'VERIFIED' END AS work_state, f = 5 AS more, CASE WHEN f = 6 THEN 3 END AS claimed_seq, CASE WHEN f = 9 THEN 'THROTTLED' END AS error_class FROM w WHERE f % 3 <> 1),
bg AS (SELECT DISTINCT root_id, CASE WHEN root_id LIKE '%7' THEN '/x' END AS outstanding FROM w),
bd AS (SELECT root_id, scope, CASE WHEN i % 10 = 1 THEN 'other' ELSE scope END AS resource_id, CASE WHEN i % 13 = 0 THEN 'RETIRED' WHEN i % 11 = 0 THEN 'EXPIRED' ELSE 'ACTIVE' END AS lifecycle, f + 1 AS epoch, {NOW} - i * 1000000 AS fresh_at FROM w WHERE i % 5 <> 0),
pr AS (SELECT root_id, scope, scope AS resource_id, i % 7 <> 0 AS valid, {NOW} + CASE WHEN i % 17 = 0 THEN 1 ELSE -1 END AS changed_at FROM w WHERE f <> 4)"""


def _loop(spark, d):
    """(watches, work, budgets, bindings, proofs) projected from the watches."""
    w = _watches(spark, d)
    f, i = C("failures"), C("interval_s")
    key = ["root_id", "scope"]
    work_rows = w.filter(f % 3 != 1).select(*key, F.when(f % 4 == 0, "PENDING").otherwise("VERIFIED").alias("work_state"), F.when(f == 5, F.array(F.lit("RECOVERY"))).alias("sources"), F.when(f == 6, F.lit(3)).alias("claimed_seq"), F.when(f == 9, "THROTTLED").alias("error_class"))
    budgets = w.select("root_id", F.when(C("root_id").endswith("7"), "/x").alias("outstanding")).distinct()
    bindings = w.filter(i % 5 != 0).select(*key, F.when(i % 10 == 1, "other").otherwise(C("scope")).alias("resource_id"), F.when(i % 13 == 0, "RETIRED").when(i % 11 == 0, "EXPIRED").otherwise("ACTIVE").alias("lifecycle"), (f + 1).alias("epoch"), (F.lit(NOW) - i * 1_000_000).alias("fresh_at"))
    proofs = w.filter(f != 4).select(*key, C("scope").alias("resource_id"), (i % 7 != 0).alias("valid"), (F.lit(NOW) + F.when(i % 17 == 0, 1).otherwise(-1)).alias("changed_at"))
    return w, work_rows, budgets, bindings, proofs


@check(
    _LOOP
    + f""", m AS (SELECT w.root_id, w.scope, i AS interval_s, bg.outstanding IS NOT NULL AS out, wk.work_state IS NOT NULL AND (wk.work_state <> 'VERIFIED' OR more OR claimed_seq IS NOT NULL OR error_class IS NOT NULL) AS busy, NOT coalesce(valid, false) OR coalesce(changed_at > {NOW}, true) AS unproven,
  bd.lifecycle IS NOT NULL AND (bd.resource_id IS DISTINCT FROM pr.resource_id OR bd.lifecycle = 'RETIRED') AS other, bd.lifecycle IS NULL AS free FROM w LEFT JOIN wk USING (root_id, scope) LEFT JOIN bg USING (root_id) LEFT JOIN bd USING (root_id, scope) LEFT JOIN pr USING (root_id, scope)),
d AS (SELECT *, CASE WHEN out OR busy OR unproven OR other THEN 'DEFERRED' WHEN root_id LIKE '%3' THEN 'WAIT' ELSE 'EMIT' END AS decision FROM m) SELECT root_id, scope, interval_s, decision, decision = 'EMIT' AND free AS binds FROM d"""
)
def t11_rolling_decisions(spark, d):
    w, work_rows, budgets, bindings, proofs = _loop(spark, d)
    return cycle.rolling_decisions(w.select("root_id", "scope", "interval_s"), work_rows, budgets, bindings, proofs, F.lit(NOW), ~C("root_id").endswith("3"))


@check(
    _LOOP
    + f""", x AS (SELECT watch_state, i, ({NOW} - coalesce(bd.fresh_at, w.fresh_at)) / 1000000 AS age FROM w LEFT JOIN bd USING (root_id, scope) WHERE cadence = 'MIRROR_REVISIT' AND enrolled AND priority = 'NORMAL' AND watch_state = 'WARM')
SELECT (SELECT count(*) FROM x) AS watches, (SELECT count(*) FROM x) AS scheduled, (SELECT coalesce(sum(greatest(0.0, age - i)), 0.0) FROM x) AS debt, (SELECT coalesce(max(greatest(0.0, age - i)), 0.0) FROM x) AS oldest, count(*) AS bindings, count(*) FILTER (WHERE lifecycle = 'EXPIRED') AS expired, count(*) FILTER (WHERE lifecycle = 'RETIRED') AS retired, coalesce(sum(epoch - 1), 0)::BIGINT AS rebindings,
  (SELECT count(outstanding) FROM bg) AS outstanding, 5::BIGINT AS emitted, 2::BIGINT AS deferred FROM bd"""
)
def j14_rolling_stats(spark, d):
    w, _, budgets, bindings, _ = _loop(spark, d)
    return cycle.rolling_stats(w, bindings, budgets, {"emitted": 5, "deferred": 2}, NOW)


@check(
    _LOOP
    + f""", s AS (SELECT *, CASE WHEN f % 5 = 4 THEN NULL WHEN i % 3 = 0 THEN 'STARTED' WHEN i % 3 = 1 THEN 'SUCCEEDED' ELSE 'FAILED' END AS step, CASE WHEN f % 2 = 0 THEN 'ROOT_INACTIVE' ELSE 'THROTTLED' END AS err FROM w)
SELECT root_id, scope, CASE WHEN step = 'STARTED' THEN {NOW} END AS attempt_at, CASE WHEN step IN ('SUCCEEDED', 'FAILED') THEN {NOW} END AS finished_at, CASE WHEN step = 'SUCCEEDED' THEN {NOW} ELSE fresh_at END AS fresh_at, CASE WHEN step = 'SUCCEEDED' THEN 0 WHEN step = 'FAILED' AND err <> 'ROOT_INACTIVE' THEN f + 1 ELSE f END AS failures,
  CASE WHEN step = 'SUCCEEDED' THEN NULL WHEN step = 'FAILED' THEN err ELSE last_error END AS last_error, CASE WHEN step IS NOT NULL THEN 2 ELSE 1 END AS version FROM s"""
)
def x8_watch_effects(spark, d):
    w = _watches(spark, d).withColumns({"attempt_at": F.lit(None).cast("long"), "finished_at": F.lit(None).cast("long"), "version": F.lit(1)})
    f, i = C("failures"), C("interval_s")
    steps = w.select("root_id", "scope", F.array(F.when(f % 5 == 4, "RECOVERY").otherwise("POLL_SCHEDULE")).alias("claimed_sources"), F.when(i % 3 == 0, "STARTED").when(i % 3 == 1, "SUCCEEDED").otherwise("FAILED").alias("step"), F.when(f % 2 == 0, "ROOT_INACTIVE").otherwise("THROTTLED").alias("error_class"))
    return work.watch_effects(w, steps, F.lit(NOW)).select("root_id", "scope", "attempt_at", "finished_at", "fresh_at", "failures", "last_error", "version")


@check(
    """WITH p AS (SELECT page_id, concat('/s', page_id) AS scope, page_id % 6 AS k FROM pages), c AS (SELECT page_id, scope, k, unnest(range(CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 1 END)) AS i FROM p)
SELECT scope, concat('n', CASE WHEN k = 2 THEN 0 ELSE i END) AS name, i = 1 AND k <> 2 AS is_dir, CASE WHEN i = 1 AND k <> 2 THEN NULL ELSE page_id END AS size, CASE WHEN i <> 1 OR k = 2 THEN CASE WHEN page_id % 2 = 0 THEN 'S' ELSE 'm' END END AS hash, CASE WHEN i <> 1 OR k = 2 THEN CASE WHEN page_id % 2 = 0 THEN 'sha1' ELSE 'md5' END END AS alg FROM c WHERE k < 4"""
)
def s6_alist_entries(spark, d):
    return listings.alist_page(_pages(spark, d)).filter("name is not null").select("scope", "name", "is_dir", "size", "hash", "alg")


def _pages(spark, d):
    """A page of a source for each url: empty, sound, with a repeated name, with too many, refused, throttled."""
    k, n = C("page_id") % 6, C("page_id")
    dirs = lambda i: (i == 1) & (k != 2)
    item = lambda i: F.struct(F.concat(F.lit("n"), F.when(k == 2, 0).otherwise(i)).alias("name"), n.alias("size"), dirs(i).alias("is_dir"), F.lit("2024-01-02T03:04:05Z").alias("modified"), F.when(~dirs(i), F.when(n % 2 == 0, F.create_map(F.lit("SHA1"), F.lit("S"), F.lit("md5"), F.lit("m"))).otherwise(F.create_map(F.lit("sha1"), F.lit(""), F.lit("MD5"), F.lit("m")))).alias("hash_info"))
    size = F.when(k == 0, 0).when(k.isin(1, 2), 2).when(k == 3, 4).otherwise(0)
    rows = F.transform(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), item)
    code = F.when(k == 4, 403).when(k == 5, 429).otherwise(200)
    body = F.to_json(F.struct(code.alias("code"), F.struct(rows.alias("content"), F.when(n % 7 == 0, size + 1).otherwise(size).alias("total")).alias("data")))
    return spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("/s"), "page_id").alias("scope"), body.alias("body"))


@check("SELECT concat('/s', page_id) AS scope, CASE page_id % 6 WHEN 4 THEN 'AUTH_OR_PERMISSION' WHEN 5 THEN 'THROTTLED' WHEN 3 THEN 'SCOPE_TOO_LARGE' WHEN 2 THEN 'TRANSIENT_PROVIDER' ELSE CASE WHEN page_id % 7 = 0 THEN 'TRANSIENT_PROVIDER' END END AS error FROM pages")
def s7_page_errors(spark, d):
    return listings.page_error(_pages(spark, d), 3)


_SETS = {"source": "trigger_source", "reason": "trigger_reason", "priority": "priority"}


@check(with_sql("inv_signal") + " " + " UNION ALL ".join(f"SELECT '{c}' AS rule, count(*) FILTER (WHERE {c} NOT IN ({', '.join(repr(x) for x in controls.CLOSED[k])})) AS violations FROM inv_signal" for c, k in _SETS.items()))
def x10_closed_sets(spark, d):
    return controls.violations(fixture(spark, d, "inv_signal"), {c: controls.in_set(C(c), k) for c, k in _SETS.items()})


@check("WITH n AS (SELECT concat('root', c_custkey) AS root_id, c_custkey AS created_at FROM customer) SELECT root_id, created_at, 0::BIGINT AS generation, CASE WHEN created_at % 3 = 0 THEN 'ACTIVE' ELSE 'NEW' END AS lifecycle FROM n")
def x1_create_roots(spark, d):
    """A third of the roots is there already; creating all leaves those as they are."""
    new = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("root"), "c_custkey").alias("root_id"), C("c_custkey").alias("created_at"))
    old = new.filter("created_at % 3 = 0").select("root_id", "created_at", F.lit(0).cast("long").alias("generation"), F.lit("ACTIVE").alias("lifecycle"))
    return controls.create_roots(old, new.unionByName(new))


_OLD = NOW - 10 * MINUTE


@check(
    with_sql("inv_watch")
    + f""", w AS (SELECT concat(root_id, scope) AS root_id, watch_state IN ('DISABLED', 'COLD') AS off, greatest(next_due, coalesce(deferred_until, next_due)) AS due, failures, last_error FROM inv_watch)
SELECT root_id, 'WATCH_DISABLED' AS code, 'WARN' AS status FROM w WHERE off UNION ALL SELECT root_id, 'WATCH_LAG', 'WARN' FROM w WHERE NOT off AND due < {_OLD} UNION ALL SELECT root_id, 'WATCH_DUE', 'OK' FROM w WHERE NOT off AND due BETWEEN {_OLD} AND {NOW} UNION ALL SELECT root_id, 'WATCH_SCHEDULED', 'OK' FROM w WHERE NOT off AND due > {NOW}
UNION ALL SELECT root_id, 'WATCH_FAILURE', 'WARN' FROM w WHERE NOT off AND failures > 0 UNION ALL SELECT root_id, 'SOURCE_UNAVAILABLE', 'WARN' FROM w WHERE NOT off AND failures > 0 AND last_error = 'THROTTLED'"""
)
def k22_watch_checks(spark, d):
    return diagnose.watch_checks(fixture(spark, d, "inv_watch").withColumn("root_id", F.concat("root_id", "scope")), F.lit(NOW), 10 * MINUTE)


@check(
    _JOURNAL
    + """, j AS (SELECT root_id, event_seq, event_type, resource_id, event_seq // 4 AS generation FROM journal WHERE NOT (root_id LIKE '%5' AND event_seq = 2)),
e AS (SELECT root_id, resource_id, arg_max(CASE WHEN event_type = 'resource-removed' THEN 'REMOVED' ELSE 'PRESENT' END, event_seq) AS terminal FROM j WHERE event_type LIKE 'resource-%' GROUP BY 1, 2),
inv AS (SELECT root_id, resource_id, concat('/', right(resource_id, 1)) AS path, CASE WHEN root_id LIKE '%8' THEN 'PRESENT' ELSE terminal END AS presence, terminal FROM e),
r AS (SELECT DISTINCT root_id, 3 AS generation FROM j),
dup AS (SELECT DISTINCT root_id FROM (SELECT root_id, path FROM inv WHERE presence = 'PRESENT' GROUP BY 1, 2 HAVING count(*) > 1)),
bad AS (SELECT root_id FROM inv WHERE presence <> terminal UNION SELECT root_id FROM (SELECT root_id, event_seq - coalesce(lag(event_seq) OVER (PARTITION BY root_id ORDER BY event_seq), 0) AS step FROM j) WHERE step <> 1 UNION SELECT root_id FROM j WHERE generation > 3)
SELECT root_id, CASE WHEN root_id IN (SELECT root_id FROM dup) THEN 'IDENTITY_AMBIGUITY' ELSE 'IDENTITY_CHECK' END AS code, CASE WHEN root_id IN (SELECT root_id FROM dup) THEN 'WARN' ELSE 'OK' END AS status FROM r
UNION ALL SELECT root_id, CASE WHEN root_id IN (SELECT root_id FROM bad) THEN 'CANONICAL_JOURNAL_MISMATCH' ELSE 'BOUNDED_CONSISTENCY' END, CASE WHEN root_id IN (SELECT root_id FROM bad) THEN 'ERROR' ELSE 'OK' END FROM r"""
)
def k22_inventory_checks(spark, d):
    j = journal(spark, d).filter(~(C("root_id").endswith("5") & (C("event_seq") == 2))).withColumn("generation", F.floor(C("event_seq") / 4))
    inv = latest.terminal_presence(j).select("root_id", "resource_id", F.concat(F.lit("/"), F.substring("resource_id", -1, 1)).alias("path"), F.when(C("root_id").endswith("8"), "PRESENT").otherwise(C("terminal")).alias("presence"))
    return diagnose.inventory_checks(inv, j, j.select("root_id", F.lit(3).alias("generation")).distinct())


_FACTS = SOUND | {"snapshot_id": "s1", "observed_at": NOW}
_TOLD = " || ".join(_hex(f"'{_FACTS[k] if _FACTS.get(k) is not None else ''}'") for k in coordinator.FACTS)


@check(
    kernel_sql.SQL["k11_removal_context"].replace(" SELECT root_id, sha256(string_agg(line", " , ctx AS (SELECT root_id, sha256(string_agg(line")
    + f"""), n AS (SELECT (SELECT count(*) FROM inv_prior WHERE root_id = 'root0' AND presence = 'PRESENT') AS p, (SELECT count(*) FROM inv_entries WHERE root_id = 'root0') AS e),
a AS (SELECT CASE WHEN p > 0 AND p > e AND (p - e) / p >= 0.5 THEN 'SUSPICIOUS' ELSE 'COMPLETE' END AS acceptance FROM n),
c AS (SELECT coalesce(max(context), '') AS context FROM ctx WHERE root_id = 'root0')
SELECT 'root0' AS root_id, acceptance, sha256(unhex((SELECT {_HEAD} || string_agg({_ENTRY}, '' ORDER BY {_ORDER}) FROM inv_entries WHERE root_id = 'root0') || {_hex("'evidence'")} || {_TOLD} || {_hex('acceptance')} || {_hex('context')})) AS identity FROM a, c"""
)
def k1_evaluate(spark, d):
    """One root's snapshot: how far it is trusted, and its identity. One root is what a snapshot is of."""
    prior, entries = (fixture(spark, d, f"inv_{x}").filter("root_id = 'root0'") for x in ("prior", "entries"))
    told = coordinator.evaluate(prior, entries, _FACTS, identity.resolve(prior, entries, F.lit(NOW), HORIZON))
    return spark.createDataFrame([("root0", *told)], "root_id string, acceptance string, identity string")
