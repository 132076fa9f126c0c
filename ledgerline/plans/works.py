"""Check queries of work, watches, diagnostics and metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import diagnose, metrics, selectors, work
from ledgerline.plans.fixtures import MINUTE, NOW, fixture, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def at():
    return F.lit(NOW)



def check(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _get(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [fixture(spark, d, n) for n in names]


_RANK = "CASE {0} WHEN 'URGENT' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'NORMAL' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_NAME = "CASE {0} WHEN 4 THEN 'URGENT' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'NORMAL' WHEN 1 THEN 'LOW' END"
_ACTIVE = "root_id IN (SELECT root_id FROM inv_root WHERE lifecycle = 'ACTIVE')"
_OPEN = f"work_state = 'PENDING' AND (not_before IS NULL OR not_before <= {NOW}) AND {_ACTIVE}"
_WORK = with_sql("inv_work", "inv_root", "inv_watch")
_DUE = f"watch_state IN ('HOT', 'WARM') AND next_due <= {NOW} AND (deferred_until IS NULL OR deferred_until <= {NOW})"
_FOLD = f"""SELECT root_id, scope, count(*) AS signal_seq, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons, {_NAME.format('max(' + _RANK.format('priority') + ')')} AS priority,
  min(seen_at) AS first_seen, max(seen_at) AS last_seen, min(not_before) AS not_before FROM inv_signal GROUP BY 1, 2"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("sources", F.array_join("sources", ",")).withColumn("reasons", F.array_join("reasons", ","))


@check(with_sql("inv_signal") + " " + _FOLD)
def t1_coalesce_signals(spark, d):
    return _flat(work.coalesce_signals(fixture(spark, d, "inv_signal")))


@check(with_sql("inv_signal", "inv_root") + f", f AS ({_FOLD}) SELECT f.*, CASE WHEN lifecycle = 'ACTIVE' THEN 'PENDING' ELSE 'SUSPENDED' END AS work_state FROM f JOIN inv_root USING (root_id)")
def t2_new_work(spark, d):
    return _flat(work.new_work(*_get(spark, d, "inv_signal", "inv_root")))


def _state(spark, d) -> DataFrame:
    """Work on scopes of the signals: every second one has a state of its own."""
    s = work.coalesce_signals(fixture(spark, d, "inv_signal").filter("event_id % 2 = 1"))
    n = F.length("scope") + F.substring("scope", -1, 1).cast("int")
    states = F.array(*[F.lit(x) for x in ("PENDING", "VERIFIED", "IN_FLIGHT", "RETRY_WAIT", "BLOCKED", "SUSPENDED")])
    return s.withColumn("work_state", F.element_at(states, n % 6 + 1))


_STATE = f""", st AS (SELECT x.*, (['PENDING', 'VERIFIED', 'IN_FLIGHT', 'RETRY_WAIT', 'BLOCKED', 'SUSPENDED'])[(length(scope) + right(scope, 1)::INT) % 6 + 1] AS work_state FROM ({_FOLD.replace('FROM inv_signal', 'FROM inv_signal WHERE event_id % 2 = 1')}) x),
sg AS ({_FOLD.replace('FROM inv_signal', 'FROM inv_signal WHERE event_id % 2 = 0')}), m AS (SELECT root_id, scope, st.work_state AS w, st.signal_seq AS n, st.sources AS so, st.reasons AS re, st.priority AS pr, st.first_seen AS fs, st.not_before AS nb, st.last_seen AS ls,
  sg.signal_seq AS n2, sg.sources AS so2, sg.reasons AS re2, sg.priority AS pr2, sg.first_seen AS fs2, sg.not_before AS nb2, sg.last_seen AS ls2, lifecycle FROM st FULL JOIN sg USING (root_id, scope) JOIN inv_root USING (root_id)),
k AS (SELECT *, n2 IS NOT NULL AND (w IS NULL OR w = 'VERIFIED') AS opened, n2 IS NOT NULL AS hit FROM m)
SELECT root_id, scope, CASE WHEN opened THEN CASE WHEN lifecycle = 'ACTIVE' THEN 'PENDING' ELSE 'SUSPENDED' END ELSE w END AS work_state, coalesce(n, 0) + coalesce(n2, 0) AS signal_seq,
  CASE WHEN opened THEN so2 WHEN hit THEN array_to_string(list_sort(list_distinct(string_split(so || ',' || so2, ','))), ',') ELSE so END AS sources, CASE WHEN opened THEN re2 WHEN hit THEN array_to_string(list_sort(list_distinct(string_split(re || ',' || re2, ','))), ',') ELSE re END AS reasons,
  CASE WHEN opened THEN pr2 WHEN hit THEN CASE WHEN {_RANK.format('pr')} >= {_RANK.format('pr2')} THEN pr ELSE pr2 END ELSE pr END AS priority, CASE WHEN opened THEN fs2 WHEN hit THEN least(fs, fs2) ELSE fs END AS first_seen,
  CASE WHEN opened THEN nb2 WHEN hit THEN CASE WHEN w IN ('RETRY_WAIT', 'BLOCKED', 'SUSPENDED') THEN nb ELSE least(nb, nb2) END ELSE nb END AS not_before, CASE WHEN opened THEN ls2 WHEN hit THEN greatest(ls, ls2) ELSE ls END AS last_seen FROM k"""


@check(with_sql("inv_signal", "inv_root") + _STATE)
def t1_merge_signals(spark, d):
    signals, roots = _get(spark, d, "inv_signal", "inv_root")
    return _flat(work.merge_signals(_state(spark, d), signals.filter("event_id % 2 = 0"), roots))


@check(_WORK + f" SELECT * FROM inv_work WHERE {_OPEN} ORDER BY {_RANK.format('priority')} DESC, first_seen, root_id, scope LIMIT 20")
def l2_next_work(spark, d):
    w, r = _get(spark, d, "inv_work", "inv_root")
    return selectors.next_work(w, r, at(), 20)


@check(_WORK + f" SELECT * FROM inv_work WHERE {_OPEN} AND priority IN ('NORMAL', 'LOW') AND first_seen <= {NOW - 30_000_000} ORDER BY first_seen, root_id, scope LIMIT 5")
def l7_aged_background(spark, d):
    w, r = _get(spark, d, "inv_work", "inv_root")
    return selectors.aged_background(w, r, at(), F.lit(NOW - 30_000_000), 5)


@check(_WORK + f" SELECT * FROM inv_work WHERE {_OPEN} AND root_id <> 'root5' ORDER BY CASE WHEN root_id > 'root3' THEN 0 ELSE 1 END, root_id, CASE priority WHEN 'HIGH' THEN 0 WHEN 'NORMAL' THEN 1 ELSE 2 END, first_seen, scope LIMIT 5")
def l9_pool_fair(spark, d):
    w, r = _get(spark, d, "inv_work", "inv_root")
    return selectors.fair_pool(w, r, at(), "root3", ["root5"], 5)


_POLICY = "SELECT DISTINCT concat('root', n) AS root_id FROM (SELECT unnest(range(60)) AS n) WHERE n % 3 = 0"


@check(
    _WORK
    + f""" SELECT * FROM inv_work WHERE work_state = 'RETRY_WAIT' AND not_before <= {NOW} AND {_ACTIVE} AND (error_class IN ('TRANSIENT_PROVIDER', 'THROTTLED') OR (error_class = 'INTERNAL' AND scope = '/' AND failures BETWEEN 1 AND 2 AND root_id IN ({_POLICY}) AND root_id IN ({_POLICY.replace('% 3 = 0', '% 2 = 0')}))) ORDER BY not_before, root_id, scope LIMIT 200"""
)
def j10_due_retries(spark, d):
    w, r = _get(spark, d, "inv_work", "inv_root")
    ids = spark.range(60).select(F.concat(F.lit("root"), "id").alias("root_id"), "id")
    watches = ids.filter("id % 3 = 0").select("root_id", F.lit("/").alias("scope"), F.lit("HOT").alias("watch_state"), F.lit("SOURCE_MIRROR").alias("cadence"), F.array(F.lit("OPERATOR_POLICY")).alias("source_set"))
    adapters = ids.filter("id % 2 = 0").select("root_id", F.lit("alist").alias("kind"), F.lit(True).alias("mirror"), F.lit("T").alias("token"), F.lit(None).cast("string").alias("username"), F.lit("").alias("password"))
    return selectors.due_retries(w, r, watches, adapters, at(), 200)


def _watches(spark, d) -> DataFrame:
    w = fixture(spark, d, "inv_watch")
    return w.withColumn("source_set", F.when(F.col("enrolled"), F.array(F.lit("BACKSTOP_ENROLL"))).otherwise(F.array(F.lit("OPERATOR_POLICY")))).drop("enrolled")


_W = "root_id, scope, watch_state, cadence, priority, interval_s, next_due, deferred_until, last_error, failures, fresh_at"
_MANAGED = "(watch_state = 'WARM' AND cadence = 'MIRROR_REVISIT' AND enrolled AND priority = 'NORMAL')"


@check(_WORK + f" SELECT {_W} FROM inv_watch WHERE {_DUE} AND {_ACTIVE} ORDER BY next_due, root_id, scope LIMIT 30")
def l4_due_watches(spark, d):
    return selectors.due_watches(_watches(spark, d), fixture(spark, d, "inv_root"), at(), 30).drop("source_set")


@check(
    _WORK
    + f""", due AS (SELECT *, watch_state = 'WARM' AND cadence = 'MIRROR_REVISIT' AND enrolled AS managed FROM inv_watch WHERE {_DUE} AND {_ACTIVE}),
r AS (SELECT *, row_number() OVER (PARTITION BY managed ORDER BY next_due, root_id, scope) AS pos FROM due), s AS (SELECT *, CASE WHEN pos = 1 AND NOT managed THEN 0 WHEN pos = 1 THEN 1 ELSE 2 END AS band FROM r WHERE pos <= 6)
SELECT {_W}, managed, row_number() OVER (ORDER BY band, next_due, root_id, scope) AS slot FROM s ORDER BY slot LIMIT 6"""
)
def w1_due_fair(spark, d):
    return selectors.due_fair(_watches(spark, d), fixture(spark, d, "inv_root"), at(), 6).drop("source_set")


_BUDGET = "(SELECT DISTINCT root_id, '/d3' AS scope_cursor FROM inv_watch WHERE root_id NOT LIKE '%7')"
_ROLL = f"""(SELECT {_W} FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY CASE WHEN scope > scope_cursor THEN 0 ELSE 1 END, scope) AS n FROM inv_watch JOIN {_BUDGET} USING (root_id) WHERE {_MANAGED} AND {_DUE} AND {_ACTIVE}) WHERE n = 1 ORDER BY CASE WHEN root_id > 'root2' THEN 0 ELSE 1 END, root_id LIMIT 1)"""


def _budgets(spark, d) -> DataFrame:
    return fixture(spark, d, "inv_watch").select("root_id").distinct().select("root_id", F.lit("/d3").alias("scope_cursor"), F.when(F.col("root_id").endswith("7"), "/x").alias("outstanding"))


@check(_WORK + " SELECT * FROM " + _ROLL)
def j13_rolling_pick(spark, d):
    return selectors.rolling_pick(_watches(spark, d), fixture(spark, d, "inv_root"), _budgets(spark, d), at(), "root2").drop("source_set")


@check(
    _WORK
    + f""", o AS (SELECT {_W}, row_number() OVER (ORDER BY next_due, root_id, scope) * 2 AS p FROM inv_watch WHERE NOT {_MANAGED} AND {_DUE} AND {_ACTIVE} ORDER BY next_due, root_id, scope LIMIT 6),
al AS (SELECT * FROM o UNION ALL SELECT *, 3 FROM {_ROLL}) SELECT {_W}, row_number() OVER (ORDER BY p) AS slot FROM al ORDER BY p LIMIT 6"""
)
def l6_due_rolling(spark, d):
    return selectors.due_rolling(_watches(spark, d), fixture(spark, d, "inv_root"), _budgets(spark, d), at(), "root2", 6).drop("source_set")


@check(_WORK + f", p AS (SELECT root_id, scope, 'POLL_SCHEDULE' AS source, 'POSSIBLE_CHANGE' AS reason, priority, {NOW} AS seen_at, NULL::BIGINT AS not_before FROM inv_watch WHERE {_DUE}) SELECT * FROM p")
def t3_due_polls(spark, d):
    return work.due_polls(_watches(spark, d), at())[0]


@check(_WORK + f" SELECT root_id, scope, {_MANAGED} AS managed, {_DUE} AS due, coalesce({_MANAGED} AND last_error IS NULL AND (deferred_until IS NULL OR deferred_until <= {NOW}) AND interval_s <= 3600 AND next_due <= {NOW} + 3600000000, false) AS covers FROM inv_watch")
def p17_watch_predicates(spark, d):
    return _watches(spark, d).select("root_id", "scope", selectors.managed().alias("managed"), selectors.is_due(at()).alias("due"), F.coalesce(selectors.covers(at(), 3600), F.lit(False)).alias("covers"))


_STATES = ", ".join(f"count(*) FILTER (WHERE work_state = '{s}') AS {s.lower()}" for s in diagnose.STATES)
_FACTS = f"""SELECT root_id, {_STATES}, min(coalesce(not_before, first_seen)) FILTER (WHERE work_state IN ('PENDING', 'RETRY_WAIT')) AS oldest_due, min(started) FILTER (WHERE work_state = 'IN_FLIGHT') AS oldest_in_flight,
  count(*) FILTER (WHERE failures > 0 AND error_class IN ('TRANSIENT_PROVIDER', 'THROTTLED', 'AUTH_OR_PERMISSION')) AS source_failures, count(*) FILTER (WHERE scope = '/' AND work_state = 'RETRY_WAIT' AND error_class = 'INTERNAL' AND failures >= 3) AS retry_cap FROM inv_work GROUP BY 1"""


@check(_WORK + " " + _FACTS)
def a11_work_facts(spark, d):
    return diagnose.work_facts(fixture(spark, d, "inv_work"))


_OLD = NOW - 10 * MINUTE


@check(
    _WORK
    + f""", f AS ({_FACTS}), c AS (SELECT root_id, 'SOURCE_UNAVAILABLE_WORK' AS code, 'WARN' AS status FROM f WHERE source_failures > 0 UNION ALL SELECT root_id, 'BLOCKED_WORK', 'WARN' FROM f WHERE blocked + suspended > 0 UNION ALL SELECT root_id, 'RETRY_BUDGET_EXHAUSTED', 'WARN' FROM f WHERE retry_cap > 0
UNION ALL SELECT root_id, 'RETRY_WAIT', 'WARN' FROM f WHERE retry_wait > 0 UNION ALL SELECT root_id, 'IN_FLIGHT', 'UNKNOWN' FROM f WHERE in_flight > 0 UNION ALL SELECT root_id, 'STALE_IN_FLIGHT', 'WARN' FROM f WHERE oldest_in_flight < {_OLD} UNION ALL SELECT root_id, 'WORK_LAG', 'WARN' FROM f WHERE oldest_due < {_OLD}
UNION ALL SELECT root_id, CASE WHEN lifecycle = 'ACTIVE' THEN 'ROOT_ACTIVE' ELSE 'ROOT_INACTIVE' END, CASE WHEN lifecycle = 'ACTIVE' THEN 'OK' ELSE 'WARN' END FROM inv_root) SELECT * FROM c"""
)
def k22_checks(spark, d):
    w, r = _get(spark, d, "inv_work", "inv_root")
    return diagnose.work_checks(diagnose.work_facts(w), at(), 10 * MINUTE).unionByName(diagnose.root_checks(r))


@check(
    SQL["k22_checks"].replace("SELECT * FROM c", "")
    + " SELECT root_id, CASE max(CASE WHEN status IN ('WARN', 'ERROR') THEN 2 WHEN status IN ('UNKNOWN', 'NOT_TRACKED') THEN 1 ELSE 0 END) WHEN 2 THEN 'DEGRADED' WHEN 1 THEN 'UNKNOWN' ELSE 'OK' END AS overall, count(*) AS n_checks FROM c GROUP BY 1"
)
def k22_overall(spark, d):
    return diagnose.overall(k22_checks(spark, d))


@check(with_sql("inv_http") + " SELECT kind, count(*) AS population, count(v) AS observed, count(*) - count(v) AS censored, percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY v) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY v) AS p99, max(v) AS max FROM (SELECT kind, CASE WHEN event_id % 7 <> 0 THEN lasted END AS v FROM inv_http) GROUP BY 1")
def a14_nearest_rank(spark, d):
    return metrics.nearest_rank(fixture(spark, d, "inv_http").select("kind", F.when(F.col("event_id") % 7 != 0, F.col("lasted")).alias("v")), ["kind"], "v")


@check(with_sql("inv_http") + f" SELECT cast(floor((started - {NOW}) / 1000000) AS BIGINT) AS bucket, count(*) AS n FROM inv_http GROUP BY 1")
def a15_arrivals(spark, d):
    return metrics.arrivals(fixture(spark, d, "inv_http"), "started", NOW)


@check(with_sql("inv_http") + ", s AS (SELECT kind, t, d, sum(d) AS s FROM (SELECT kind, started AS t, 1 AS d FROM inv_http UNION ALL SELECT kind, started + lasted * 1000, -1 FROM inv_http) GROUP BY 1, 2, 3), o AS (SELECT kind, sum(s) OVER (PARTITION BY kind ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM s) SELECT kind, max(o)::BIGINT AS peak FROM o GROUP BY 1")
def w5_peak_concurrency(spark, d):
    h = fixture(spark, d, "inv_http").withColumn("finished", F.col("started") + F.col("lasted") * 1000)
    return metrics.peak_concurrency(h, ["kind"], "started", "finished")


@check(
    "WITH c AS (SELECT concat('q', user_id % 97) AS f, event_id, event_type = 'error' AS failed, event_id % 10 AS n, event_id % 1000 AS took FROM events), p AS (SELECT f, min(event_id) AS s, count(*) AS calls, count(*) FILTER (WHERE failed) AS errors, sum(n) AS n, sum(took) AS total, max(took) AS longest FROM c GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY s, f) AS i FROM p) SELECT CASE WHEN i <= 64 THEN f ELSE 'OVERFLOW' END AS key, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, sum(n)::BIGINT AS rows, sum(total)::BIGINT AS total, max(longest) AS longest FROM k GROUP BY 1"
)
def a16_query_cost(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return metrics.query_cost(e.select(F.concat(F.lit("q"), F.col("user_id") % 97).alias("fingerprint"), F.col("event_id").alias("first_seq"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 10).alias("rows"), (F.col("event_id") % 1000).alias("took")))


@check(_WORK + f" SELECT count(*) AS watches, count(*) FILTER (WHERE watch_state = 'WARM') AS scheduled, coalesce(sum(greatest(0.0, ({NOW} - fresh_at) / 1000000 - interval_s)) FILTER (WHERE watch_state = 'WARM'), 0.0) AS debt, coalesce(max(greatest(0.0, ({NOW} - fresh_at) / 1000000 - interval_s)) FILTER (WHERE watch_state = 'WARM'), 0.0) AS oldest FROM inv_watch WHERE cadence = 'MIRROR_REVISIT' AND enrolled AND priority = 'NORMAL'")
def a9_freshness_debt(spark, d):
    w = fixture(spark, d, "inv_watch").filter("cadence = 'MIRROR_REVISIT' and enrolled and priority = 'NORMAL'")
    return metrics.freshness_debt(w, NOW)
