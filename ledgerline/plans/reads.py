"""Check queries of the read API, latest rows, sequences, evidence and paths, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import paths, values
from ledgerline.operators import apply, evidence, latest, reader
from ledgerline.plans.fixtures import NOW, fixture, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_DIR = "CASE WHEN strpos({0}, '/') = 0 THEN '.' WHEN regexp_replace({0}, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace({0}, '/[^/]*$', '') END"
VIEW = ", ".join(reader.VIEW[:4] + ["size", "mtime", "hash", "content_type", "presence", "confirmed_generation"])


def check(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _inv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf_dir, "inv_prior"), fixture(spark, sf_dir, "inv_root")


@check(with_sql("inv_root") + " SELECT * FROM inv_root WHERE root_id = 'root20' AND lifecycle IN ('NEW', 'ACTIVE', 'DEPRECATED', 'DELETED')")
def p1_get_root(spark, d):
    return reader.get_root(fixture(spark, d, "inv_root"), "root20", deprecated=True, deleted=True)


@check(with_sql("inv_root") + " SELECT * FROM inv_root WHERE lifecycle IN ('NEW', 'ACTIVE', 'DEPRECATED')")
def p2_list_roots(spark, d):
    return reader.list_roots(fixture(spark, d, "inv_root"), deprecated=True)


@check(with_sql("inv_prior", "inv_root") + f" SELECT {VIEW} FROM inv_prior WHERE resource_id = md5('r44') AND presence = 'PRESENT' AND root_id IN (SELECT root_id FROM inv_root WHERE lifecycle IN ('NEW', 'ACTIVE', 'DEPRECATED', 'DELETED'))")
def p3_get_resource(spark, d):
    inv, roots = _inv(spark, d)
    import hashlib

    return reader.get_resource(inv, roots, hashlib.md5(b"r44").hexdigest(), deprecated=True, deleted=True)


@check(
    with_sql("inv_path")
    + f""", f AS (SELECT page_id, {_PATH} AS path FROM inv_path), inv AS (SELECT concat('p', page_id) AS resource_id, 'root' AS root_id, regexp_replace(path, '/$', '') AS path, false AS is_dir, 'PRESENT' AS presence FROM f),
dirs AS (SELECT concat('d', {_DIR.format('path')}) AS resource_id, 'root' AS root_id, {_DIR.format('path')} AS path, true AS is_dir, 'PRESENT' AS presence FROM inv GROUP BY ALL),
al AS (SELECT * FROM inv UNION ALL SELECT * FROM dirs), one AS (SELECT root_id, path, min(resource_id) AS rid FROM al WHERE is_dir GROUP BY 1, 2 HAVING count(*) = 1)
SELECT al.resource_id, al.path, one.rid AS parent_resource_id FROM al LEFT JOIN one ON one.root_id = al.root_id AND one.path = {_DIR.format('al.path')}"""
)
def j19_parents(spark, d):
    rows = fixture(spark, d, "inv_path").select(F.concat(F.lit("p"), "page_id").alias("resource_id"), F.lit("root").alias("root_id"), F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "/$", "").alias("path"), F.lit(False).alias("is_dir"), F.lit("PRESENT").alias("presence"))
    dirs = rows.select(F.concat(F.lit("d"), paths.dirname(F.col("path"))).alias("resource_id"), "root_id", paths.dirname(F.col("path")).alias("path"), F.lit(True).alias("is_dir"), "presence").distinct()
    return apply.parents(rows.unionByName(dirs)).select("resource_id", "path", "parent_resource_id")


@check(with_sql("inv_prior", "inv_root") + f", r AS (SELECT * FROM inv_prior WHERE root_id = 'root40' AND path = '/dup/40' AND root_id IN (SELECT root_id FROM inv_root)) SELECT {VIEW}, (SELECT count(*) > 1 FROM r) AS ambiguous FROM r")
def p5_resolve_path(spark, d):
    inv, roots = _inv(spark, d)
    return reader.resolve_path(inv, roots, "root40", "/dup/40", removed=True, deprecated=True, deleted=True)


@check(with_sql("inv_prior") + " SELECT root_id, path, count(*) AS n FROM inv_prior WHERE presence = 'PRESENT' GROUP BY 1, 2 HAVING count(*) > 1")
def a12_ambiguous_paths(spark, d):
    return reader.ambiguous_paths(fixture(spark, d, "inv_prior"))


@check(with_sql("inv_prior", "inv_root") + " SELECT * FROM inv_prior WHERE presence = 'PRESENT' AND root_id IN (SELECT root_id FROM inv_root WHERE lifecycle IN ('NEW', 'ACTIVE'))")
def p6_active(spark, d):
    return reader.active(*_inv(spark, d))


@check(with_sql("inv_prior", "inv_root") + " SELECT * FROM inv_prior WHERE presence = 'REMOVED' AND root_id IN (SELECT root_id FROM inv_root)")
def p7_removed(spark, d):
    return reader.removed(*_inv(spark, d))


@check(with_sql("inv_prior") + " SELECT * FROM inv_prior WHERE root_id = 'root0' AND (coalesce(path, ''), resource_id) > ('/en/1', 'a') ORDER BY coalesce(path, ''), resource_id LIMIT 25")
def l1_keyset_page(spark, d):
    return reader.page(fixture(spark, d, "inv_prior"), "root0", 7, 25, reader.encode_cursor("root0", 7, "/en/1", "a"))


_JOURNAL = with_sql("inv_journal", "inv_admission", "inv_root") + ", journal AS (SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY made_at, tie) AS event_seq, event_type, resource_id FROM inv_journal), admission AS (SELECT root_id, snapshot_id, status, row_number() OVER (PARTITION BY root_id ORDER BY made_at, tie) AS seq FROM inv_admission)"


def journal(spark, d) -> DataFrame:
    return apply.numbered(fixture(spark, d, "inv_journal"), "root_id", "made_at", "tie", name="event_seq").select("root_id", "event_seq", "event_type", "resource_id")


def admissions(spark, d) -> DataFrame:
    return apply.numbered(fixture(spark, d, "inv_admission"), "root_id", "made_at", "tie").select("root_id", "snapshot_id", "status", "seq")


@check(_JOURNAL + " SELECT * FROM journal WHERE root_id = 'root1' AND event_seq > 3 ORDER BY event_seq LIMIT 5")
def p8_read_journal(spark, d):
    return reader.read_journal(journal(spark, d), "root1", 3, 5)


@check(_JOURNAL + " SELECT inv_root.*, s AS applied_seq FROM inv_root LEFT JOIN (SELECT root_id, max(seq) AS s FROM admission WHERE status = 'APPLIED' GROUP BY 1) USING (root_id)")
def p9_root_status(spark, d):
    return reader.root_status(fixture(spark, d, "inv_root"), admissions(spark, d))


@check(_JOURNAL + " SELECT * FROM journal")
def w3_journal_sequence(spark, d):
    return journal(spark, d)


@check(_JOURNAL + " SELECT root_id, max(event_seq) AS last_seq, coalesce(max(event_seq), 0) + 1 AS next_seq FROM journal GROUP BY 1")
def a2_sequence_bounds(spark, d):
    return latest.sequence_bounds(journal(spark, d), seq="event_seq")


@check(_JOURNAL + " SELECT root_id, min(seq) AS seq, arg_min(snapshot_id, seq) AS snapshot_id FROM admission WHERE status = 'PENDING' GROUP BY 1")
def a4_head_of_line(spark, d):
    return latest.head_of_line(admissions(spark, d))


@check(_JOURNAL + " SELECT DISTINCT root_id FROM admission WHERE status = 'PENDING'")
def a5_pending_roots(spark, d):
    return latest.pending_roots(admissions(spark, d))


@check(_JOURNAL + ", holes AS (SELECT * FROM journal WHERE event_seq % 5 <> 2) SELECT * FROM (SELECT *, coalesce(lag(event_seq) OVER (PARTITION BY root_id ORDER BY event_seq), 0) AS previous FROM holes) WHERE event_seq <> previous + 1")
def w4_sequence_gaps(spark, d):
    return latest.gaps(journal(spark, d).filter("event_seq % 5 <> 2"))


@check(_JOURNAL + " SELECT root_id, resource_id, max(event_seq) AS event_seq, CASE WHEN arg_max(event_type, event_seq) = 'resource-removed' THEN 'REMOVED' ELSE 'PRESENT' END AS terminal FROM journal GROUP BY 1, 2")
def a13_terminal_presence(spark, d):
    return latest.terminal_presence(journal(spark, d))


@check(
    _JOURNAL
    + """, term AS (SELECT root_id, resource_id, CASE WHEN arg_max(event_type, event_seq) = 'resource-removed' THEN 'REMOVED' ELSE 'PRESENT' END AS terminal FROM journal GROUP BY 1, 2),
inv AS (SELECT root_id, resource_id, 'PRESENT' AS presence FROM journal WHERE event_seq % 3 <> 0 GROUP BY 1, 2) SELECT * FROM inv FULL JOIN term USING (root_id, resource_id) WHERE presence IS DISTINCT FROM terminal"""
)
def a13_presence_mismatches(spark, d):
    j = journal(spark, d)
    return latest.presence_mismatches(j.filter("event_seq % 3 <> 0").select("root_id", "resource_id", F.lit("PRESENT").alias("presence")).distinct(), j)


@check(with_sql("inv_evidence") + " SELECT resource_id, max(observation_id) AS observation_id, arg_max(provider_id, observation_id) AS provider_id, arg_max(assurance, observation_id) AS assurance FROM inv_evidence GROUP BY 1")
def j1_latest_evidence(spark, d):
    return latest.latest(fixture(spark, d, "inv_evidence"), ["resource_id"], "observation_id", ["provider_id", "assurance"])


@check(_JOURNAL + " SELECT root_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(snapshot_id) END AS admit, count(*) > 1 AS ambiguous FROM admission a WHERE NOT EXISTS (SELECT 1 FROM admission b WHERE b.status <> 'PENDING' AND b.snapshot_id = a.snapshot_id AND b.root_id = a.root_id) GROUP BY 1")
def j16_unadmitted(spark, d):
    a = admissions(spark, d)
    return latest.unadmitted_by_root(latest.unadmitted(a.select("root_id", "snapshot_id"), a.filter("status <> 'PENDING'")))


@check(_JOURNAL + " SELECT admission.*, coalesce(seq <= top, false) AND status = 'PENDING' AS stale FROM admission LEFT JOIN (SELECT root_id, max(seq) AS top FROM admission WHERE status = 'APPLIED' GROUP BY 1) USING (root_id)")
def t19_stale_input(spark, d):
    return apply.stale_input(admissions(spark, d))


_RUNS = """, obs AS (SELECT root_id, resource_id, event_seq AS seq, event_seq * 10 AS "at", event_type = 'resource-removed' AS missing FROM journal),
i AS (SELECT *, sum(CASE WHEN missing THEN 0 ELSE 1 END) OVER (PARTITION BY root_id, resource_id ORDER BY seq) AS island FROM obs)
SELECT root_id, resource_id, seq, "at", missing, (sum(CASE WHEN missing THEN 1 ELSE 0 END) OVER w)::BIGINT AS consecutive, CASE WHEN missing THEN min(CASE WHEN missing THEN "at" END) OVER w END AS missing_since FROM i WINDOW w AS (PARTITION BY root_id, resource_id, island ORDER BY seq)"""


@check(_JOURNAL.replace("concat('r', cast(o_orderkey % 50 AS VARCHAR(20)))", "concat('r', cast(o_orderkey % 2 AS VARCHAR(20)))") + _RUNS)
def w8_missing_runs(spark, d):
    rows = fixture(spark, d, "inv_journal").withColumn("resource_id", F.concat(F.lit("r"), (F.col("tie") % 2).cast("string")))
    j = apply.numbered(rows, "root_id", "made_at", "tie", name="event_seq")
    return latest.missing_runs(j.select("root_id", "resource_id", F.col("event_seq").alias("seq"), (F.col("event_seq") * 10).alias("at"), (F.col("event_type") == "resource-removed").alias("missing")))


_FRESH = "coalesce(freshness, 'UNKNOWN')"
_ASSURE = "coalesce(assurance, 'UNKNOWN_FAILURE_VISIBILITY')"


@check(
    with_sql("inv_snapshot")
    + f""" SELECT snapshot_id, CASE WHEN traversal = 'FAILED' THEN 'FAILED' WHEN traversal IN ('INTERRUPTED', 'PARTIAL') THEN 'PARTIAL' WHEN error_summary IS NOT NULL THEN 'PARTIAL' WHEN coalesce(skipped_scopes, '') NOT IN ('', '[]') THEN 'PARTIAL'
  WHEN {_FRESH} = 'STALE' OR ({_FRESH} = 'UNKNOWN' AND used_cache) THEN 'STALE' WHEN prior_present > 0 AND prior_present > entries AND (prior_present - entries) * 2 >= prior_present AND coalesce(corroboration, '') <> 'CORROBORATED' THEN 'SUSPICIOUS'
  WHEN prior_present > 0 AND entries = 0 THEN 'SUSPICIOUS' WHEN skipped_known_empty AND {_FRESH} IN ('FRESH_DIRECT', 'FRESH_REFRESHED', 'CACHED_FRESH') AND {_ASSURE} = 'STRONG_FAILURE_VISIBILITY' THEN 'COMPLETE'
  WHEN {_ASSURE} <> 'STRONG_FAILURE_VISIBILITY' THEN 'SUSPICIOUS' ELSE 'PARTIAL' END AS acceptance FROM inv_snapshot"""
)
def p13_completeness(spark, d):
    return evidence.acceptance(fixture(spark, d, "inv_snapshot")).select("snapshot_id", "acceptance")


@check(with_sql("inv_snapshot") + " SELECT snapshot_id, prior_present > 0 AND prior_present > entries AND (prior_present - entries) * 2 >= prior_present AS shrunk FROM inv_snapshot")
def p14_shrink(spark, d):
    return fixture(spark, d, "inv_snapshot").select("snapshot_id", F.coalesce(evidence.shrink(F.col("prior_present"), F.col("entries")), F.lit(False)).alias("shrunk"))


_CORR = """, s AS (SELECT concat('root', admission_seq % 40) AS root_id, snapshot_id, admission_seq, CASE WHEN admission_seq % 8 = 7 THEN 'DRAFT' ELSE 'EVALUATED' END AS lifecycle, CASE WHEN admission_seq % 3 = 0 THEN 'COMPLETE' ELSE 'SUSPICIOUS' END AS acceptance, corroboration, 'SUCCESS' AS traversal, error_summary, skipped_known_empty, freshness, assurance, concat('g', admission_seq // 300 % 3) AS signature FROM inv_snapshot),
anchors AS (SELECT * FROM s WHERE lifecycle = 'EVALUATED' AND acceptance = 'SUSPICIOUS' AND coalesce(corroboration, 'NONE') = 'NONE' AND error_summary IS NULL AND skipped_known_empty AND freshness IN ('FRESH_DIRECT', 'FRESH_REFRESHED', 'CACHED_FRESH') AND assurance = 'STRONG_FAILURE_VISIBILITY')
SELECT DISTINCT c.root_id, c.snapshot_id FROM s c JOIN anchors a ON a.root_id = c.root_id AND a.admission_seq < c.admission_seq AND a.signature = c.signature
WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.root_id = c.root_id AND x.lifecycle = 'EVALUATED' AND x.admission_seq > a.admission_seq AND x.admission_seq < c.admission_seq AND x.signature <> c.signature)"""


@check(with_sql("inv_snapshot") + _CORR)
def k4_corroboration(spark, d):
    c = F.col
    rows = fixture(spark, d, "inv_snapshot").select(
        F.concat(F.lit("root"), c("admission_seq") % 40).alias("root_id"), "snapshot_id", "admission_seq", F.when(c("admission_seq") % 8 == 7, "DRAFT").otherwise("EVALUATED").alias("lifecycle"), F.when(c("admission_seq") % 3 == 0, "COMPLETE").otherwise("SUSPICIOUS").alias("acceptance"),
        "corroboration", F.lit("SUCCESS").alias("traversal"), "error_summary", "skipped_known_empty", "freshness", "assurance", F.concat(F.lit("g"), F.floor(c("admission_seq") / 300) % 3).alias("signature"),
    )
    return evidence.corroborated(rows)


@check(with_sql("inv_path") + f""", f AS (SELECT page_id, {_PATH} AS path FROM inv_path)
SELECT page_id, {_DIR.format('path')} AS dir, CASE WHEN path = '' THEN '.' WHEN path = '/' THEN '/' ELSE list_last(string_split(regexp_replace(path, '/+$', ''), '/')) END AS base, coalesce(nullif(regexp_replace(path, '/[^/]+$', ''), ''), '/') AS up,
  CASE WHEN trim(path, '/') = '' THEN 0 ELSE len(string_split(trim(path, '/'), '/')) END AS depth, starts_with(path, '/en/') AS below, '/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')), '/') AS clean, '/mnt' || path AS based,
  CASE WHEN dir_in IN ('', '/') THEN '/' || page_id ELSE regexp_replace(dir_in, '/$', '') || '/' || page_id END AS joined, path = '/' OR regexp_full_match(path, '(/[^/\\\\]+)+') AS valid
FROM (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir_in FROM f)""")
def f1_paths(spark, d):
    p = F.col("path")
    f = fixture(spark, d, "inv_path").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    return f.select(
        "page_id", paths.dirname(p).alias("dir"), paths.basename(p).alias("base"), paths.parent_scope(p).alias("up"), paths.depth(p).alias("depth"), paths.is_below(p, F.lit("/en")).alias("below"), paths.normalise(p).alias("clean"), paths.under_base(F.lit("/mnt/"), p).alias("based"),
        paths.entry_path(F.regexp_replace(p, "[^/]*$", ""), F.col("page_id").cast("string")).alias("joined"), paths.valid_scope(p).alias("valid"),
    )


@check(with_sql("inv_path") + " SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS budget_group, count(*) AS n FROM inv_path GROUP BY 1")
def f24_budget_group(spark, d):
    return fixture(spark, d, "inv_path").groupBy(values.budget_group(F.col("url")).alias("budget_group")).agg(F.count("*").alias("n"))


@check("SELECT event_id, CASE event_id % 9 WHEN 0 THEN 30000 ELSE least(1000 * power(2, event_id % 9 - 1), 30000)::BIGINT END AS wait_ms FROM events")
def f23_backoff(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", values.backoff(F.when(F.col("event_id") % 9 == 0, 99).otherwise(F.col("event_id") % 9), 1000, 30000).alias("wait_ms"))


@check(with_sql("inv_entries") + ", sig AS (SELECT root_id, count(*) AS n, string_agg(coalesce(parent_ref, '') || chr(0) || name || chr(0) || coalesce(hash, '') || chr(0) || coalesce(alg, ''), chr(10) ORDER BY entry_id) AS all_lines FROM inv_entries GROUP BY 1) SELECT count(*) AS roots, count(DISTINCT all_lines) AS signatures, sum(n)::BIGINT AS entries FROM sig")
def f17_scope_signature(spark, d):
    s = evidence.scope_signature(fixture(spark, d, "inv_entries"), ["root_id"])
    return s.agg(F.count("*").alias("roots"), F.countDistinct("signature").alias("signatures"), F.sum(F.split("signature", "-")[0].cast("long")).alias("entries"))
