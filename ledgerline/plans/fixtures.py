"""Inventory inputs projected from the generic benchmark tables.

Each fixture is (source table, row condition, {column: expression}) in the SQL that Spark and other engines share, so a
check query can build the very same input elsewhere. Instants are microseconds since 1970 as longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = 1_710_000_000_000_000
MINUTE = 60_000_000

K = "(doc_id % 20)"
BLOCK = "(doc_id - doc_id % 20)"


def _case(*pairs: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def _k(*n: int) -> str:
    return f"{K} IN ({', '.join(map(str, n))})"


MTIME = "(1704067200000000 + doc_id * 1000000)"
ROOT_ID = f"concat('root', cast(({BLOCK} % 100) AS VARCHAR(20)))"
HASH = f"md5(concat(cast(doc_id AS VARCHAR(20)), text))"
PRIOR_HASH = _case((_k(2), "md5(concat('c', cast(doc_id AS VARCHAR(20))))"), (_k(12, 19), "NULL"), (_k(17, 18), f"md5(concat('m', cast({BLOCK} AS VARCHAR(20))))"), (_k(0, 5), "md5(text)"), other=HASH)
ENTRY_HASH = _case(
    (_k(2), "md5(concat('c', cast(doc_id AS VARCHAR(20))))"), (_k(12), "md5(concat('c', cast(doc_id - 10 AS VARCHAR(20))))"), (_k(6, 7, 19), "NULL"), (_k(3), "md5(concat('x', text))"),
    (_k(17, 18), f"md5(concat('m', cast({BLOCK} AS VARCHAR(20))))"), (_k(0, 5), "md5(text)"), other=HASH,
)
PROVIDER = _case((_k(2, 4, 5, 8), "concat('P', cast(doc_id AS VARCHAR(20)))"), (_k(13, 14), f"concat('D', cast({BLOCK} AS VARCHAR(20)))"), other="NULL")
ENTRY_PROVIDER = _case((_k(2, 4, 5), "concat('P', cast(doc_id AS VARCHAR(20)))"), (_k(8), "concat('Q', cast(doc_id AS VARCHAR(20)))"), (_k(13), f"concat('D', cast({BLOCK} AS VARCHAR(20)))"), other="NULL")

#: name: (table, condition, columns)
FIXTURES: dict[str, tuple[str, str, dict[str, str]]] = {
    "inv_root": ("customer", "true", {
        "root_id": "concat('root', cast(c_custkey AS VARCHAR(20)))", "created_at": "c_custkey % 97", "generation": "cast(c_nationkey AS BIGINT)",
        "lifecycle": "CASE c_mktsegment WHEN 'BUILDING' THEN 'ACTIVE' WHEN 'MACHINERY' THEN 'ACTIVE' WHEN 'HOUSEHOLD' THEN 'NEW' WHEN 'FURNITURE' THEN 'DEPRECATED' ELSE 'DELETED' END",
    }),
    "inv_prior": ("documents", f"NOT {_k(0)}", {
        "root_id": ROOT_ID, "resource_id": "md5(concat('r', cast(doc_id AS VARCHAR(20))))",
        "path": _case((_k(15, 16), f"concat('/dup/', cast({BLOCK} AS VARCHAR(20)))"), other="concat('/', lang, '/', cast(doc_id AS VARCHAR(20)))"),
        "is_dir": "false", "size": "n_chars", "mtime": MTIME, "hash": PRIOR_HASH, "alg": f"CASE WHEN {_k(12, 19)} THEN NULL ELSE 'md5' END", "content_type": "lang",
        "provider_id": PROVIDER, "provider_scope": f"CASE WHEN {PROVIDER} IS NULL THEN NULL ELSE 'drive' END", "assurance": f"CASE WHEN {PROVIDER} IS NULL THEN 'UNVERIFIED' ELSE 'STABLE_WITHIN_SCOPE' END",
        "presence": "CASE WHEN doc_id % 400 = 1 THEN 'REMOVED' ELSE 'PRESENT' END",
        "evidence": f"CASE WHEN {_k(9, 10, 11, 17, 19)} THEN 'MISSING_CONFIRMED_BY_COMPLETE_SNAPSHOT' ELSE 'NONE' END",
        "missing_since": _case((_k(9, 11, 17, 19), str(NOW - 30 * MINUTE)), (_k(10), str(NOW - 120 * MINUTE)), other="NULL"),
        "consecutive": f"CASE WHEN {_k(9, 10, 11, 17, 19)} THEN 1 ELSE 0 END",
        "missing_first": _case((f"{K} = 11 AND doc_id % 40 = 11", "'s0'"), (f"{K} = 11", "'s1'"), (_k(9, 10, 17, 19), "'s0'"), other="NULL"),
        "missing_last": f"CASE WHEN {_k(9, 10, 11, 17, 19)} THEN 's0' ELSE NULL END",
        "confirmed_generation": "1",
    }),
    "inv_entries": ("documents", f"NOT {_k(1, 11)}", {
        "root_id": ROOT_ID, "snapshot_id": "'s1'", "entry_id": "concat('e', cast(doc_id AS VARCHAR(20)))",
        "parent_ref": _case((_k(5, 9, 10, 17, 19), "concat('/', lang, '/moved')"), (_k(15, 16), "'/dup'"), (_k(0), "concat('/', lang, '/')"), other="concat('/', lang)"),
        "name": _case((_k(4), "concat('renamed', cast(doc_id AS VARCHAR(20)))"), (_k(15, 16), f"cast({BLOCK} AS VARCHAR(20))"), other="cast(doc_id AS VARCHAR(20))"),
        "is_dir": "false", "size": f"CASE WHEN {_k(3, 5)} THEN n_chars + 1 ELSE n_chars END", "mtime": f"CASE WHEN {_k(7)} THEN {MTIME} + 1 ELSE {MTIME} END",
        "hash": ENTRY_HASH, "alg": f"CASE WHEN {_k(6, 7, 19)} THEN NULL ELSE 'md5' END", "content_type": "lang",
        "provider_id": ENTRY_PROVIDER, "provider_scope": f"CASE WHEN {ENTRY_PROVIDER} IS NULL THEN NULL ELSE 'drive' END", "assurance": f"CASE WHEN {ENTRY_PROVIDER} IS NULL THEN NULL ELSE 'STABLE_WITHIN_SCOPE' END",
    }),
    "inv_snapshot": ("orders", "true", {
        "snapshot_id": "concat('s', cast(o_orderkey AS VARCHAR(20)))", "root_id": "concat('root', cast(o_custkey AS VARCHAR(20)))", "admission_seq": "o_orderkey",
        "traversal": "CASE o_orderkey % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'INTERRUPTED' WHEN 2 THEN 'PARTIAL' ELSE 'SUCCESS' END",
        "error_summary": "CASE WHEN o_orderkey % 13 = 5 THEN '{\"message\":\"x\"}' ELSE NULL END",
        "skipped_scopes": "CASE WHEN o_orderkey % 11 = 4 THEN '[\"/a\"]' WHEN o_orderkey % 11 = 5 THEN '[]' ELSE NULL END", "skipped_known_empty": "o_orderkey % 3 <> 0",
        "freshness": "CASE o_orderkey % 7 WHEN 0 THEN 'STALE' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'CACHED_FRESH' WHEN 3 THEN NULL WHEN 4 THEN 'FRESH_REFRESHED' ELSE 'FRESH_DIRECT' END",
        "assurance": "CASE o_orderkey % 5 WHEN 0 THEN 'WEAK_FAILURE_VISIBILITY' WHEN 1 THEN NULL ELSE 'STRONG_FAILURE_VISIBILITY' END", "used_cache": "o_orderkey % 4 = 1",
        "entries": "CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey % 100 END", "prior_present": "o_orderkey % 90", "corroboration": "CASE WHEN o_orderkey % 6 = 0 THEN 'CORROBORATED' ELSE NULL END",
    }),
    "inv_journal": ("orders", "true", {
        "root_id": "concat('root', cast(o_custkey AS VARCHAR(20)))", "made_at": "o_orderdate", "tie": "o_orderkey",
        "event_type": "CASE o_orderstatus WHEN 'F' THEN 'resource-removed' WHEN 'O' THEN 'resource-added' ELSE 'resource-updated' END", "resource_id": "concat('r', cast(o_orderkey % 50 AS VARCHAR(20)))",
    }),
    "inv_admission": ("orders", "true", {
        "root_id": "concat('root', cast(o_custkey AS VARCHAR(20)))", "snapshot_id": "concat('s', cast(o_orderkey AS VARCHAR(20)))", "made_at": "o_orderdate", "tie": "o_orderkey",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'APPLIED' WHEN 'O' THEN 'PENDING' ELSE 'NOOP' END",
    }),
    "inv_evidence": ("lineitem", "true", {
        "resource_id": "concat('r', cast(l_partkey AS VARCHAR(20)))", "observation_id": "l_orderkey * 10 + l_linenumber", "provider_id": "concat('P', cast(l_suppkey AS VARCHAR(20)))", "assurance": "CASE l_returnflag WHEN 'A' THEN 'STABLE_WITHIN_SCOPE' ELSE 'UNVERIFIED' END",
    }),
    "inv_signal": ("events", "true", {
        "root_id": "concat('root', cast(user_id % 10 AS VARCHAR(20)))", "scope": "concat('/u', cast(user_id AS VARCHAR(20)))", "event_id": "event_id",
        "source": "CASE event_type WHEN 'error' THEN 'PROVIDER_EVENT' WHEN 'purchase' THEN 'MUTATION_HINT' WHEN 'signup' THEN 'MANUAL_OPERATOR' WHEN 'view' THEN 'POLL_SCHEDULE' ELSE 'RECOVERY' END",
        "reason": "CASE event_id % 3 WHEN 0 THEN 'POSSIBLE_CHANGE' WHEN 1 THEN 'CREATED' ELSE 'CONTENT_CHANGED' END",
        "priority": "CASE event_type WHEN 'error' THEN 'URGENT' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'NORMAL' ELSE 'LOW' END",
        "seen_at": f"{NOW} + event_id * 1000003 % 86400000000", "not_before": f"CASE WHEN event_id % 4 = 0 THEN {NOW} + event_id * 7919 % 86400000000 ELSE NULL END",
    }),
    "inv_watch": ("customer", "true", {
        "root_id": "concat('root', cast(c_custkey % 40 AS VARCHAR(20)))", "scope": "concat('/d', cast(c_custkey AS VARCHAR(20)))",
        "watch_state": "CASE c_custkey % 6 WHEN 0 THEN 'HOT' WHEN 1 THEN 'COLD' WHEN 2 THEN 'DISABLED' ELSE 'WARM' END",
        "cadence": "CASE WHEN c_custkey % 3 = 0 THEN 'SOURCE_MIRROR' ELSE 'MIRROR_REVISIT' END", "enrolled": "c_custkey % 4 <> 1", "priority": "CASE WHEN c_custkey % 5 = 0 THEN 'HIGH' ELSE 'NORMAL' END",
        "interval_s": "30 + c_custkey % 4000", "next_due": f"{NOW} + (c_custkey % 200 - 120) * {MINUTE}", "deferred_until": f"CASE WHEN c_custkey % 7 = 0 THEN {NOW} + (c_custkey % 9 - 5) * {MINUTE} ELSE NULL END",
        "last_error": "CASE WHEN c_custkey % 11 = 0 THEN 'THROTTLED' ELSE NULL END", "failures": "c_custkey % 11", "fresh_at": f"{NOW} - c_custkey % 777 * {MINUTE}",
    }),
    "inv_work": ("orders", "true", {
        "root_id": "concat('root', cast(o_custkey % 60 AS VARCHAR(20)))", "scope": "CASE WHEN o_orderkey % 50 = 0 THEN '/' ELSE concat('/w', cast(o_custkey % 37 AS VARCHAR(20)), '/', cast(o_orderkey AS VARCHAR(20))) END", "tie": "o_orderkey",
        "work_state": "CASE o_orderkey % 6 WHEN 0 THEN 'RETRY_WAIT' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'IN_FLIGHT' WHEN 3 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'BLOCKED' ELSE 'SUSPENDED' END ELSE 'PENDING' END",
        "priority": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'URGENT' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'NORMAL' ELSE 'LOW' END",
        "first_seen": f"{NOW} - o_orderkey * 7907 % 100000 * 1000000", "not_before": f"CASE WHEN o_orderkey % 3 = 0 THEN {NOW} + (o_orderkey % 500 - 400) * 1000000 ELSE NULL END",
        "error_class": "CASE o_orderkey % 5 WHEN 0 THEN 'TRANSIENT_PROVIDER' WHEN 1 THEN 'THROTTLED' WHEN 2 THEN 'INTERNAL' WHEN 3 THEN 'AUTH_OR_PERMISSION' ELSE NULL END", "failures": "o_orderkey % 5", "started": f"CASE WHEN o_orderkey % 6 = 2 THEN {NOW} - o_orderkey % 3600 * 1000000 ELSE NULL END",
    }),
    "inv_path": ("pages", "true", {"page_id": "page_id", "url": "url"}),
    "inv_http": ("events", "true", {"event_id": "event_id", "kind": "event_type", "started": f"{NOW} + event_id * 1000003 % 600000000", "lasted": "cast(floor(value * 1000) AS BIGINT)"}),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, where, columns = FIXTURES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(where).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def with_sql(*names: str) -> str:
    """The same fixtures as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(f'{e} AS {_q(c)}' for c, e in FIXTURES[n][2].items())} FROM {FIXTURES[n][0]} WHERE {FIXTURES[n][1]})" for n in names)


def _q(name: str) -> str:
    return f'"{name}"'
