"""The kernel's check queries as SQL for another engine, on the fixtures of fixtures.py."""

from __future__ import annotations

from ledgerline.operators import reconcile as R
from ledgerline.operators.identity import REASONS
from ledgerline.plans.fixtures import MINUTE, NOW, with_sql

HORIZON, GRACE = 60 * MINUTE, 90 * MINUTE

_MISSING = "evidence IN ('MISSING_CONFIRMED_BY_COMPLETE_SNAPSHOT', 'REMOVAL_CANDIDATE')"
_WHY = {k: "'" + v.replace("'", "''") + "'" for k, v in REASONS.items()}

RESOLVE = (
    with_sql("inv_prior", "inv_entries")
    + f""",
live AS (SELECT * FROM inv_prior WHERE presence = 'PRESENT'),
e AS (SELECT *, CASE WHEN parent_ref IN ('', '/') THEN '/' || name ELSE regexp_replace(parent_ref, '/$', '') || '/' || name END AS path,
  coalesce(hash, '') <> '' AND coalesce(alg, '') <> '' AS hashed, coalesce(assurance = 'STABLE_WITHIN_SCOPE', false) AND provider_id IS NOT NULL AND provider_scope IS NOT NULL AS stable FROM inv_entries),
np AS (SELECT e.entry_id, count(p.resource_id) AS n, min(p.resource_id) AS rid FROM e LEFT JOIN live p ON p.root_id = e.root_id AND p.assurance = 'STABLE_WITHIN_SCOPE' AND p.provider_id = e.provider_id AND p.provider_scope = e.provider_scope GROUP BY 1),
pp AS (SELECT e.entry_id, count(p.resource_id) AS n, min(p.resource_id) AS rid, coalesce(bool_or(p.provider_id <> e.provider_id), false) AS other, min(p.hash) AS hash, min(p.alg) AS alg, min(p.size) AS size, min(p.mtime) AS mtime
  FROM e LEFT JOIN live p ON p.root_id = e.root_id AND p.path = e.path GROUP BY 1),
hh AS (SELECT e.entry_id, count(p.resource_id) AS n, count(p.resource_id) FILTER (WHERE {_MISSING}) AS missing, min(p.resource_id) AS rid, min(p.path) AS path, min(p.missing_since) AS since
  FROM e LEFT JOIN live p ON e.hashed AND p.root_id = e.root_id AND p.hash = e.hash AND coalesce(p.alg, '') = e.alg GROUP BY 1),
ss AS (SELECT e.entry_id, count(p.resource_id) AS n, min(p.resource_id) AS rid FROM e LEFT JOIN live p ON p.root_id = e.root_id AND p.size = e.size AND p.mtime = e.mtime AND p.{_MISSING} AND {NOW} - p.missing_since <= {HORIZON} GROUP BY 1),
op AS (SELECT root_id, path, count(*) AS n FROM e GROUP BY 1, 2),
oh AS (SELECT root_id, alg, hash, count(*) AS n FROM e WHERE hashed GROUP BY 1, 2, 3),
j AS (SELECT e.*, np.n AS n_prov, np.rid AS prov_rid, pp.n AS n_path, pp.rid AS path_rid, pp.other, pp.hash AS p_hash, pp.alg AS p_alg, pp.size AS p_size, pp.mtime AS p_mtime,
    hh.n AS n_hash, hh.missing AS n_missing, hh.rid AS hash_rid, hh.since, ss.n AS n_moved, ss.rid AS moved_rid, op.n AS n_seen, coalesce(oh.n, 0) AS n_seen_hash, coalesce(there.n, 0) AS n_there
  FROM e JOIN np USING (entry_id) JOIN pp USING (entry_id) JOIN hh USING (entry_id) JOIN ss USING (entry_id) JOIN op ON op.root_id = e.root_id AND op.path = e.path
  LEFT JOIN oh ON oh.root_id = e.root_id AND oh.alg = e.alg AND oh.hash = e.hash AND e.hashed LEFT JOIN op there ON there.root_id = e.root_id AND there.path = hh.path),
d AS (SELECT *, CASE
    WHEN stable AND n_prov = 1 THEN 'MATCHED:provider' WHEN stable AND n_prov > 1 THEN 'CONFLICT:provider_many' WHEN stable AND other THEN 'UNRESOLVED:provider_changed'
    WHEN n_path > 1 OR n_seen > 1 THEN 'CONFLICT:path_many'
    WHEN hashed AND n_path = 1 AND coalesce(p_hash, '') = hash AND coalesce(p_alg, '') = alg THEN 'MATCHED:path_hash'
    WHEN hashed AND n_path = 1 AND coalesce(p_hash, '') <> '' THEN 'NEW_RESOURCE:imposter'
    WHEN hashed AND n_hash > 0 AND n_missing = 0 AND n_path = 0 THEN 'NEW_RESOURCE:copy'
    WHEN hashed AND n_missing > 0 AND n_hash > 1 THEN 'CONFLICT:hash_many'
    WHEN hashed AND n_missing > 0 AND (n_seen_hash > 1 OR n_there > 0 OR n_path > 0) THEN 'CONFLICT:move_ambiguous'
    WHEN hashed AND n_missing > 0 AND {NOW} - since <= {HORIZON} THEN 'MATCHED:move_hash'
    WHEN hashed AND n_missing > 0 THEN 'UNRESOLVED:move_late'
    WHEN n_path = 1 AND p_size = size AND p_mtime = mtime THEN 'MATCHED:path_size_time'
    WHEN n_path = 1 AND p_size = size AND p_mtime IS NOT NULL AND mtime IS NOT NULL THEN 'UNRESOLVED:time_differs'
    WHEN n_path = 1 THEN 'UNRESOLVED:insufficient'
    WHEN hashed OR n_moved = 0 THEN 'NEW_RESOURCE:new'
    WHEN n_moved = 1 THEN 'MATCHED:move_size_time' ELSE 'CONFLICT:move_many' END AS told FROM j),
resolved AS (SELECT *, split_part(told, ':', 1) AS status, CASE split_part(told, ':', 2) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _WHY.items())} END AS reason,
  CASE split_part(told, ':', 2) WHEN 'provider' THEN prov_rid WHEN 'path_hash' THEN path_rid WHEN 'path_size_time' THEN path_rid WHEN 'move_hash' THEN hash_rid WHEN 'move_size_time' THEN moved_rid END AS match_id FROM d)
"""
)


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_DIR = "CASE WHEN regexp_replace({0}, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace({0}, '/[^/]*$', '') END"
_EVID = f"(p.{_MISSING} OR p.missing_since IS NOT NULL OR p.consecutive > 0)"
_CHANGED = "NOT (coalesce(p.size = r.size, false) AND coalesce(p.mtime = r.mtime, false) AND coalesce(p.hash, '') = coalesce(r.hash, '') AND coalesce(p.content_type, '') = coalesce(r.content_type, ''))"
_NONE = "NULL::BIGINT AS missing_since, NULL::BIGINT AS consecutive, NULL AS missing_first, NULL AS missing_last"

TRANSITIONS = (
    RESOLVE
    + f""",
m AS (SELECT r.root_id, r.entry_id, p.resource_id, r.path AS to_path, p.path AS from_path, {_EVID} AS had, p.path <> r.path AS moved, {_CHANGED} AS changed FROM resolved r JOIN live p ON p.root_id = r.root_id AND p.resource_id = r.match_id),
gone AS (SELECT * FROM live p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.root_id = p.root_id AND m.resource_id = p.resource_id)),
late AS (SELECT *, coalesce(missing_first, '') = '' AS fresh, coalesce(missing_first = 's1', false) AS again, coalesce(missing_last = 's1', false) AS counted FROM gone),
entry_t AS (
  SELECT root_id, 'RESET_REMOVAL_EVIDENCE' AS kind, 0 AS ordinal, resource_id, entry_id, NULL AS new_path, {_q(R.RESET)} AS reason FROM m WHERE had
  UNION ALL SELECT root_id, CASE WHEN {_DIR.format('from_path')} <> {_DIR.format('to_path')} THEN 'MOVE' ELSE 'RENAME' END, 1, resource_id, entry_id, to_path, 'path change' FROM m WHERE moved
  UNION ALL SELECT root_id, 'UPDATE', 2, resource_id, entry_id, NULL, 'attribute change' FROM m WHERE changed
  UNION ALL SELECT root_id, 'UNCHANGED', 2, resource_id, entry_id, NULL, NULL FROM m WHERE NOT moved AND NOT changed
  UNION ALL SELECT root_id, 'ADD', 0, md5(root_id || chr(0) || snapshot_id || chr(0) || entry_id), entry_id, path, reason FROM resolved WHERE status = 'NEW_RESOURCE'
  UNION ALL SELECT root_id, 'CONFLICT', 0, NULL, entry_id, NULL, reason FROM resolved WHERE status IN ('CONFLICT', 'UNRESOLVED')),
miss_t AS (
  SELECT root_id, CASE WHEN fresh OR again OR counted THEN 'MISSING_EVIDENCE' WHEN {NOW} - coalesce(missing_since, {NOW}) >= {GRACE} THEN 'CONFIRMED_REMOVED' ELSE 'REMOVAL_CANDIDATE' END AS kind, 0 AS ordinal, resource_id, NULL AS entry_id, NULL AS new_path,
    CASE WHEN fresh THEN {_q(R.FIRST_MISSING)} WHEN again THEN {_q(R.SAME_SNAPSHOT)} WHEN counted THEN {_q(R.ALREADY_COUNTED)} ELSE {_q(R.MISSING)} END AS reason,
    CASE WHEN fresh THEN {NOW} WHEN again OR counted THEN missing_since ELSE coalesce(missing_since, {NOW}) END AS missing_since, CASE WHEN fresh THEN 1 WHEN again OR counted THEN consecutive ELSE consecutive + 1 END AS consecutive,
    CASE WHEN fresh THEN 's1' ELSE missing_first END AS missing_first, CASE WHEN again OR counted THEN missing_last ELSE 's1' END AS missing_last FROM late),
t AS (SELECT *, {_NONE} FROM entry_t UNION ALL SELECT * FROM miss_t)
"""
)

GENERATION = "'ADD', 'UPDATE', 'RENAME', 'MOVE', 'CONFIRMED_REMOVED'"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind {c}) AS {n}" for n, c in (("added", "= 'ADD'"), ("updated", "= 'UPDATE'"), ("renamed", "= 'RENAME'"), ("moved", "= 'MOVE'"), ("unchanged", "= 'UNCHANGED'"), ("removed", "= 'CONFIRMED_REMOVED'"), ("missing_evidence", "IN ('MISSING_EVIDENCE', 'REMOVAL_CANDIDATE')"), ("conflict", "= 'CONFLICT'")))

_EVENTS = """CASE kind WHEN 'ADD' THEN 'resource-added' WHEN 'UPDATE' THEN 'resource-updated' WHEN 'RENAME' THEN 'resource-renamed' WHEN 'MOVE' THEN 'resource-moved' WHEN 'CONFIRMED_REMOVED' THEN 'resource-removed' END"""

SQL = {
    "k6_resolve": RESOLVE + "SELECT root_id, entry_id, path, status, reason, match_id FROM resolved",
    "k7_reconcile_complete": TRANSITIONS + "SELECT * FROM t",
    "k7_reconcile_partial": TRANSITIONS + "SELECT root_id, kind, ordinal, resource_id, entry_id, new_path, reason FROM entry_t",
    "k9_missing": TRANSITIONS + "SELECT root_id, resource_id, kind, reason, missing_since, consecutive, missing_first, missing_last FROM miss_t",
    "a6_counts": TRANSITIONS + f"SELECT root_id, {_COUNTS}, bool_or(kind IN ({GENERATION})) AS mutates FROM t GROUP BY 1",
    "k11_removal_context": TRANSITIONS + ", lines AS (SELECT p.root_id, CASE WHEN m.had THEN 'reappears_reset' ELSE 'absent' END || '|rid=' || p.resource_id || '|state=' || p.evidence || '|consec=' || p.consecutive || '|first=' || CASE WHEN coalesce(p.missing_first, '') <> '' THEN '1' ELSE '0' END AS line FROM live p LEFT JOIN (SELECT DISTINCT root_id, resource_id, had FROM m) m USING (root_id, resource_id) WHERE m.had IS NULL OR m.had) SELECT root_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS context, count(*) AS lines FROM lines GROUP BY 1",
    "k12_journal_events": TRANSITIONS
    + f""", ev AS (SELECT *, {_EVENTS} AS event_type FROM t), g AS (SELECT root_id, 7 + max(CASE WHEN kind IN ({GENERATION}) THEN 1 ELSE 0 END) AS generation FROM t GROUP BY 1)
SELECT root_id, generation, row_number() OVER (PARTITION BY root_id ORDER BY entry_id NULLS LAST, resource_id, ordinal) AS intra_seq, 100 + row_number() OVER (PARTITION BY root_id ORDER BY entry_id NULLS LAST, resource_id, ordinal) AS event_seq, event_type, resource_id, '{{"reason":"' || reason || '"}}' AS payload
FROM ev JOIN g USING (root_id) WHERE event_type IS NOT NULL""",
    "k13_apply": TRANSITIONS
    + f""", g AS (SELECT root_id, 7 + max(CASE WHEN kind IN ({GENERATION}) THEN 1 ELSE 0 END) AS generation FROM t GROUP BY 1),
w AS (SELECT t.*, e.size AS e_size, e.mtime AS e_mtime, e.hash AS e_hash, e.alg AS e_alg, e.content_type AS e_type, e.is_dir AS e_dir FROM t LEFT JOIN e USING (root_id, entry_id) WHERE resource_id IS NOT NULL),
a AS (SELECT DISTINCT ON (root_id, resource_id) root_id, resource_id, e_size, e_mtime, e_hash, e_alg, e_type, e_dir, true AS upd FROM w WHERE kind IN ('ADD', 'UPDATE') ORDER BY root_id, resource_id, entry_id DESC, ordinal DESC),
pt AS (SELECT DISTINCT ON (root_id, resource_id) root_id, resource_id, new_path, true AS moved FROM w WHERE kind IN ('ADD', 'RENAME', 'MOVE') ORDER BY root_id, resource_id, entry_id DESC, ordinal DESC),
rs AS (SELECT DISTINCT root_id, resource_id, true AS reset FROM w WHERE kind = 'RESET_REMOVAL_EVIDENCE'),
mt AS (SELECT root_id, resource_id, kind, missing_since AS ms, consecutive AS cs, missing_first AS mf, missing_last AS ml FROM miss_t),
ids AS (SELECT root_id, resource_id FROM inv_prior UNION SELECT root_id, resource_id FROM w)
SELECT ids.root_id, ids.resource_id, CASE WHEN moved THEN new_path ELSE path END AS path, coalesce(is_dir, e_dir) AS is_dir, CASE WHEN upd THEN e_size ELSE size END AS size, CASE WHEN upd THEN e_mtime ELSE mtime END AS mtime,
  CASE WHEN upd THEN e_hash ELSE hash END AS hash, CASE WHEN upd THEN e_alg ELSE alg END AS alg, CASE WHEN upd THEN e_type ELSE content_type END AS content_type, CASE WHEN kind = 'CONFIRMED_REMOVED' THEN 'REMOVED' ELSE coalesce(presence, 'PRESENT') END AS presence,
  CASE WHEN kind = 'MISSING_EVIDENCE' THEN 'MISSING_CONFIRMED_BY_COMPLETE_SNAPSHOT' WHEN kind IS NOT NULL THEN 'REMOVAL_CANDIDATE' WHEN reset THEN 'NONE' ELSE coalesce(evidence, 'NONE') END AS evidence,
  CASE WHEN kind IS NOT NULL THEN ms WHEN reset THEN NULL ELSE missing_since END AS missing_since, CASE WHEN kind IS NOT NULL THEN cs WHEN reset THEN 0 ELSE coalesce(consecutive, 0) END AS consecutive,
  CASE WHEN kind IS NOT NULL THEN mf WHEN reset THEN NULL ELSE missing_first END AS missing_first, CASE WHEN kind IS NOT NULL THEN ml WHEN reset THEN NULL ELSE missing_last END AS missing_last,
  CASE WHEN upd OR moved OR reset OR kind = 'CONFIRMED_REMOVED' THEN generation ELSE confirmed_generation END AS confirmed_generation
FROM ids LEFT JOIN inv_prior USING (root_id, resource_id) LEFT JOIN a USING (root_id, resource_id) LEFT JOIN pt USING (root_id, resource_id) LEFT JOIN rs USING (root_id, resource_id) LEFT JOIN mt USING (root_id, resource_id) LEFT JOIN g USING (root_id)""",
    "k10_directory": TRANSITIONS
    + f""", absent AS (SELECT * FROM gone WHERE {_DIR.format('path')} = '/en' AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.root_id = gone.root_id AND r.path = gone.path))
SELECT root_id, kind, ordinal, resource_id, entry_id, new_path, reason FROM entry_t UNION ALL SELECT root_id, 'CONFIRMED_REMOVED', 0, resource_id, NULL, NULL, {_q(R.MIRRORED)} FROM absent""",
}
