"""Golden cases of identity resolution, one per rule, and of missing evidence, mirrors and application."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import apply, evidence, identity, reconcile
from ledgerline.operators.coordinator import PRIOR

H = 3_600_000_000
NOW = 10**15
ENTRY = "root_id string, snapshot_id string, entry_id string, parent_ref string, name string, is_dir boolean, size long, mtime long, hash string, alg string, content_type string, provider_id string, provider_scope string, assurance string"


def prior(rid, path, h=None, size=None, mtime=None, pid=None, stable=True, miss=None, **more):
    row = dict(root_id="r", resource_id=rid, path=path, is_dir=False, size=size, mtime=mtime, hash=h, alg="sha256" if h else None, content_type=None, provider_id=pid, provider_scope="d" if pid else None,
               assurance="STABLE_WITHIN_SCOPE" if pid and stable else "UNVERIFIED", presence="PRESENT", evidence="MISSING_CONFIRMED_BY_COMPLETE_SNAPSHOT" if miss else "NONE", missing_since=NOW - miss if miss else None,
               consecutive=1 if miss else 0, missing_first="s0" if miss else None, missing_last="s0" if miss else None, confirmed_generation=1)
    row |= more
    return tuple(row[c.split()[0]] for c in PRIOR.split(", "))


def entry(eid, path, h=None, size=None, mtime=None, pid=None, is_dir=False, root="r"):
    parent, _, name = path.rpartition("/")
    return (root, "s1", eid, parent or "/", name, is_dir, size, mtime, h, "sha256" if h else None, None, pid, "d" if pid else None, "STABLE_WITHIN_SCOPE" if pid else None)


M = H // 2
CASES = {
    "1": ([prior("a", "/a", "h1", pid="P1")], [entry("e", "/b", "h1", pid="P1")], ["MATCHED:provider"]),
    "2": ([prior("a", "/a", "h1", pid="P1")], [entry("e", "/a", "h1", pid="P2")], ["UNRESOLVED:provider_changed"]),
    "2 any assurance": ([prior("a", "/a", "h1", pid="P1", stable=False)], [entry("e", "/a", "h1", pid="P2")], ["UNRESOLVED:provider_changed"]),
    "3": ([prior("a", "/a", pid="P1"), prior("b", "/b", pid="P1")], [entry("e", "/c", pid="P1")], ["CONFLICT:provider_many"]),
    "4a": ([prior("a", "/a"), prior("b", "/a")], [entry("e", "/a")], ["CONFLICT:path_many"]),
    "4b": ([prior("a", "/a")], [entry("e", "/a"), entry("f", "/a")], ["CONFLICT:path_many"] * 2),
    "5": ([prior("a", "/a", "h1")], [entry("e", "/a", "h1")], ["MATCHED:path_hash"]),
    "6": ([prior("a", "/a", "h1")], [entry("e", "/a", "h2")], ["NEW_RESOURCE:imposter"]),
    "7": ([prior("a", "/a", "h1")], [entry("e", "/b", "h1")], ["NEW_RESOURCE:copy"]),
    "8": ([prior("a", "/a", "h1"), prior("b", "/b", None, 5, 7)], [entry("e", "/b", "h1", 5, 7)], ["MATCHED:path_size_time"]),
    "9a": ([prior("a", "/a", "h1", miss=M)], [entry("e", "/b", "h1"), entry("f", "/c", "h1")], ["CONFLICT:move_ambiguous"] * 2),
    "9b": ([prior("a", "/a", "h1", miss=M), prior("b", "/b")], [entry("e", "/b", "h1")], ["CONFLICT:move_ambiguous"]),
    "10": ([prior("a", "/a", "h1", miss=M)], [entry("e", "/b", "h1")], ["MATCHED:move_hash"]),
    "11": ([prior("a", "/a", "h1", miss=2 * H)], [entry("e", "/b", "h1")], ["UNRESOLVED:move_late"]),
    "12": ([prior("a", "/a", "h1", miss=M), prior("c", "/c", "h1")], [entry("e", "/b", "h1")], ["CONFLICT:hash_many"]),
    "13": ([prior("a", "/a", None, 5, 7)], [entry("e", "/a", None, 5, 7)], ["MATCHED:path_size_time"]),
    "14a": ([prior("a", "/a", None, 5, 7)], [entry("e", "/a", None, 5, 8)], ["UNRESOLVED:time_differs"]),
    "14b": ([prior("a", "/a", None, 5, 7)], [entry("e", "/a", None, 6, 7)], ["UNRESOLVED:insufficient"]),
    "15": ([], [entry("e", "/n", "h9")], ["NEW_RESOURCE:new"]),
    "16a": ([prior("a", "/a", None, 5, 7, miss=M)], [entry("e", "/b", None, 5, 7)], ["MATCHED:move_size_time"]),
    "16b": ([], [entry("e", "/n")], ["NEW_RESOURCE:new"]),
    "16c": ([prior("a", "/a", None, 5, 7, miss=M), prior("b", "/b", None, 5, 7, miss=M)], [entry("e", "/c", None, 5, 7)], ["CONFLICT:move_many"]),
    "removed rows never match": ([prior("a", "/a", "h1", presence="REMOVED")], [entry("e", "/a", "h1")], ["NEW_RESOURCE:new"]),
}


def test_resolution_golden(spark):
    ps, es, want = [], [], {}
    for n, (p, e, told) in CASES.items():  # each case is a root of its own, so one job checks all
        ps += [(n, *x[1:]) for x in p]
        es += [(n, *x[1:]) for x in e]
        want[n] = told
    out = identity.resolve(spark.createDataFrame(ps, PRIOR), spark.createDataFrame(es, ENTRY), F.lit(NOW), H).orderBy("root_id", "entry_id").collect()
    why = {v: k for k, v in identity.REASONS.items()}
    got: dict = {}
    for r in out:
        got.setdefault(r["root_id"], []).append(f"{r['status']}:{why[r['reason']]}")
    assert got == want


def test_two_entries_may_match_one_resource(spark):
    p = spark.createDataFrame([prior("a", "/a", pid="P1")], PRIOR)
    e = spark.createDataFrame([entry("e", "/b", pid="P1"), entry("f", "/c", pid="P1")], ENTRY)
    t = reconcile.reconcile(p, e, "COMPLETE", reconcile.Config(), F.lit(NOW), F.lit("s1"))
    assert sorted(r["kind"] for r in t.collect()) == ["RENAME", "RENAME", "UPDATE", "UPDATE"]


@pytest.mark.parametrize(
    ("row", "cfg", "kind", "consecutive"),
    [
        (prior("a", "/a"), {}, "MISSING_EVIDENCE", 1),
        (prior("a", "/a", miss=M, missing_first="s1", missing_last="s1"), {}, "MISSING_EVIDENCE", 1),
        (prior("a", "/a", miss=M, missing_last="s1"), {}, "MISSING_EVIDENCE", 1),
        (prior("a", "/a", miss=M), {"removal_grace": H}, "REMOVAL_CANDIDATE", 2),
        (prior("a", "/a", miss=2 * H), {"removal_grace": H}, "CONFIRMED_REMOVED", 2),
        (prior("a", "/a", miss=M), {}, "CONFIRMED_REMOVED", 2),
        (prior("a", "/a", miss=M), {"min_consecutive": 3}, "MISSING_EVIDENCE", 2),
    ],
)
def test_missing(spark, row, cfg, kind, consecutive):
    p, none = spark.createDataFrame([row], PRIOR), spark.createDataFrame([], ENTRY)
    t = reconcile.reconcile(p, none, "COMPLETE", reconcile.Config(**cfg), F.lit(NOW), F.lit("s1")).collect()
    assert [(r["kind"], r["consecutive"]) for r in t] == [(kind, consecutive)]


@pytest.mark.parametrize("acceptance", ["PARTIAL", "STALE", "SUSPICIOUS", "FAILED"])
def test_only_complete_tells_absence(spark, acceptance):
    p, none = spark.createDataFrame([prior("a", "/a")], PRIOR), spark.createDataFrame([], ENTRY)
    assert reconcile.reconcile(p, none, acceptance, reconcile.Config(), F.lit(NOW), F.lit("s1")).count() == 0


def test_directory_takes_subtree_not_siblings(spark):
    rows = [prior("d", "/s/a", is_dir=True), prior("k", "/s/a/x/y"), prior("n", "/s/ab"), prior("o", "/other/a"), prior("m", "/s/moved", pid="P9")]
    p = spark.createDataFrame(rows, PRIOR)
    e = spark.createDataFrame([entry("e", "/s/ab"), entry("f", "/s/new", pid="P9")], ENTRY)
    t = reconcile.reconcile_directory(p, e, F.lit("/s"), reconcile.Config(), F.lit(NOW), F.lit("s1"))
    assert sorted(r["resource_id"] for r in t.filter("kind = 'CONFIRMED_REMOVED'").collect()) == ["d", "k"]


def test_config_limits():
    with pytest.raises(ValueError):
        reconcile.Config(min_independent=2)
    with pytest.raises(ValueError):
        reconcile.Config(removal_grace=1, move_horizon=2)


def test_apply_then_journal_agrees(spark):
    from ledgerline.operators.latest import terminal_presence

    p = spark.createDataFrame([prior("a", "/a", miss=M), prior("b", "/b", "h2", 1, 1)], PRIOR)
    e = spark.createDataFrame([entry("e", "/b", "h2", 2, 1), entry("f", "/c", "h3")], ENTRY)
    t = reconcile.reconcile(p, e, "COMPLETE", reconcile.Config(), F.lit(NOW), F.lit("s1"))
    g = apply.generations(spark.createDataFrame([("r", 1)], "root_id string, generation long"), t)
    after = {r["resource_id"]: r for r in apply.apply_transitions(p, e, t, g).collect()}
    assert after["a"]["presence"] == "REMOVED" and after["b"]["size"] == 2 and after["b"]["confirmed_generation"] == 2 and len(after) == 3
    told = {r["resource_id"]: r["terminal"] for r in terminal_presence(apply.events(t, g)).collect()}
    assert all(after[k]["presence"] == v for k, v in told.items()) and len(told) == 3


CLEAN = dict(traversal="SUCCESS", error_summary=None, skipped_scopes=None, skipped_known_empty=True, freshness="FRESH_DIRECT", assurance="STRONG_FAILURE_VISIBILITY", used_cache=False, entries=10, prior_present=10, corroboration=None)


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, "COMPLETE"), ({"traversal": "FAILED"}, "FAILED"), ({"traversal": "INTERRUPTED"}, "PARTIAL"), ({"error_summary": "{}"}, "PARTIAL"), ({"skipped_scopes": '["/a"]'}, "PARTIAL"), ({"skipped_scopes": "[]"}, "COMPLETE"),
        ({"freshness": "STALE"}, "STALE"), ({"freshness": None, "used_cache": True}, "STALE"), ({"entries": 5}, "SUSPICIOUS"), ({"entries": 5, "corroboration": "CORROBORATED"}, "COMPLETE"), ({"entries": 0, "corroboration": "CORROBORATED"}, "SUSPICIOUS"),
        ({"entries": 6}, "COMPLETE"), ({"prior_present": 0, "entries": 0}, "COMPLETE"), ({"assurance": "WEAK_FAILURE_VISIBILITY"}, "SUSPICIOUS"), ({"skipped_known_empty": False}, "PARTIAL"), ({"freshness": None}, "PARTIAL"),
    ],
)
def test_completeness(spark, change, want):
    kind = "traversal string, error_summary string, skipped_scopes string, skipped_known_empty boolean, freshness string, assurance string, used_cache boolean, entries long, prior_present long, corroboration string"
    row = spark.createDataFrame([tuple((CLEAN | change).values())], kind)
    assert evidence.acceptance(row).first()["acceptance"] == want
