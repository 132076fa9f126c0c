"""Selection windows, source budgets, settings without secrets, offline receipts."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import runtime

NOW = 10**15
KIND = "root_id string, scope string, work_state string, priority string, first_seen long, not_before long, verified_at long, attempts long, sources array<string>, reasons array<string>, error_class string"


def item(root, scope, priority="NORMAL", age=0, state="PENDING", verified=None):
    return (root, scope, state, priority, NOW - age, None, verified, 0 if verified is None else 1, ["RECOVERY"], ["POSSIBLE_CHANGE"], None)


def test_selection_window(spark):
    rows = [item(r, "/", state="VERIFIED", verified=NOW - 5) for r in "abc"] + [item("a", "/new1"), item("b", "/new2"), item("c", "/new3"), item("a", "/old", "LOW", 10**9), item("a", "/urgent", "URGENT"), item("b", "/high", "HIGH"), item("z", "/off", "URGENT")]
    roots = spark.createDataFrame([("a", "ACTIVE"), ("b", "ACTIVE"), ("c", "ACTIVE"), ("z", "DELETED")], "root_id string, lifecycle string")
    adapters = spark.createDataFrame([(r, "alist", "/") for r in "abc"], "root_id string, kind string, base_path string")
    inv = spark.createDataFrame([(r, s, "PRESENT", True, "NONE") for r, s in (("a", "/new1"), ("b", "/new2"), ("c", "/new3"))], "root_id string, path string, presence string, is_dir boolean, evidence string")
    got = [(r["selection"], r["scope"]) for r in runtime.selection_window(spark.createDataFrame(rows, KIND), roots, adapters, inv, NOW, 6).orderBy("slot").collect()]
    assert got == [("AGED_BACKGROUND", "/old"), ("FIRST_DISCOVERY", "/new1"), ("FIRST_DISCOVERY", "/new2"), ("PRIORITY_FIFO", "/urgent"), ("PRIORITY_FIFO", "/high"), ("PRIORITY_FIFO", "/new3")]
    with pytest.raises(ValueError):
        runtime.selection_window(spark.createDataFrame(rows, KIND), roots, adapters, inv, NOW, 2)


def test_source_budget():
    t = [0.0]
    b = runtime.SourceBudget(spacing=1, root_spacing=2, group_spacing=3, backoff=10, max_backoff=25, background_percent=50, clock=lambda: t[0], sleep=lambda s: t.__setitem__(0, t[0] + s))
    b.acquire("r", "g")
    b.acquire("q", "h")
    assert t[0] == 1
    b.acquire("r", "g")
    assert t[0] == 3
    for n, pause in ((1, 10), (2, 20), (3, 25)):
        b.report("r", "g", False)
        with pytest.raises(runtime.Deferred):
            b.acquire("r", "g")
        t[0] += pause
        assert n and b._until[("group", "g")] == t[0]
    b.report("r", "g", False, retry_after=100)
    assert b._until[("group", "g")] == t[0] + 100
    b.report("r", "g", True)
    t[0] += 200
    b.acquire("r", "g", background=True)
    was = t[0]
    b.acquire("r", "g", background=True)
    assert t[0] - was == 6


def test_settings():
    runtime.check_config("")
    runtime.check_config('{"path": "/", "password_env": "P", "nested": [{"api-key.env": "K"}]}')
    for bad in ('{"Pass_Word": "x"}', '{"a": [{"API-KEY": 1}]}', '{"my.token": 1}'):
        with pytest.raises(ValueError):
            runtime.check_config(bad)
    with pytest.raises(ValueError):
        runtime.check_config("not json")


def test_receipts(spark, tmp_path):
    at = lambda s: f"2024-01-01T00:00:{s:02d}Z"
    rows = [{"type": "receiver_http", "started": at(0), "finished": at(2), "scope": "/a", "status": 200, "http": "/api/fs/list"}, {"type": "receiver_http", "started": at(1), "finished": at(3), "scope": "/a", "status": 500, "http": "/api/fs/list"}, {"type": "receiver_http", "started": at(3), "finished": at(4), "scope": "/b", "status": 200, "http": "/x"}]
    rows += [{"type": "claim", "scope": "/a", "seen": at(0), "claimed": at(i)} for i in range(1, 5)] + [{"type": "claim", "scope": "/", "seen": at(0), "claimed": at(50)}]
    (tmp_path / "r.ndjson").write_text("\n".join(map(json.dumps, rows)))
    kind = "type string, started string, finished string, scope string, status long, http string, seen string, claimed string"
    out = runtime.analyse_receipts(spark.read.schema(kind).json(str(tmp_path / "r.ndjson")))
    assert out["peak"].first()["peak"] == 2 and {r["scope"]: r["n"] for r in out["lists"].collect()} == {"/a": 2}
    assert {r["bucket"]: r["n"] for r in out["arrivals"].collect()} == {0: 1, 1: 1, 3: 1} and {r["status"]: r["n"] for r in out["statuses"].collect()} == {200: 2, 500: 1}
    c = out["claims"].first()
    assert (c["observed"], c["p50"], c["p95"], c["max"]) == (4, 2_000_000, 4_000_000, 4_000_000)


def test_union_set_keeps_null_apart(spark):
    from ledgerline.operators.work import union_set

    df = spark.createDataFrame([(None, None), ([], None), (["b", "a"], ["a"])], "a array<string>, b array<string>")
    assert [r["x"] for r in df.select(union_set(F.col("a"), F.col("b")).alias("x")).collect()] == [None, [], ["a", "b"]]
