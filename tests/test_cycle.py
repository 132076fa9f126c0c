"""The control loop: settings, ordered reads, discovery, executor and orchestration cycles, rolling polls, recovery."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import cycle
from tests.test_parts import WORK

NOW = 10**15
WATCH = "root_id string, scope string, watch_state string, cadence string, priority string, interval_s long, next_due long, deferred_until long, last_error string, failures long, fresh_at long, attempt_at long, finished_at long, version long, source_set array<string>"
INV = "root_id string, resource_id string, path string, is_dir boolean, presence string, evidence string, mtime long"


def item(root, scope, state="PENDING", priority="NORMAL", sources=("RECOVERY",), age=0, **more):
    row = dict(root_id=root, scope=scope, work_state=state, signal_seq=1, sources=list(sources), reasons=["POSSIBLE_CHANGE"], priority=priority, first_seen=NOW - age, not_before=None, claimed_sources=None, claimed_reasons=None, claimed_priority=None, claimed_first_seen=None, claimed_not_before=None, claimed_seq=None, last_seen=NOW, verified_at=None, verified_seq=None, attempts=0, failures=0, error_class=None, started=None, version=1)
    return tuple((row | more)[c.split()[0]] for c in WORK.split(", "))


def watch(root, scope, due=-1, rolling=False, **more):
    row = dict(root_id=root, scope=scope, watch_state="WARM", cadence="MIRROR_REVISIT" if rolling else "SOURCE_MIRROR", priority="NORMAL", interval_s=60, next_due=NOW + due, deferred_until=None, last_error=None, failures=2, fresh_at=NOW, attempt_at=None, finished_at=None, version=1, source_set=["BACKSTOP_ENROLL"] if rolling else ["OPERATOR_POLICY"])
    return tuple((row | more)[c.split()[0]] for c in WATCH.split(", "))


def control(spark, work=(), watches=(), inventory=(), roots=("a", "b", "c"), clock=None, dead=()):
    df = spark.createDataFrame
    t = clock or [NOW]
    return cycle.Control(
        spark, df([(r, "DELETED" if r in dead else "ACTIVE") for r in roots], "root_id string, lifecycle string"), df(list(work), WORK), df(list(watches), WATCH), df([(r, "alist", "/") for r in roots], "root_id string, kind string, base_path string"),
        df(list(inventory), INV), df([(r, "", None, None) for r in roots], "root_id string, scope_cursor string, outstanding string, outstanding_seq long"), df([], "root_id string, scope string, resource_id string, lifecycle string, epoch long, fresh_at long"), clock=lambda: t[0],
    )


def states(state):
    return {(r["root_id"], r["scope"]): r for r in state.work.collect()}


def test_settings_have_bounds():
    assert cycle.RollingPolicy(50, 200_000, cycle.HOUR).admission_spacing == 3_200_000
    for bad in (lambda: cycle.RollingPolicy(51, 1000, cycle.HOUR), lambda: cycle.RollingPolicy(1, 999, cycle.HOUR), lambda: cycle.RollingPolicy(1, 1000, 8 * 24 * cycle.HOUR), lambda: cycle.check_revisit(29_000_000), lambda: cycle.check_revisit(30_500_000), lambda: cycle.Settings(readers=3), lambda: cycle.Settings(rolling=cycle.RollingPolicy(1, 1000, cycle.HOUR)), lambda: cycle.DiagnoseLimits(rows=0), lambda: cycle.DiagnoseLimits(timeout=31_000_000)):
        with pytest.raises(ValueError):
            bad()
    assert cycle.check_revisit(0) == 0 and cycle.check_revisit(30_000_000)


def test_settings_of_the_environment():
    s = cycle.Settings.from_environment({"LEDGERLINE_READERS": "4", "LEDGERLINE_REVISIT_S": "60", "LEDGERLINE_ROLLING_SHARE": "10", "LEDGERLINE_DISCOVERY_SCOPE": "/x", "OTHER": "1"})
    assert (s.readers, s.revisit, s.rolling.share, s.discovery, s.items) == (4, 60_000_000, 10, "/x", 5)
    with pytest.raises(ValueError):
        cycle.Settings.from_environment({"LEDGERLINE_READERS": "3"})


def test_mirror_children(spark):
    """Verified and queued children get no signal, bare ones a watch, and the executor follows the rest."""
    inv = [("a", f"r{i}", f"/m/{i}", True, "PRESENT", "NONE", NOW - 10**9) for i in range(4)]
    sound = dict(verified_at=NOW - 5, verified_seq=1, attempts=1)
    s = control(spark, [item("a", "/m", priority="URGENT"), item("a", "/m/0", state="VERIFIED", **sound), item("a", "/m/1", age=1, not_before=NOW + 10**9, verified_at=NOW - 5)], [watch("a", f"/m/{i}", due=10, rolling=True) for i in range(3)], inv)
    got = cycle.mirror_children(s, "a", [f"/m/{i}" for i in range(5)], cycle.Settings(revisit=60_000_000), NOW)
    assert "/m/0" not in got and {"/m/2", "/m/3", "/m/4"} <= set(got)
    new = {r["scope"]: r for r in s.watches.filter("scope in ('/m/3', '/m/4')").collect()}
    assert len(new) == 2 and new["/m/3"]["next_due"] == NOW + 60_000_000 and new["/m/3"]["source_set"] == ["BACKSTOP_ENROLL"]
    out = cycle.execute_cycle(s, lambda r, p: {"outcome": "APPLIED", "mirror": True, "children": ["/m/0", "/m/2"] if p == "/m" else []}, cycle.Settings(revisit=60_000_000))
    w = states(s)
    assert out.succeeded == 1 and w["a", "/m/0"]["work_state"] == "VERIFIED" and w["a", "/m/2"]["work_state"] == "PENDING"


def test_discovery_children():
    f = cycle.discovery_children
    assert f("", "/a", ["/a/b"]) == [] and f("/x", "/a", ["/a/b"]) == [] and f("/", "/a", ["/a/b", "/a/c", "/a/b"]) == ["/a/b", "/a/c"]
    deep = "/" + "/".join("abcdefgh")
    assert f("/", deep, [deep + "/i"]) == [] and f("/a", deep, [deep + "/i"]) == [deep + "/i"]
    for bad in (["/b"], ["/a/../b"], ["/a/b/c"], ["a"], [f"/a/{i}" for i in range(1001)]):
        with pytest.raises(ValueError):
            f("/", "/a", bad)


def test_reads_commit_in_order():
    running, most, lock, per_root = [0], [0], threading.Lock(), {}

    def scan(root, scope):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            assert per_root.setdefault(root, 0) == 0
            per_root[root] += 1
        time.sleep(0.05 if scope == "/0" else 0.01)
        with lock:
            running[0] -= 1
            per_root[root] -= 1
        if scope == "/3":
            raise OSError("gone")
        return {"outcome": "APPLIED"}

    items = [("ab"[i % 2] if i < 4 else f"r{i}", f"/{i}") for i in range(12)]
    got = list(cycle.read_ordered(items, scan, 4))
    assert [i for i, _ in got] == items and most[0] > 1 and got[3][1]["error"] == "INTERNAL"


def test_executor_cycle(spark):
    s = control(spark, [item("a", "/x", priority="URGENT"), item("b", "/y", priority="HIGH", sources=["POLL_SCHEDULE"]), item("c", "/z", priority="LOW")], [watch("b", "/y")])
    told = {("a", "/x"): {"outcome": "APPLIED", "children": ["/x/1", "/x/2"], "mirror": True}, ("b", "/y"): {"error": "THROTTLED"}, ("c", "/z"): {"outcome": "NOOP"}}
    out = cycle.execute_cycle(s, lambda r, p: told[r, p], cycle.Settings(readers=2))
    assert (out.stop, out.selected, out.succeeded, out.failed) == (cycle.NO_WORK, 3, 2, 1)
    assert out.order == [("a", "/x", "VERIFIED"), ("b", "/y", "THROTTLED"), ("c", "/z", "VERIFIED")]
    w = states(s)
    assert w["a", "/x"]["work_state"] == "VERIFIED" and w["b", "/y"]["work_state"] == "RETRY_WAIT" and w["a", "/x/1"]["work_state"] == "PENDING" and w["a", "/x/2"]["attempts"] == 0
    v = s.watches.first()
    assert (v["attempt_at"], v["finished_at"], v["failures"], v["last_error"], v["version"]) == (NOW, NOW, 3, "THROTTLED", 3)


def test_executor_stops(spark):
    rows = [item("a", f"/{i}", priority="URGENT", age=9 - i) for i in range(5)]
    s = control(spark, rows)
    out = cycle.execute_cycle(s, lambda r, p: {"outcome": "REJECTED"}, cycle.Settings())
    assert (out.stop, out.selected, out.failed) == (cycle.INTERNAL_FAILURE, 1, 1)  # what isn't applied doesn't verify
    s = control(spark, rows)
    out = cycle.execute_cycle(s, lambda r, p: {"outcome": "APPLIED"}, cycle.Settings(items=3))
    assert (out.stop, out.succeeded) == (cycle.MAX_ITEMS, 3)
    t = [NOW]
    s = control(spark, rows, clock=t)

    def slow(r, p):
        t[0] += 10
        return {"outcome": "APPLIED"}

    assert cycle.execute_cycle(s, slow, cycle.Settings(), NOW + 15).stop == cycle.MAX_WALL_TIME
    s, calls = control(spark, rows), []
    out = cycle.execute_cycle(s, lambda r, p: calls.append(p) or {"outcome": "APPLIED"}, cycle.Settings(), cancelled=lambda: bool(calls))
    assert out.stop == cycle.CANCELLED and out.succeeded == 0 and states(s)["a", "/0"]["work_state"] == "IN_FLIGHT"
    assert cycle.recover_startup(s) == 1 and states(s)["a", "/0"]["work_state"] == "PENDING"


def test_orchestration(spark):
    s = control(spark, [], [watch("a", f"/{i}", due=-10 + i) for i in range(7)] + [watch("b", "/later", due=5), watch("c", "/off")], dead=["c"])
    out = cycle.orchestrate(s, lambda r, p: {"outcome": "APPLIED"}, cycle.Settings())
    assert (out.stop, out.due, out.more_due, out.emitted) == (cycle.COMPLETED, 6, True, 5) and out.executor.succeeded == 5
    assert {p for (_, p), r in states(s).items() if r["work_state"] == "VERIFIED"} == {f"/{i}" for i in range(5)}
    due = {r["scope"]: (r["next_due"] - NOW, r["failures"], r["fresh_at"]) for r in s.watches.collect()}
    assert due["/0"] == (60_000_000, 0, NOW) and due["/5"] == (-5, 2, NOW)


def test_rolling_polls(spark):
    """One poll outstanding a root, spaced over roots, cursors that move on when a scope is deferred."""
    inv = [("a", "r1", "/d1", True, "PRESENT", "NONE", NOW - 5), ("a", "r2", "/d2", True, "PRESENT", "NONE", NOW - 5), ("b", "r3", "/d1", True, "PRESENT", "NONE", NOW - 5), ("c", "r4", "/d1", False, "PRESENT", "NONE", NOW - 5)]
    t = [NOW]
    s = control(spark, [], [watch(r, p, rolling=True) for r, p in (("a", "/d1"), ("a", "/d2"), ("b", "/d1"), ("c", "/d1"))], inv, clock=t)
    policy = cycle.RollingPolicy(50, 200_000, cycle.HOUR)
    emit = lambda r, p: cycle.emit_rolling(s, r, p, 60, policy, t[0])
    assert emit("a", "/d1") == "EMIT" and emit("b", "/d1") == "WAIT" and emit("a", "/d2") == "DEFERRED" and emit("c", "/d1") == "DEFERRED"
    b = {r["root_id"]: (r["scope_cursor"], r["outstanding"], r["outstanding_seq"]) for r in s.budgets.collect()}
    assert b == {"a": ("/d2", "/d1", 1), "b": ("", None, None), "c": ("/d1", None, None)} and s.budget["root_cursor"] == "c"
    t[0] += policy.admission_spacing
    assert emit("b", "/d1") == "EMIT" and s.budget["emitted"] == 2 and s.budget["deferred"] == 2
    assert {(r["root_id"], r["resource_id"]) for r in s.bindings.collect()} == {("a", "r1"), ("b", "r3")}
    out = cycle.execute_cycle(s, lambda r, p: {"outcome": "APPLIED"}, cycle.Settings())
    assert out.succeeded == 2 and {r["outstanding"] for r in s.budgets.collect()} == {None}
    row = cycle.rolling_stats(s.watches, s.bindings, s.budgets, s.budget, t[0]).first()
    assert (row["watches"], row["bindings"], row["outstanding"], row["emitted"], row["deferred"]) == (4, 2, 0, 2, 2)
    t[0] += cycle.HOUR
    rolling = cycle.Settings(revisit=30_000_000, rolling=policy)
    first, second = (cycle.orchestrate(s, lambda r, p: {"outcome": "APPLIED"}, rolling) for _ in range(2))
    assert (first.deferred, first.emitted, second.emitted) == (1, 0, 1) and s.budget["emitted"] == 3  # c is deferred, then a's turn comes


def test_loop(spark):
    """Recovery first, retries promoted, bursts with a pause, a wake when there is nothing left."""
    t, naps, seen = [NOW], [], []
    flying = dict(state="IN_FLIGHT", claimed_sources=["RECOVERY"], claimed_reasons=["RETRY"], claimed_priority="LOW", claimed_first_seen=NOW, claimed_seq=1, started=NOW - 9)
    s = control(spark, [item("a", f"/{i}", priority="HIGH") for i in range(4)] + [item("b", "/r", state="RETRY_WAIT", not_before=NOW - 1, error_class="THROTTLED"), item("c", "/f", **flying)], clock=t)

    def sleep(us):
        naps.append(us)
        t[0] += us

    def scan(r, p):
        seen.append((r, p))
        return {"outcome": "APPLIED"}

    done = cycle.run_loop(s, scan, cycle.Settings(items=3), lambda: len(naps) >= 1 or len(seen) > 20, sleep)
    assert len(seen) == 6 and naps and done[0].executor.stop == cycle.MAX_ITEMS and {r["work_state"] for r in states(s).values()} == {"VERIFIED"}
    b = cycle.Burst()
    for k in range(4):
        assert b.wait(NOW + k) == 0
        b.finished(NOW + k)
    assert b.wait(NOW + 10) == cycle.COOLDOWN - 7 and b.wait(NOW + 3 + cycle.COOLDOWN) == 0 and b.count == 0


def test_diagnose_root(spark):
    s = control(spark, [item("a", f"/{i}", state="BLOCKED") for i in range(5)] + [item("b", "/x")])
    checks, whole = cycle.diagnose_root(s.work, s.roots, "a", NOW)
    rows = checks.collect()
    assert whole and {r["overall"] for r in rows} == {"DEGRADED"} and "BLOCKED_WORK" in {r["code"] for r in rows} and {r["root_id"] for r in rows} == {"a"}
    assert not cycle.diagnose_root(s.work, s.roots, "a", NOW, cycle.DiagnoseLimits(rows=2))[1]
