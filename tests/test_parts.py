"""Paths, readers, sources, streams, the store, and work transitions."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import paths, values
from ledgerline.operators import controls, coordinator, reader, reconcile, selectors, work
from ledgerline.sources import listings
from ledgerline.streaming import signals
from tests.test_kernel import ENTRY, H, NOW, entry


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("parent", "name", "want"), [("", "a", "/a"), ("/", "a", "/a"), ("/d/", "a", "/d/a"), ("/d", "a", "/d/a"), ("/d//", "a", "/d//a")])
def test_entry_path(spark, parent, name, want):
    assert one(spark, paths.entry_path(F.lit(parent), F.lit(name))) == want


@pytest.mark.parametrize(("scope", "ok"), [("/", True), ("/a/b", True), ("a", False), ("/a/", False), ("", False), ("/a//b", False), ("/a/../b", False), ("/.", False), ("/a\\b", False), ("/x_%/子", True), (None, False)])
def test_scope(spark, scope, ok):
    assert one(spark, paths.valid_scope(F.lit(scope).cast("string"))) is ok


def test_prefix_is_literal(spark):
    assert one(spark, paths.is_below(F.lit("/x_%/a"), F.lit("/x_%"))) and not one(spark, paths.is_below(F.lit("/xab/a"), F.lit("/x_%"))) and not one(spark, paths.is_below(F.lit("/scope-other"), F.lit("/scope")))
    assert one(spark, paths.ancestors(F.lit("/a/b/c"))) == ["/a", "/a/b"] and one(spark, paths.ancestors(F.lit("/a"))) == []
    assert one(spark, paths.within(F.lit("/a/b"), F.lit("/a/"))) and not one(spark, paths.within(F.lit("/a/../b"), F.lit("/a")))


def test_null_rules(spark):
    none = F.lit(None).cast("string")
    assert one(spark, values.same(none, none)) is False and one(spark, values.hashes_agree(none, none, none, none)) is False
    assert one(spark, values.hashes_agree(F.lit("h"), none, F.lit("h"), F.lit(""))) is True
    assert one(spark, values.backoff(F.lit(3), 1000, 30000, F.lit(50000))) == 50000 and one(spark, values.budget_group(F.lit("HTTPS://Host:443/a"))) == "https://host"


def test_parameters():
    assert [reader.parameter(x, 7) for x in (None, "", "12", "-1", "x", "0", "²")] == [7, 7, 12, 7, 7, 0, 7]
    assert [reader.switch(x) for x in ("1", "true", "TRUE", "0", None)] == [True, True, False, False, False]


def test_pages(spark):
    rows = spark.createDataFrame([("r", f"x{i}", f"/p{i % 3}") for i in range(6)], "root_id string, resource_id string, path string")
    seen, cursor = [], None
    while True:
        got = reader.page(rows, "r", 1, 2, cursor).collect()
        seen += [r["resource_id"] for r in got]
        cursor = reader.next_cursor(got, "r", 1, 2)
        if cursor is None:
            break
    assert seen == ["x0", "x3", "x1", "x4", "x2", "x5"]
    got = list(reader.pages(rows, "r", 1, 2))
    assert [[r["resource_id"] for r in p] for p, _ in got] == [["x0", "x3"], ["x1", "x4"], ["x2", "x5"], []] and [c is None for _, c in got] == [False, False, False, True]
    token = reader.encode_cursor("r", 1, "/a", "b")
    with pytest.raises(reader.StaleCursor):
        reader.page(rows, "r", 2, 2, token)
    with pytest.raises(reader.StaleCursor):
        reader.decode_cursor("%%")


def test_rclone(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"Path": "a/f.txt", "Name": "f.txt", "Size": 3, "MimeType": "text/plain", "ModTime": "2024-01-02T03:04:05.123456Z", "IsDir": False, "ID": "i", "Hashes": {"MD5": "m", "SHA-1": "s"}}, {"Path": "a", "Name": "a", "Size": -1, "MimeType": "inode/directory", "ModTime": "bad", "IsDir": True}]))
    rows, ev = listings.collect(spark, "rclone", str(tmp_path / "l.json"))
    f, d = sorted(rows.collect(), key=lambda r: r["is_dir"])
    assert (f["parent_ref"], f["size"], f["hash"], f["alg"], f["provider_id"], f["content_type"]) == ("/a", 3, "s", "sha-1", "i", "text/plain") and f["mtime"] == 1704164645123456
    assert (d["parent_ref"], d["size"], d["mtime"], d["hash"], d["content_type"]) == ("/", None, None, None, None)
    assert ev.first()["traversal"] == "SUCCESS"
    (tmp_path / "b.json").write_text("not json")
    assert listings.read_rclone(spark, str(tmp_path / "b.json"))[1].first()["traversal"] == "FAILED"
    with pytest.raises(ValueError):
        listings.collect(spark, "ftp", "x")


def test_pages_of_a_source(spark):
    item = lambda n: {"name": n, "size": 1, "is_dir": False, "modified": "2024-01-01T00:00:00Z", "hash_info": {"md5": "m"}}
    body = lambda code, rows, total: json.dumps({"code": code, "message": "", "data": {"content": rows, "total": total}})
    pages = spark.createDataFrame([("/ok", body(200, [item("a")], 1)), ("/short", body(200, [item("a")], 2)), ("/twice", body(200, [item("a"), item("a")], 2)), ("/auth", body(403, None, 0)), ("/empty", body(200, None, 0)), ("/many", body(200, [item("a"), item("b"), item("c")], 3)), ("/slow", body(429, None, 0))], "scope string, body string")
    assert {r[0]: r[1] for r in listings.page_error(pages, 2).collect()} == {"/ok": None, "/short": "TRANSIENT_PROVIDER", "/twice": "TRANSIENT_PROVIDER", "/auth": "AUTH_OR_PERMISSION", "/empty": None, "/many": "SCOPE_TOO_LARGE", "/slow": "THROTTLED"}
    tree = {"/": [{"name": "d", "is_dir": True}, {"name": "f", "is_dir": False}], "/d": [{"name": "g", "is_dir": False}]}
    assert [r["path"] for r in listings.walk(tree.__getitem__)[0]] == ["/d", "/f", "/d/g"] and listings.walk(lambda p: 1 / 0)[1]
    assert listings.paged(lambda p, n: ([{"name": str(i)} for i in range(5)][(p - 1) * n : p * n], 5), 2) == [{"name": str(i)} for i in range(5)]
    with pytest.raises(ValueError):
        listings.paged(lambda p, n: ([], 3), 2)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r", f"/s{i % 3}", "RECOVERY" if i % 2 else "POLL_SCHEDULE", "POSSIBLE_CHANGE", "HIGH" if i == 4 else "LOW", i, None if i % 3 else 100 + i) for i in range(20)]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, signals.SIGNAL)
    df.repartition(4).write.parquet(src)
    got = {}
    sink = lambda b, i: got.update({r["scope"]: r for r in b.collect()})
    q = signals.run_available(signals.coalesced_stream(signals.signal_stream(spark, src, 1)), sink, str(tmp_path / "cp"))
    q.awaitTermination()
    assert got == {r["scope"]: r for r in work.coalesce_signals(df).collect()}


def test_tail(spark, tmp_path):
    j = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "root_id string, event_seq long")
    j.write.parquet(str(tmp_path / "j"))
    seen = []
    q = signals.run_available(signals.tail_journal(spark, str(tmp_path / "j"), j.schema, {"a": 1}), lambda b, i: seen.extend(b.collect()), str(tmp_path / "cp"), "append")
    q.awaitTermination()
    assert sorted(map(tuple, seen)) == [("a", 2), ("b", 1)] and signals.advance({"a": 1}, j) == {"a": 2, "b": 1}


WORK = "root_id string, scope string, work_state string, signal_seq long, sources array<string>, reasons array<string>, priority string, first_seen long, not_before long, claimed_sources array<string>, claimed_reasons array<string>, claimed_priority string, claimed_first_seen long, claimed_not_before long, claimed_seq long, last_seen long, verified_at long, verified_seq long, attempts long, failures long, error_class string, started long, version long"


def test_work_cycle(spark):
    roots = spark.createDataFrame([("r", "ACTIVE")], "root_id string, lifecycle string")
    w = spark.createDataFrame([("r", "/a", "PENDING", 3, ["X"], ["R"], "LOW", 5, 9, None, None, None, None, None, None, 8, None, None, 0, 0, None, None, 1)], WORK)
    claimed = work.claim(w, w.select("root_id", "scope", "version"), F.lit(50))
    c = claimed.first()
    assert (c["work_state"], c["sources"], c["claimed_sources"], c["attempts"], c["claimed_seq"], c["version"]) == ("IN_FLIGHT", None, ["X"], 1, 3, 2)
    assert work.claim(w, w.select("root_id", "scope", F.lit(7).alias("version")), F.lit(50)).first()["work_state"] == "PENDING"
    ok = work.complete(claimed, F.lit(True), F.lit(60)).first()
    assert (ok["work_state"], ok["verified_seq"], ok["claimed_sources"], ok["failures"]) == ("VERIFIED", 3, None, 0)
    more = spark.createDataFrame([("r", "/a", "Y", "S", "URGENT", 55, 70)], signals.SIGNAL)
    busy = work.merge_signals(claimed, more, roots)
    b = busy.first()
    assert (b["work_state"], b["sources"], b["signal_seq"], b["not_before"]) == ("IN_FLIGHT", ["Y"], 4, 70)
    assert work.complete(busy, F.lit(True), F.lit(60)).first()["work_state"] == "PENDING"
    bad = work.fail(busy, F.lit(True), F.lit("THROTTLED"), F.lit(65), F.lit(60)).first()
    assert (bad["work_state"], bad["sources"], bad["priority"], bad["not_before"], bad["failures"]) == ("RETRY_WAIT", ["X", "Y"], "URGENT", 70, 1)
    off = work.fail(busy, F.lit(True), F.lit("ROOT_INACTIVE"), F.lit(65), F.lit(60)).first()
    assert (off["work_state"], off["failures"]) == ("SUSPENDED", 0)
    back = work.recover_stale(busy, roots, F.lit(99)).first()
    assert (back["work_state"], back["sources"], back["not_before"], back["failures"]) == ("PENDING", ["X", "Y"], 9, 0)
    failed = work.fail(busy, F.lit(True), F.lit("THROTTLED"), F.lit(65), F.lit(60))
    assert work.retry_ready(failed, F.lit(70)).first()["work_state"] == "PENDING" and work.retry_ready(failed, F.lit(69)).first()["work_state"] == "RETRY_WAIT"


def snapshot(i, **change):
    return dict(snapshot_id=f"s{i}", observed_at=NOW + i * H, traversal="SUCCESS", error_summary=None, skipped_scopes=None, skipped_known_empty=True, freshness="FRESH_DIRECT", assurance="STRONG_FAILURE_VISIBILITY", used_cache=False, corroboration=None) | change


def test_store_lifecycle(spark, tmp_path):
    s, cfg = coordinator.Store(spark, str(tmp_path / "store")), reconcile.Config()
    put = lambda seq, rows, **c: coordinator.process(s, "r", seq, snapshot(seq, **c), spark.createDataFrame(rows, ENTRY), cfg)
    four = [entry(f"e{i}", f"/f{i}", f"h{i}", i, i) for i in range(4)]
    assert put(1, four) == "APPLIED" and s.load("r").generation == 1
    assert put(2, four) == "NOOP" and put(2, four) == "NOOP"  # the same admission again
    assert put(2, four, snapshot_id="other") == "STALE_INPUT"
    assert put(3, four, traversal="FAILED") == "REJECTED" and put(3, four, snapshot_id="again") == "STALE_INPUT"
    assert put(4, four[:3]) == "APPLIED"  # evidence only
    assert s.load("r").generation == 1
    assert put(5, four[:3]) == "APPLIED" and s.load("r").generation == 2
    root = s.load("r")
    state = {r["path"]: r["presence"] for r in s.inventory(root).collect()}
    assert state == {"/f0": "PRESENT", "/f1": "PRESENT", "/f2": "PRESENT", "/f3": "REMOVED"}
    assert [r["event_type"] for r in s.journal("r").orderBy("event_seq").collect()] == ["resource-added"] * 4 + ["resource-removed"]
    told = [r["outcome"] for r in s.admissions("r").orderBy("number").collect()]
    assert told == ["APPLIED", "NOOP", "STALE_INPUT", "REJECTED", "STALE_INPUT", "APPLIED", "APPLIED"]
    seen = s.observations("r")
    assert seen.count() == 10 and {r["assurance"] for r in seen.collect()} <= {"UNVERIFIED", "STABLE_WITHIN_SCOPE"}
    assert s.inventory(s.load("nobody")) is None and s.journal("nobody").count() == 0


@pytest.mark.parametrize("at", ["resolved", "transitions", "observations", "journal", "changed", "head"])
def test_store_survives_a_lost_driver(spark, tmp_path, monkeypatch, at):
    """Whatever write is the last before the driver is lost, readers see the state before, and a retry gives the state after once."""
    from pyspark.sql import DataFrameWriter

    s, cfg = coordinator.Store(spark, str(tmp_path / "store")), reconcile.Config()
    three = [entry(f"e{i}", f"/f{i}", f"h{i}", i, i) for i in range(3)]
    put = lambda seq, rows: coordinator.process(s, "r", seq, snapshot(seq), spark.createDataFrame(rows, ENTRY), cfg)
    assert put(1, three) == "APPLIED"
    plain, whole = DataFrameWriter.parquet, coordinator.Store.commit

    def lost(*_, **__):
        raise RuntimeError("lost")

    if at == "head":
        monkeypatch.setattr(coordinator.Store, "commit", lost)
    else:
        monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plain(self, path, *a, **k), lost() if path.endswith("/" + at) else None))
    four = [*three, entry("e9", "/f9", "h9", 9, 9)]
    with pytest.raises(RuntimeError):
        put(2, four)
    monkeypatch.setattr(coordinator.Store, "commit", whole)
    monkeypatch.setattr(DataFrameWriter, "parquet", plain)
    assert s.load("r").number == 1 and s.journal("r").count() == 3 and s.inventory(s.load("r")).count() == 3
    assert put(2, four) == "APPLIED" and put(2, four) == "APPLIED"
    assert sorted(r["event_seq"] for r in s.journal("r").collect()) == [1, 2, 3, 4] and s.inventory(s.load("r")).count() == 4 and s.load("r").generation == 2
    stale = s.load("r")
    with pytest.raises(coordinator.Conflict):  # a second writer with the number of the first
        s.commit(stale)


def test_queue(spark, tmp_path):
    """Drafts, guarded steps, admission in order and again, lost submissions, several roots at once."""
    s, cfg = coordinator.Store(spark, str(tmp_path / "store")), reconcile.Config()
    rows = lambda n, root: spark.createDataFrame([entry(f"e{i}", f"/f{i}", f"h{i}", i, i, root=root) for i in range(n)], ENTRY)
    for root, n in (("r", 2), ("q/%", 1)):
        for k in range(2):
            s.draft(root, snapshot(k), rows(n + k, root))
            with pytest.raises(coordinator.Conflict):
                s.draft(root, snapshot(k), rows(1, root))
            with pytest.raises(coordinator.Conflict):
                s.admit(root, f"s{k}")
            assert s.state(root, f"s{k}") == "DRAFT"
            s.submit(root, f"s{k}")
            with pytest.raises(coordinator.Conflict):
                s.submit(root, f"s{k}")
    assert s.recover("r") == (None, ["s0", "s1"])  # ambiguous
    assert s.admit("r", "s0") == 1 and s.admit("r", "s0") == 1 and s.recover("r") == (2, ["s1"]) and s.recover("r") == (None, [])
    assert [s.admit("q/%", f"s{k}") for k in (0, 1)] == [1, 2]
    assert coordinator.drain(s, ["r", "q/%"], cfg) == {"r": [(1, "APPLIED"), (2, "APPLIED")], "q/%": [(1, "APPLIED"), (2, "APPLIED")]}
    assert coordinator.process_head(s, "r", cfg) is None and coordinator.process_snapshot(s, "r", "s1", cfg) == "APPLIED"
    assert s.state("r", "s1") == "EVALUATED" and s.inventory(s.load("q/%")).count() == 2 and s.journal("q/%").count() == 2


def test_store_pages(spark, tmp_path, monkeypatch):
    """Pages over several files and changed rows are those of a sorted listing; a merge doesn't change them."""
    monkeypatch.setattr(coordinator, "FILE_ROWS", 10)
    s, cfg = coordinator.Store(spark, str(tmp_path / "store")), reconcile.Config()
    put = lambda seq, rows: coordinator.process(s, "r", seq, snapshot(seq), spark.createDataFrame(rows, ENTRY), cfg)
    rows = [entry(f"e{i:02d}", f"/f{i % 37:02d}", f"h{i}", i, i) for i in range(37)]
    assert put(1, rows) == "APPLIED" and len(s.load("r").files) == 4

    def same():
        head = s.load("r")
        want = sorted((r["path"], r["resource_id"]) for r in s.inventory(head).collect())
        one = [(r["path"], r["resource_id"]) for t, _ in s.pages(head, 7) for r in t.to_pylist()]
        got, cursor = [], None
        while True:
            page = s.page(head, 7, cursor)
            got += [(r["path"], r["resource_id"]) for r in page]
            cursor = reader.next_cursor(page, "r", head.generation, 7)
            if cursor is None:
                break
        assert got == want and one == want
        return head

    same()
    assert put(2, [*rows, entry("n1", "/a", "x", 1, 1), entry("n2", "/f05a", "y", 2, 2), entry("n3", "/z", "z", 3, 3)]) == "APPLIED"
    assert same().change_rows == 3
    more = [entry(f"m{i}", f"/m{i}", f"k{i}", i, i) for i in range(20)]
    assert put(3, [*rows, *more]) == "APPLIED" and same().changes == []  # merged
    with pytest.raises(reader.StaleCursor):
        s.page(s.load("r"), 7, reader.encode_cursor("r", 1, "/a", "x"))


def test_topology_and_lifecycles(spark):
    m = spark.createDataFrame([("a", "/x", "s3"), ("a", "/x/y", "s3"), ("b", "/x", "s3"), ("b", "/xy", "s3"), ("c", "/x", "ftp"), ("d", "/x", "s3"), ("d", "/x", "s3")], "root_id string, mount string, driver string")
    assert {r["root_id"]: r["refused"] for r in controls.topology_digest(m, ["s3"]).collect()} == {"a": True, "b": False, "c": True, "d": True}
    assert one(spark, controls.valid_step(F.lit("NEW"), F.lit("ACTIVE"))) and not one(spark, controls.valid_step(F.lit("DELETED"), F.lit("ACTIVE")))


def test_coverage_bound(spark):
    """10 000 names at most, unless the caller sets another bound or none."""
    rows = spark.range(10_001).selectExpr("'r' root_id", "if(id < 10000, '/a', '/b') scope", "1 generation", "1 current_generation", "cast(id as string) name", "if(id < 10000, 10000, 1) declared", "'PARTIAL' traversal", "'FRESH_REFRESHED' freshness", "0L observed_at")
    more = rows.withColumns({"scope": F.lit("/a"), "declared": F.lit(10_001)})
    covered = lambda df, **kw: {r["scope"]: r["covered"] for r in controls.coverage_ok(df, F.lit(0), **kw).collect()}
    assert covered(rows) == {"/a": True, "/b": True} and covered(rows, most=9999) == {"/a": False, "/b": True}
    assert covered(more) == {"/a": False} and covered(more, most=None) == {"/a": True}


def test_due_retries_that_tie(spark):
    """Rows that repeat a root and scope are picked the same, however they lie in partitions."""
    w = spark.range(60).selectExpr("'r' root_id", "'/' scope", "id tie", "'RETRY_WAIT' work_state", "0L not_before", "'THROTTLED' error_class", "1 failures")
    r = spark.createDataFrame([("r", "ACTIVE")], "root_id string, lifecycle string")
    watches = spark.createDataFrame([], "root_id string, scope string, watch_state string, cadence string, source_set array<string>")
    adapters = spark.createDataFrame([], "root_id string, kind string, mirror boolean, token string, username string, password string")
    orders = (w.coalesce(1), w.coalesce(1).sortWithinPartitions(F.desc("tie")), w.repartition(7, "tie"))
    assert [[x["tie"] for x in selectors.due_retries(o, r, watches, adapters, F.lit(0), 5).collect()] for o in orders] == [[0, 1, 2, 3, 4]] * 3
