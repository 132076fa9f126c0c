"""Sources over the wire: walks, scoped refreshes, the data source, and programs, against a server of the test's own."""

import json
import stat
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ledgerline.sources import alist, listings

TREE = {"/": ["d/", "f"], "/d": ["e/", "g"], "/d/e": [f"x{i}" for i in range(7)], "/many": [f"x{i}" for i in range(9)], "/twice": ["a", "a"], "/short": ["a"], "/auth": 403, "/slow": 429, "/http": 500}


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, got, status=200):
            raw = json.dumps(got).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self.answer({"code": 200, "data": {"base_path": "/home"}})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/api/auth/login":
                return self.answer({"code": 200, "data": {"token": "t"}} if body["password"] == "right" else {"code": 401})
            if self.headers["Authorization"] != "t":
                return self.answer({"code": 401})
            asked.append((body["path"], body["page"], body["per_page"], body["refresh"]))
            names = TREE.get(body["path"], [])
            if isinstance(names, int):
                return self.answer({"code": names}, 500 if names == 500 else 200)
            rows = [{"name": n.rstrip("/"), "size": 3, "is_dir": n.endswith("/"), "modified": "2024-01-01T00:00:00Z", "hash_info": {"md5": "m", "sha1": "s"}} for n in names]
            lo = (body["page"] - 1) * body["per_page"]
            return self.answer({"code": 200, "data": {"content": rows[lo : lo + body["per_page"]], "total": len(rows) + (body["path"] == "/short")}})

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_walk(spark, server):
    url, asked = server
    rows, ev = listings.collect(spark, "openlist", url, username="u", password="right", per_page=3)
    got = {(r["parent_ref"], r["name"]): r for r in rows.collect()}
    assert set(got) == {("/", "d"), ("/", "f"), ("/d", "e"), ("/d", "g"), *[("/d/e", f"x{i}") for i in range(7)]}
    assert (got["/", "f"]["hash"], got["/", "f"]["alg"], got["/", "f"]["size"], got["/", "d"]["size"]) == ("s", "sha1", 3, None)
    e = ev.first()
    assert (e["traversal"], e["freshness"], e["assurance"], e["skipped_known_empty"]) == ("SUCCESS", "FRESH_DIRECT", "WEAK_FAILURE_VISIBILITY", False)
    assert [p for p in asked if p[0] == "/d/e"] == [("/d/e", k, 3, False) for k in (1, 2, 3)]
    for top, options in (("/short", {}), ("/auth", {}), ("/", {"password": "wrong"})):
        rows, ev = listings.collect(spark, "alist", url, top=top, **{"username": "u", "password": "right"} | options)
        assert rows.count() == 0 and ev.first()["traversal"] == "FAILED" and json.loads(ev.first()["error_summary"])["message"].startswith(top)
    with pytest.raises(ValueError):
        alist.Provider("ftp://x")


def test_scoped(spark, server):
    url, asked = server
    p = alist.Provider(url, token="t", base_path="/home")
    rows, ev, error = alist.scan_scope(spark, p, "/d", 2)
    assert error is None and {r["name"] for r in rows.collect()} == {"e", "g"} and asked[-1] == ("/d", 1, 3, True)
    assert (ev.first()["traversal"], ev.first()["freshness"]) == ("PARTIAL", "FRESH_REFRESHED")
    errors = {s: alist.scan_scope(spark, p, s, 8)[2] for s in ("/many", "/twice", "/short", "/auth", "/slow", "/http")}
    assert errors == {"/many": "SCOPE_TOO_LARGE", "/twice": "TRANSIENT_PROVIDER", "/short": "TRANSIENT_PROVIDER", "/auth": "AUTH_OR_PERMISSION", "/slow": "THROTTLED", "/http": "TRANSIENT_PROVIDER"}
    assert alist.scan_scope(spark, alist.Provider(url, token="t", base_path="/other"), "/d")[2] == "AUTH_OR_PERMISSION"
    assert alist.scan_scope(spark, alist.Provider("http://127.0.0.1:9", token="t", timeout=1), "/d")[2] == "TRANSIENT_PROVIDER"
    with pytest.raises(ValueError):
        alist.scan_scope(spark, p, "/d", 1001)


def test_data_source(spark, server):
    spark.dataSource.register(alist.AListSource)
    pages = spark.read.format("alist").options(url=server[0], token="t", scopes=json.dumps(["/", "/d", "/auth"])).load()
    got = {r["scope"]: r["error"] for r in pages.collect()}
    assert got == {"/": None, "/d": None, "/auth": "AUTH_OR_PERMISSION"}
    assert listings.alist_page(pages.filter("error is null")).count() == 4


def test_program(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text('#!/bin/sh\necho \'[{"Path":"a/f","Name":"f","Size":3,"IsDir":false}]\'\n')
    bad.write_text("#!/bin/sh\necho broken >&2\nexit 3\n")
    for p in (good, bad):
        p.chmod(p.stat().st_mode | stat.S_IEXEC)
    rows, ev = listings.collect(spark, "rclone-live", "remote:", program=str(good))
    assert [(r["parent_ref"], r["name"]) for r in rows.collect()] == [("/a", "f")] and ev.first()["traversal"] == "SUCCESS"
    for program in (str(bad), str(tmp_path / "none")):
        rows, ev = listings.collect(spark, "rclone-live", "remote:", program=program)
        assert rows.count() == 0 and ev.first()["traversal"] == "FAILED" and ev.first()["error_summary"]
