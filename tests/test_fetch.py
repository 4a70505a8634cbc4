"""Requests against a server of our own."""

import plistlib
import threading
import time
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from postlake.plans.schedule import crontab, launchd
from postlake.schema import STATE
from postlake.sources import fetch as f

ASKED: list[tuple[str, str, float]] = []


class Site(BaseHTTPRequestHandler):
    robots = (200, "User-agent: *\nDisallow: /private\n")

    def reply(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        n = sum(p == self.path for _, p, _ in ASKED)
        ASKED.append(("GET", self.path, time.monotonic()))
        if self.path == "/robots.txt":
            return self.reply(self.robots[0], self.robots[1].encode())
        if self.path == "/flaky" and n < 1:
            return self.reply(503, Retry_After="0")
        if self.path == "/same" and self.headers.get("If-None-Match") == "v1":
            return self.reply(304)
        if self.path == "/big":
            return self.reply(200, b"x" * 5000)
        if self.path == "/none":
            return self.reply(404, b"no")
        return self.reply(200, f"page {self.path} é".encode(), ETag="v1", Content_Type="text/html; charset=utf-8")

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        ASKED.append(("POST", self.path, time.monotonic()))
        self.reply(200, b"posted " + body)

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    ASKED.clear()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    Site.robots = (200, "User-agent: *\nDisallow: /private\n")


def ask(spark, rows, stored=(), **more):
    requests = spark.createDataFrame([("acme", "page", url, k, url, method, body, policy, 0.05) for k, (url, method, body, policy) in enumerate(rows)], f.REQUEST)
    pages = spark.createDataFrame(list(stored), STATE["raw_pages"])
    got = f.fetch(requests, pages, "monitor/1.0", interval=0.05, **more)
    return {r["key"]: r for r in got.collect()}, got


def test_requests_are_polite_and_whole(spark, site):
    stored = [(f"{site}/same", "v1", None, datetime(2024, 1, 1), 200, bytearray(b"stored body"))]
    paths = ["/a b", "/flaky", "/same", "/big", "/none", "/private/x"]
    rows = [(site + p, "GET", None, "strict") for p in paths] + [(f"{site}/post", "POST", '{"q": 1}', "strict"), (f"{site}/private/api", None, None, "documented_public_api"), (f"{site}/off", "GET", None, "disabled"), (None, "GET", None, None)]
    got, _ = ask(spark, rows, stored, tries=1, most=1000)
    at = lambda p: got[site + p]
    assert at("/a b")["body"] == "page /a%20b é" and at("/a b")["etag"] == "v1"
    assert at("/flaky")["status"] == 200 and at("/flaky")["requests"] == 2
    assert at("/same")["from_cache"] and at("/same")["status"] == 200 and at("/same")["body"] == "stored body"
    assert at("/big")["status"] == 0 and "longer than 1000" in at("/big")["error"]
    assert at("/none")["status"] == 404 and at("/none")["requests"] == 1
    assert at("/private/x")["status"] == 0 and at("/private/x")["error"] == "disallowed by robots.txt" and at("/private/x")["requests"] == 0
    assert at("/post")["body"] == 'posted {"q": 1}' and at("/private/api")["status"] == 200
    assert "disabled" in at("/off")["error"] and got[None]["error"] == "the URL cannot be requested"
    times = sorted(t for _, p, t in ASKED if p != "/robots.txt")
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.04
    assert sum(p == "/robots.txt" for _, p, _ in ASKED) == 1


@pytest.mark.parametrize("status,allowed", [(404, True), (403, False), (410, False)])
def test_rules_that_cannot_be_had_permit_nothing(spark, site, status, allowed):
    Site.robots = (status, "")
    got, df = ask(spark, [(f"{site}/a", "GET", None, "strict")], tries=0)
    assert (got[f"{site}/a"]["status"] == 200) is allowed
    assert f.payloads(df).columns == ["company_id", "kind", "key", "page", "status", "body"]


def test_a_host_without_an_answer(spark):
    got, df = ask(spark, [("http://127.0.0.1:9/a", "GET", None, "strict")], tries=0, timeout=2.0)
    assert got["http://127.0.0.1:9/a"]["error"].startswith("robots.txt unavailable") and f.pages(df).count() == 0


def test_the_command_fills_payloads_and_stored_pages(spark, site, tmp_path, capsys):
    import json

    from postlake.cli import main
    from postlake.state import StateStore

    (tmp_path / "r.json").write_text("\n".join(json.dumps({"company_id": "acme", "kind": "page", "key": p, "page": 0, "url": site + p}) for p in ("/same", "/none")))
    for k in range(2):
        assert main(["fetch", "--requests", f"{tmp_path}/r.json", "--payloads", f"{tmp_path}/p{k}", "--state", f"{tmp_path}/s", "--agent", "monitor/1.0", "--interval", "0.05"], spark) == 0
        assert {r["key"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/p{k}").collect()} == {"/same": 200, "/none": 404}
    assert StateStore(spark, f"{tmp_path}/s").read("raw_pages").count() == 1  # the second answer was "not modified"
    assert main(["schedule", "--", "python", "-m", "postlake"]) == 0 and "17 19 * * * python -m postlake" in capsys.readouterr().out


def test_pauses():
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert f.pause_asked("7", now) == 7 and f.pause_asked(None, now) is None and f.pause_asked("soon", now) is None
    assert f.pause_asked("Mon, 01 Jan 2024 00:01:00 GMT", now) == 60


def test_schedules():
    assert crontab(["python", "-m", "postlake", "crawl"]).splitlines()[1] == "17 7 * * * python -m postlake crawl"
    plist = plistlib.loads(launchd("own.monitor", ["python", "a&b"], "/x", "/y").encode())
    assert plist["ProgramArguments"] == ["python", "a&b"] and plist["StartCalendarInterval"][1] == {"Hour": 19, "Minute": 17}
