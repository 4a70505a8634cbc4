from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postlake.queries import FEEDS, scan_feed
from postlake.sources.base import normalizer
from postlake.sources.files import newest_pages


def one(scan):
    return scan.results.first().asDict()


def test_results_say_what_is_incomplete(spark):
    g = one(scan_feed(spark, "greenhouse"))
    assert g["fetched_jobs"] == 2 and not g["cursor_complete"] and "budget" in g["warning"]
    lever = one(scan_feed(spark, "lever"))
    assert lever["fetched_jobs"] == 2 and not lever["cursor_complete"] and "unverified" in lever["warning"]
    s = one(scan_feed(spark, "sitemap"))
    assert not s["cursor_complete"] and "mismatched" in s["warning"] and "budget" in s["warning"]
    assert one(scan_feed(spark, "ashby"))["cursor_complete"]
    assert not one(scan_feed(spark, "jsonld_pages"))["cursor_complete"]


def test_lever_repost_is_verified_against_the_stored_date(spark):
    rows = FEEDS["lever"]
    known = [("co", "https://h/d", datetime(2022, 1, 1), datetime(2022, 1, 2))]
    got = {r["source_job_id"]: r for r in scan_feed(spark, "lever", "incremental", known).postings.collect()}
    assert got["d"]["posting_date_kind"] == "jsonld_datePosted_verified_repost" and got["d"]["posted_at"] == datetime(2023, 1, 1)
    assert rows


def test_sources_need_their_permission(spark, monkeypatch):
    for name in ("smartrecruiters", "workday"):
        connector, payloads, expected = FEEDS[name]
        monkeypatch.setitem(FEEDS, name, ({}, payloads, expected))
        scan = scan_feed(spark, name)
        assert scan.postings.count() == 0 and one(scan)["skipped"]


def test_unknown_connector():
    with pytest.raises(ValueError):
        normalizer("nothing")


def test_not_modified_keeps_the_body(spark):
    rows = [("u", "e1", None, datetime(2024, 1, 1), 200, b"a"), ("u", None, None, datetime(2024, 1, 2), 304, b""), ("v", None, None, datetime(2024, 1, 1), 404, b"x")]
    df = spark.createDataFrame(rows, "url string, etag string, last_modified string, fetched_at timestamp, status int, body binary")
    got = {r["url"]: r for r in newest_pages(df).collect()}
    assert bytes(got["u"]["body"]) == b"a" and got["u"]["status"] == 200 and got["u"]["etag"] == "e1" and got["v"]["status"] == 404


def test_parse_robots(spark):
    from postlake.operators import robots

    body = "User-agent: a\nUser-agent: *\nDisallow: /\nAllow: /jobs # c\n\nUser-agent: monitor\nDisallow:\nDisallow: /x$\n"
    rules = robots.parse(spark.createDataFrame([("h", body)], "host string, body string"))
    t = spark.createDataFrame([("h", "/x"), ("h", "/x1"), ("h", "/jobs/1"), ("o", "/")], "host string, target string")
    ask = lambda agent: {(r["host"], r["target"]): r["can_fetch"] for r in robots.allowed(t, rules, agent).collect()}
    assert ask("monitor/2.0") == {("h", "/x"): False, ("h", "/x1"): True, ("h", "/jobs/1"): True, ("o", "/"): True}
    assert ask("zebra") == {("h", "/x"): False, ("h", "/x1"): False, ("h", "/jobs/1"): True, ("o", "/"): True}
    assert F is not None
