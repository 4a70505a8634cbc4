import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postlake.operators import history
from postlake.plans.crawl import acknowledge, crawl, import_receipts
from postlake.plans.reports import MATCH_COLUMNS, last_error, load_report, merge_section, receipts_baseline, status_page, summary
from postlake.sources.base import PAYLOAD
from postlake.sources.files import companies
from postlake.state import StateStore

START = datetime(2024, 1, 20, 12)
PROFILE = {"filters": {"min_match_score": 40, "p1_match_score": 50, "p0_match_score": 82}, "candidate": {}}
TEXT = "Build backend services in Java. 3+ years of experience."


def table(spark, *ids, **more):
    return companies(spark, [{"id": i, "name": i.title(), "careers_url": f"https://{i}.example", "connector": {"type": "greenhouse", "default_country": "US"}, "sponsorship": {"confidence": "high", "score": 0.82, "summary": "s"}, **more} for i in ids])


def board(spark, *rows, status=200):
    """rows: (company, id, first published, title?)"""
    by = {}
    for company, job, published, *title in rows:
        by.setdefault(company, []).append({"id": job, "internal_job_id": 1, "title": title[0] if title else "Platform Engineer", "first_published": published, "location": {"name": "Austin, TX"}, "absolute_url": f"https://{company}.example/{job}", "content": TEXT})
    return spark.createDataFrame([(c, "list", "u", 0, status, json.dumps({"jobs": jobs, "meta": {"total": len(jobs)}})) for c, jobs in by.items()], PAYLOAD)


def emitted(run):
    return sorted((r["source_job_id"], r["event"]) for r in run.decided.where("emit").select("source_job_id", "event").collect())


def test_runs_find_new_seen_and_reposted(spark, tmp_path):
    store, cos = StateStore(spark, f"{tmp_path}/state"), table(spark, "acme")
    first = crawl(spark, cos, board(spark, ("acme", 1, "2024-01-19"), ("acme", 2, "2023-01-01")), store, PROFILE, START, output=tmp_path / "out")
    assert first.metadata["mode"] == "initial" and first.metadata["status"] == "success" and first.metadata["emitted_jobs"] == 1
    header = (first.folder / "matches.csv").read_text().splitlines()[0]
    assert header.split(",") == MATCH_COLUMNS
    assert json.loads((tmp_path / "out/latest.json").read_text())["jobs"][0]["source_job_id"] == "1"
    assert "not a verified posting" in (first.folder / "rejections_audit.csv").read_text()
    second = crawl(spark, cos, board(spark, ("acme", 1, "2024-01-19"), ("acme", 3, "2024-01-20T10:00:00Z")), store, PROFILE, START + timedelta(hours=12))
    assert second.metadata["mode"] == "incremental" and emitted(second) == [("3", "new")]
    third = crawl(spark, cos, board(spark, ("acme", 1, "2024-01-21")), store, PROFILE, START + timedelta(hours=36))
    assert emitted(third) == [("1", "reposted")]
    assert store.read("runs").count() == 3 and store.read("sightings").count() == 5
    jobs = {r["source_job_id"]: r for r in store.read("jobs").collect()}
    assert jobs["1"]["posted_at"] == datetime(2024, 1, 21) and jobs["1"]["first_seen_at"] == START


def test_failed_and_partial_runs(spark, tmp_path):
    store, cos = StateStore(spark, f"{tmp_path}/state"), table(spark, "acme", "beta")
    bad = crawl(spark, cos, board(spark, ("acme", 1, "2024-01-19"), ("beta", 1, "2024-01-19"), status=503), store, PROFILE, START)
    assert bad.metadata["status"] == "failed" and store.read("profile_fingerprints").count() == 0
    both = board(spark, ("acme", 1, "2024-01-19")).unionByName(board(spark, ("beta", 1, "2024-01-19"), status=503))
    part = crawl(spark, cos, both, store, PROFILE, START + timedelta(hours=1))
    assert part.metadata["status"] == "partial" and part.metadata["mode"] == "initial" and len(emitted(part)) == 1
    assert [r["company_id"] for r in store.read("profile_fingerprints").collect()] == ["acme"]
    changed = crawl(spark, cos, both, store, {**PROFILE, "filters": {**PROFILE["filters"], "max_required_years": 5}}, START + timedelta(hours=2))
    assert changed.metadata["profile_backfill_companies"] == 2 and emitted(changed) == []


def test_receipts_count_as_delivered(spark, tmp_path):
    store, cos = StateStore(spark, f"{tmp_path}/state"), table(spark, "acme")
    key = history.keyed(spark.createDataFrame([("acme", "1", "", "", "", "")], "company_id string, source_job_id string, source_url string, title string, location string, description string")).first()["job_key"]
    assert import_receipts(store, {"schema_version": 1, "report_id": "r", "reported_at": "2024-01-19", "jobs": [{"job_key": key, "posted_at": "2024-01-19"}]}, "imp") == 1
    assert import_receipts(store, {"schema_version": 1, "report_id": "old", "reported_at": "2024-01-19", "jobs": [{"job_key": key, "posted_at": "2024-01-01"}]}, "imp2") == 1
    assert store.read("receipts").first()["report_id"] == "r"
    with pytest.raises(ValueError):
        import_receipts(store, {"schema_version": 1, "report_id": "r", "reported_at": "2024-01-19", "jobs": [{"job_key": "x", "posted_at": "2024-01-19"}]}, "imp3")
    run = crawl(spark, cos, board(spark, ("acme", 1, "2024-01-19")), store, PROFILE, START)
    assert emitted(run) == []


def test_lock_backup_and_restore(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    crawl(spark, table(spark, "acme"), board(spark, ("acme", 1, "2024-01-19")), store, PROFILE, START)
    with store.lock(), pytest.raises(RuntimeError):
        store.lock().__enter__()
    manifest = store.backup(f"{tmp_path}/backup")
    assert manifest["rows"]["jobs"] == 1
    with pytest.raises(FileExistsError):
        store.backup(f"{tmp_path}/backup")
    other = StateStore(spark, f"{tmp_path}/new")
    other.restore(f"{tmp_path}/backup")
    assert other.read("sightings").count() == store.read("sightings").count()
    with pytest.raises(FileExistsError):
        other.restore(f"{tmp_path}/backup")


def test_a_lock_that_was_left_is_taken_over_once(spark, tmp_path):
    import os
    import time

    store = StateStore(spark, f"{tmp_path}/state")
    dead = store.lock("dead")
    dead.__enter__()
    old = time.time() - 7 * 3600
    os.utime(tmp_path / "state/LOCK", (old, old))
    with store.lock("next"):
        with pytest.raises(RuntimeError, match="next"):
            store.lock("third").__enter__()
        dead.__exit__()  # it comes back to life, but the lock is no longer its own
        assert "next" in (tmp_path / "state/LOCK").read_text()
    assert not (tmp_path / "state/LOCK").exists()


def test_commits_add_parts_and_never_replace_a_manifest(spark, tmp_path, monkeypatch):
    import postlake.state as state

    monkeypatch.setattr(state, "PARTS", 3)
    store = StateStore(spark, f"{tmp_path}/state")
    row = lambda k: spark.createDataFrame([(f"k{k}", START, START, "r")], state.STATE["receipts"])
    for k in range(5):
        store.commit(f"r{k}", append={"receipts": row(k)})
        assert sorted(r["job_key"] for r in store.read("receipts").collect()) == [f"k{j}" for j in range(k + 1)]
    assert len(store.manifest()["tables"]["receipts"]) == 2 and len(list((tmp_path / "state/manifests").glob("0*.json"))) == 5
    number = store._newest()
    with pytest.raises(FileExistsError):
        store._publish("other", {}, number - 1)  # a writer that did not see the last commit
    assert store.manifest()["run_id"] == "r4"


def test_a_report_of_any_length_is_acknowledged(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    run = crawl(spark, table(spark, "acme"), board(spark, ("acme", 1, "2024-01-19"), ("acme", 2, "2024-01-18")), store, PROFILE, START, output=tmp_path / "out")
    told = json.loads((run.folder / "matches.json").read_text())
    assert [j["source_job_id"] for j in told["jobs"]] and len(told["jobs"]) == 2 == told["metadata"]["emitted_jobs"]
    assert "## P" in (run.folder / "daily_report.md").read_text() and (run.folder / "daily_report.html").read_text().count("<section") == 2
    assert acknowledge(store, run.metadata["run_id"], START) == 2 and store.read("receipts").count() == 2
    with pytest.raises(ValueError):
        acknowledge(store, "none", START)
    seen = history.has_seen(store.read("jobs"), store.read("jobs").select("job_key").unionByName(spark.createDataFrame([("x",)], "job_key string")))
    assert sorted(r["seen"] for r in seen.collect()) == [False, True, True]


def test_bootstrap_takes_recent_checked_backups_only(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    crawl(spark, table(spark, "acme"), board(spark, ("acme", 1, "2024-01-19")), store, PROFILE, START)
    store.backup(f"{tmp_path}/backup")
    fresh = lambda name: StateStore(spark, f"{tmp_path}/{name}")
    assert fresh("a").bootstrap(f"{tmp_path}/none", START) == "missing"
    assert fresh("a").bootstrap(f"{tmp_path}/backup", START + timedelta(hours=73)) == "stale"
    assert fresh("a").manifest()["tables"] == {}
    assert fresh("a").bootstrap(f"{tmp_path}/backup", START + timedelta(hours=71)) == "restored"
    assert fresh("a").bootstrap(f"{tmp_path}/backup", START) == "present"
    part = next((tmp_path / "backup/jobs").rglob("part-*.parquet"))
    store.read("jobs").withColumn("title", F.lit("changed")).coalesce(1).write.parquet(f"{tmp_path}/other")  # as many rows, other content
    whole = part.read_bytes()
    part.write_bytes(next((tmp_path / "other").rglob("part-*.parquet")).read_bytes())
    for crc in (tmp_path / "backup").rglob(".*.crc"):
        crc.unlink()
    assert fresh("c").bootstrap(f"{tmp_path}/backup", START) == "damaged"
    part.write_bytes(whole)
    manifest = tmp_path / "backup/MANIFEST"
    manifest.write_text(manifest.read_text().replace('"jobs": 1', '"jobs": 2'))
    (tmp_path / "backup/.MANIFEST.crc").unlink(missing_ok=True)
    assert fresh("b").bootstrap(f"{tmp_path}/backup", START) == "damaged"


def test_a_lost_backup_refuses_a_rollback(spark):
    from postlake.state import newest_backup

    backups = spark.createDataFrame([("r1", START, "p1"), ("r2", START + timedelta(1), "p2")], "run_id string, at timestamp, path string")
    reports = lambda *rows: spark.createDataFrame(list(rows), "run_id string, at timestamp")
    assert newest_backup(backups, reports(("r2", START + timedelta(1)))).first()["path"] == "p2"
    assert newest_backup(backups, reports(("r3", START + timedelta(2)))).count() == 0
    assert newest_backup(backups.limit(0), reports()).count() == 0


def test_all_report_rows_are_written_as_tables(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    run = crawl(spark, table(spark, "acme"), board(spark, ("acme", 1, "2024-01-19"), ("acme", 2, "2023-01-19")), store, PROFILE, START)
    base = f"{tmp_path}/state/reports/{run.metadata['run_id']}"
    assert spark.read.parquet(f"{base}/matches").columns == [*MATCH_COLUMNS, "job_key"]
    assert [spark.read.parquet(f"{base}/{t}").count() for t in ("matches", "rejections", "health")] == [1, 1, 1]


def test_unknown_company_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        crawl(spark, table(spark, "acme"), board(spark, ("acme", 1, "2024-01-19")), StateStore(spark, f"{tmp_path}/s"), PROFILE, START, ids=["nobody"])


def test_replay_equals_run_by_run(spark):
    """Two windowed passes against the truth table applied one run after the other."""
    import random

    rng, rows, expected = random.Random(5), [], {}
    for key in range(60):
        known, sent, mark = False, False, None
        for run in range(8):
            at = START + timedelta(hours=12 * run)
            usable, accepted, initial = rng.random() < 0.8, rng.random() < 0.8, rng.random() < 0.2
            posted = None if rng.random() < 0.1 else at - timedelta(hours=rng.randrange(0, 60))
            since = at - timedelta(hours=36)
            window = posted is not None and since <= posted <= at + timedelta(hours=24)
            repost = not initial and sent and posted is not None and mark is not None and posted > mark + timedelta(hours=12) and posted >= since
            emit = usable and accepted and (repost if sent else window)
            rows.append((f"r{run}", at, usable, "initial" if initial else "incremental", since, str(key), posted, posted is not None, accepted, True))
            expected[str(key), f"r{run}"] = emit
            if posted is not None and (usable or not known):
                mark = posted if mark is None else max(mark, posted)
            known, sent = True, sent or emit
    df = spark.createDataFrame(rows, "run_id string, run_at timestamp, usable boolean, mode string, since timestamp, job_key string, posted_at timestamp, verified boolean, accepted boolean, open boolean")
    got = {(r["job_key"], r["run_id"]): r["emitted"] for r in history.replay(df).collect()}
    assert got == expected and any(expected.values())


def test_reports_and_ledger_texts(spark, tmp_path):
    report = {"metadata": {"run_id": "r", "status": "partial", "started_at": "2024-01-20", "companies_failed": 1}, "jobs": [{"apply_priority": "P1", "title": "a [b]", "company": "c", "apply_url": "javascript:x", "job_key": "k", "posted_at": "p"}]}
    text, out = summary(report, [], exit_code="2", outcome="failure")
    assert out["alert_kind"] == "source-warning" and out["new_matches"] == 1 and "javascript" not in text and r"a \[b\]" in text
    assert summary({}, [])[1]["alert_kind"] == "failure"
    assert summary({"metadata": {"status": "success"}, "jobs": []}, [])[1]["alert_kind"] == "none"
    once = merge_section("before", "7", "one")
    assert merge_section(once, "7", "two") == once.replace("one", "two") and merge_section(merge_section(once, "8", "x"), "7", "one") == merge_section(once, "8", "x")
    assert receipts_baseline(json.dumps(report).encode())["jobs"] == [{"job_key": "k", "posted_at": "p"}]
    with pytest.raises(ValueError):
        receipts_baseline(json.dumps({**report, "metadata": {**report["metadata"], "status": "failed"}}).encode())
    (tmp_path / "bad.json").write_text("{")
    assert load_report(tmp_path / "bad.json") == {} == load_report(tmp_path / "none.json")
    log = spark.createDataFrame([(0, "Error: a"), (1, "fine"), (2, "Fatal error: b"), (3, "fine")], "lineno int, value string")
    assert last_error(log).first()["last_error"] == "Fatal error: b"
    assert "needs attention".upper() in status_page({"window_key": "w", "window_complete": False, "next_target_at": "n", "reason": "r"}, "needs attention", {}, [], [])
