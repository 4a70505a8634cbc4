"""One run: plan sources, normalize payloads, judge, compare with history, report, commit."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, ledger
from ..operators.ranking import evaluate
from ..rules import RuleSet, load_rules
from ..schema import POSTING, USABLE_RUN
from ..sources.base import REGISTRY, RESULT, Request, Scan
from ..sources import boards, pages  # noqa: F401  register the normalizers
from ..state import StateStore
from . import reports

SKIPPED = {"workday": "Disabled pending per-tenant review or explicit access approval.", "": "Research universe only: no supported safe read-only connector is enabled."}


@dataclass
class Run:
    metadata: dict[str, Any]
    decided: DataFrame
    results: DataFrame
    folder: Path | None = None


def run_id_for(now: datetime, suffix: str | None = None) -> str:
    return f"{now.astimezone(timezone.utc):%Y%m%dT%H%M%SZ}-{suffix or uuid.uuid4().hex[:8]}"


def selected(companies: DataFrame, ids: list[str] | None) -> DataFrame:
    """Enabled companies, or those of them that are named; ValueError for a name that is unknown or disabled."""
    on = companies.where("enabled")
    if not ids:
        return on
    wanted = on.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "id string")
    missing = sorted(r["id"] for r in absent(wanted, on).collect())
    if missing:
        raise ValueError(f"unknown or disabled companies: {missing}")
    return on.where(F.col("id").isin(*ids))


def absent(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Ids that are wanted but not there, each once."""
    return wanted.select("id").distinct().join(there.select("id"), "id", "left_anti")


def validate_companies(companies: DataFrame) -> list[str]:
    """What is wrong with a company table, in words."""
    on = companies.where("enabled")
    unknown = on.where(~F.col("connector_type").isin(*REGISTRY)).select("id", "connector_type").orderBy("id").collect()
    urls = on.select("id", F.explode(F.regexp_extract_all("connector", F.lit(r"(http://[^\"]+)"), 1)).alias("url")).orderBy("id", "url").collect()
    twice = companies.groupBy("id").count().where("count > 1").orderBy("id").collect()
    return [f"{r['id']}: unknown connector type {r['connector_type']}" for r in unknown] + [f"{r['id']}: {r['url']} is not https" for r in urls] + [f"{r['id']}: listed {r['count']} times" for r in twice]


def scan(spark: SparkSession, companies: DataFrame, payloads: DataFrame, known: DataFrame, rules: RuleSet, now) -> Scan:
    """All sources' postings and results: each connector type is one set-based plan over its own companies."""
    kinds = sorted(r["connector_type"] for r in companies.select("connector_type").distinct().collect())
    postings, results = spark.createDataFrame([], POSTING), spark.createDataFrame([], RESULT)
    for kind in kinds:
        own = companies.where(F.col("connector_type") == kind)
        mine = payloads.join(F.broadcast(own.select(F.col("id").alias("company_id"))), "company_id", "left_semi")
        if kind not in REGISTRY:
            bad = own.select(F.col("id").alias("company_id"), F.lit(kind).alias("source"), F.lit(0).cast("long").alias("fetched_jobs"), F.lit(0).cast("long").alias("requests"), F.lit(f"ValueError: unknown connector type: {kind}").alias("error"), F.lit("").alias("warning"), F.lit(False).alias("skipped"), F.lit(True).alias("cursor_complete"))
            results = results.unionByName(bad)
            continue
        done = REGISTRY[kind](Request(mine, own, known, rules, now))
        postings, results = postings.unionByName(done.postings), results.unionByName(done.results)
    return Scan(postings, results)


def crawl(spark: SparkSession, companies: DataFrame, payloads: DataFrame, store: StateStore, profile: dict[str, Any], now: datetime, mode: str = "auto", output: Path | None = None, ids: list[str] | None = None, suffix: str | None = None) -> Run:
    """Run once over a bronze table of payloads and commit the outcome.

    mode: initial, incremental, or auto (incremental once a usable run exists). A run without a healthy source is recorded
    as failed: its sightings and source results are kept, watermarks, deliveries and cursors stay as they were.
    """
    if mode not in ("auto", "initial", "incremental"):
        raise ValueError("mode must be auto, initial or incremental")
    rules, at = load_rules(profile), F.lit(now)
    with store.lock():
        runs, jobs, sightings, company_runs, prints, receipts = (store.read(t) for t in ("runs", "jobs", "sightings", "company_runs", "profile_fingerprints", "receipts"))
        had = history.latest_run(runs).first()["started_at"] is not None
        mode = "incremental" if had and mode != "initial" else "initial"
        run_id = run_id_for(now, suffix)
        chosen = selected(companies, ids)
        planned = history.plan_sources(chosen, history.cursors(company_runs, runs), prints, rules, mode, at)
        done = scan(spark, planned, payloads, jobs.select("company_id", "source_url", "posted_at", "last_seen_at"), rules, at)
        off = companies.where("not enabled") if not ids else companies.limit(0)
        idle = off.select(F.col("id").alias("company_id"), F.col("connector_type").alias("source"), F.lit(0).cast("long").alias("fetched_jobs"), F.lit(0).cast("long").alias("requests"), F.lit("").alias("error"), F.when(F.col("connector_type") == "workday", SKIPPED["workday"]).otherwise(SKIPPED[""]).alias("warning"), F.lit(True).alias("skipped"), F.lit(True).alias("cursor_complete"))
        results = store.stage(run_id, "results", ledger.source_status(done.results))
        about = planned.select(F.col("id").alias("company_id"), "confidence", "score", "summary", "default_country", "mode", "since")
        good = results.where("status in ('ok', 'degraded')").select("company_id")
        seq = F.struct("company_id", "source", "source_job_id", "source_url", "title")
        postings = done.postings.join(good, "company_id", "left_semi").join(F.broadcast(about), "company_id").withColumn("seq", seq)
        postings = store.stage(run_id, "postings", postings)  # both branches of the evaluation read it
        judged = history.keyed(evaluate(postings, rules, at))
        decided = store.stage(run_id, "decided", history.decide_events(judged, jobs, receipts, history.delivered(sightings, runs), rules, at))

        stats = ledger.run_statistics(results).withColumn("status", ledger.run_status(F.col("companies_ok"), F.col("companies_degraded"), F.col("companies_failed"))).first().asDict()
        keep = stats["status"] != "failed"
        source_rows = results.select(F.lit(run_id).alias("run_id"), "company_id", "source", "status", F.col("fetched_jobs").cast("int").alias("fetched_jobs"), F.col("requests").cast("int").alias("requests"), "error", "warning")
        seen = decided.select(F.lit(run_id).alias("run_id"), "job_key", at.alias("seen_at"), "posted_at", "accepted", (F.col("emit") & F.lit(keep)).alias("emitted"), "match_score", "priority", F.col("stored_event").alias("event_type"), "seq")
        seen = seen.withColumn("emitted", F.max("emitted").over(history.Window.partitionBy("job_key"))).withColumn("_rn", F.row_number().over(history.Window.partitionBy("job_key").orderBy(F.desc("seq")))).where("_rn = 1").drop("_rn", "seq")
        totals = decided.agg(F.count_if("accepted").alias("accepted"), F.count_if("emit").alias("emitted")).first()
        row = [(run_id, now, now, mode, stats["status"], int(planned.count()), stats["companies_ok"], stats["companies_failed"], int(stats["fetched_jobs"]), totals["accepted"], totals["emitted"] if keep else 0, "")]
        run_row = spark.createDataFrame(row, store.read("runs").schema)
        metadata = {"run_id": run_id, "mode": mode, "status": stats["status"], "started_at": now.isoformat(), "profile_fingerprint": rules.fingerprint, "companies_enabled": row[0][5], **{k: stats[k] for k in ("companies_ok", "companies_failed", "companies_degraded")}, "fetched_jobs": row[0][8], "accepted_jobs": totals["accepted"], "emitted_jobs": row[0][10]}
        metadata["profile_backfill_companies"] = planned.where("backfill").count()
        rows = reports.report_rows(decided, at)
        rejected = history.top_rejections(rows.where("not emit and rejection_reasons != ''"), rules.max_rejections if rules.include_rejections else 0)
        sick = ledger.health(results.unionByName(ledger.source_status(idle)), companies)
        reports.write_tables(f"{store.root}/reports/{run_id}", rows.where(F.col("emit") & F.lit(keep)), rejected, sick)
        folder = None
        if output is not None:
            none = lambda: iter(())
            matched = reports.rows_of(reports.matches(rows)) if keep else none
            folder = reports.export_run(output, metadata, matched, reports.rows_of(rejected.orderBy("seq", "job_key")), reports.rows_of(sick.orderBy("company")), str(profile.get("reporting", {}).get("html_title", "Verified job matches")))
        tables = {"runs": history.upsert(runs, run_row, ["run_id"]), "company_runs": history.upsert(company_runs, source_rows, ["run_id", "company_id"]), "jobs": history.merge_jobs(jobs, decided, at, promote=keep)}
        if keep:
            whole = results.where("status = 'ok'").select("company_id", "source", F.lit(rules.fingerprint).alias("profile_fingerprint"), at.alias("applied_at"))
            tables["profile_fingerprints"] = history.upsert(prints, whole, ["company_id", "source"])
        store.commit(run_id, append={"sightings": seen}, **tables)
        return Run(metadata, decided, results, folder)


def import_receipts(store: StateStore, payload: dict[str, Any], run_id: str) -> int:
    """Add receipts of reports delivered elsewhere; all or none. ValueError for a bad payload."""
    if payload.get("schema_version") != 1 or not payload.get("report_id") or not isinstance(payload.get("jobs"), list):
        raise ValueError("not a receipts payload")
    from ..functions.text import parse_datetime

    spark = store.spark
    rows = spark.createDataFrame([(str(j.get("job_key", "")), str(j.get("posted_at") or "")) for j in payload["jobs"]], "job_key string, at string")
    now = F.lit(datetime(2000, 1, 1))
    new = rows.select("job_key", parse_datetime(F.col("at"), now).alias("posted_at"), parse_datetime(F.lit(str(payload.get("reported_at") or "")), now).alias("reported_at"), F.lit(payload["report_id"]).alias("report_id"))
    if history.bad_receipts(new).limit(1).count() or new.where("reported_at is null").limit(1).count():
        raise ValueError("a receipt lacks a valid key or date")
    store.commit(run_id, receipts=history.merge_receipts(store.read("receipts"), new))
    return len(payload["jobs"])


def acknowledge(store: StateStore, run_id: str, reported_at: datetime) -> int:
    """Add receipts for all that a usable run reported, from its report table, whatever its size; the number of keys."""
    usable = store.read("runs").where((F.col("run_id") == run_id) & F.col("status").isin(*USABLE_RUN))
    if not usable.limit(1).count():
        raise ValueError("only a usable run's report can be acknowledged")
    told = store.spark.read.parquet(f"{store.root}/reports/{run_id}/matches")
    new = told.select("job_key", F.to_timestamp("posted_at").alias("posted_at"), F.lit(reported_at).alias("reported_at"), F.lit(run_id).alias("report_id"))
    if history.bad_receipts(new).limit(1).count():
        raise ValueError("a reported job lacks a valid key or date")
    store.commit(f"ack-{run_id}", receipts=history.merge_receipts(store.read("receipts"), new))
    return new.count()
