"""Queries over the run ledger: statistics, health, session windows, and whether a run is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Session starts in local time, retry rules, and when a due run counts as overdue.
ZONE = "America/Los_Angeles"
SESSION_START = "interval 7 hours 17 minutes"
RETRY_MINUTES, MAX_ATTEMPTS, OVERDUE_MINUTES = 60, 3, 90
ALERT_PRIORITIES = ("P0", "P1", "P2")


def source_status(results: DataFrame) -> DataFrame:
    """results with status: skipped, else error, else degraded, else ok."""
    s = F.when(F.col("skipped"), "skipped").when(F.coalesce(F.col("error"), F.lit("")) != "", "error").when(~F.col("cursor_complete"), "degraded").otherwise("ok")
    return results.withColumn("status", s)


def run_statistics(sources: DataFrame, *by: str) -> DataFrame:
    """One row (or one by the columns named) from sources with status and fetched_jobs; all that is not ok counts as failed, degraded ones besides."""
    return sources.groupBy(*by).agg(
        F.count_if(F.col("status") == "ok").alias("companies_ok"),
        F.count_if(F.col("status") != "ok").alias("companies_failed"),
        F.count_if(F.col("status") == "degraded").alias("companies_degraded"),
        F.coalesce(F.sum("fetched_jobs"), F.lit(0)).alias("fetched_jobs"),
    )


def run_status(ok: Column, degraded: Column, failed: Column) -> Column:
    return F.when(ok + degraded == 0, "failed").when(failed > 0, "partial").otherwise("success")


def health(sources: DataFrame, companies: DataFrame) -> DataFrame:
    """Sources joined to their company, in the columns and order of the health report (sort by company)."""
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "enabled", "careers_url", F.col("confidence").alias("sponsorship_confidence"))
    return sources.join(F.broadcast(c), "company_id").select("company", "company_id", "enabled", "source", "status", F.col("fetched_jobs").alias("jobs_fetched"), "requests", "warning", "error", "careers_url", "sponsorship_confidence")


def failures(health_rows: DataFrame) -> DataFrame:
    """What a summary reports: neither ok nor a disabled source that was skipped."""
    return health_rows.where((F.col("status") != "ok") & ~((F.col("status") == "skipped") & ~F.col("enabled").cast("boolean")))


def expected_companies(companies: DataFrame) -> int:
    """How many sources a full run covers; ValueError if none is enabled."""
    n = companies.where("enabled").count()
    if not n:
        raise ValueError("no company is enabled")
    return n


def session_local(ts: Column) -> Column:
    """Local wall time moved so that sessions start at midnight and noon; daylight saving follows the zone."""
    return F.from_utc_timestamp(ts, ZONE) - F.expr(SESSION_START)


def session_key(ts: Column) -> Column:
    local = session_local(ts)
    return F.concat(F.date_format(local, "yyyy-MM-dd"), F.when(F.hour(local) < 12, "-morning").otherwise("-evening"))


def session_start(ts: Column) -> Column:
    local = session_local(ts)
    half = F.date_trunc("day", local) + F.make_dt_interval(hours=F.when(F.hour(local) < 12, 0).otherwise(12))
    return F.to_utc_timestamp(half + F.expr(SESSION_START), ZONE)


def session_end(ts: Column) -> Column:
    local = session_local(ts)
    half = F.date_trunc("day", local) + F.make_dt_interval(hours=F.when(F.hour(local) < 12, 12).otherwise(24))
    return F.to_utc_timestamp(half + F.expr(SESSION_START), ZONE)


def decide(checks: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """For each check (now, expected): window_key, target_at, next_target_at, window_complete, attempts, late_minutes, retry_at, should_run, reason.

    Runs of the whole universe within a check's window are its attempts; runs meet checks by window key.
    """
    c = checks.withColumn("window_key", session_key(F.col("now"))).withColumn("target_at", session_start(F.col("now"))).withColumn("next_target_at", session_end(F.col("now")))
    r = runs.withColumn("window_key", session_key(F.col("started_at"))).withColumnRenamed("companies_total", "total")
    ended = F.coalesce("finished_at", "started_at")
    joined = c.join(r.select("window_key", "run_id", "started_at", "finished_at", "status", "total", "companies_ok", "companies_failed"), "window_key", "left")
    counted = F.col("run_id").isNotNull() & (F.col("total") == F.col("expected"))
    done = counted & (F.col("status") == "success") & F.col("finished_at").isNotNull() & (F.col("companies_ok") == F.col("expected")) & (F.coalesce("companies_failed", F.lit(0)) == 0)
    n = joined.groupBy("now", "expected", "window_key", "target_at", "next_target_at").agg(
        F.count_if(counted).alias("attempts"), F.coalesce(F.bool_or(done), F.lit(False)).alias("window_complete"), F.max_by(F.when(counted, ended), F.when(counted, F.col("started_at"))).alias("_last")
    )
    retry = F.col("_last") + F.make_dt_interval(mins=F.lit(RETRY_MINUTES))
    late = F.greatest(F.lit(0), F.floor((F.unix_micros("now") - F.unix_micros("target_at")) / 60_000_000)).cast("int")
    waiting = (F.col("attempts") > 0) & (F.col("now") < retry)
    covered, spent = F.col("window_complete"), F.col("attempts") >= MAX_ATTEMPTS
    reason = (
        F.when(F.lit(force), "Explicit forced crawl requested; job deduplication remains enabled.")
        .when(covered, "Current window already has a successful full crawl; no additional crawl needed.")
        .when(spent, "Retry limit reached for this window; source failures remain visible. Next window will retry.")
        .when(waiting, "Previous crawl was incomplete; waiting for the one-hour recovery cooldown.")
        .otherwise("No successful full crawl in the current window; running catch-up now.")
    )
    n = n.withColumn("late_minutes", late).withColumn("retry_at", F.when(~F.lit(force) & ~covered & ~spent & waiting, retry)).withColumn("reason", reason)
    return n.withColumn("should_run", F.lit(force) | ~(covered | spent | F.coalesce(waiting, F.lit(False)))).drop("_last")


def status_health(issues: Column, latest_status: Column, complete: Column, late_minutes: Column) -> Column:
    bad = (issues > 0) | F.coalesce(latest_status != "success", F.lit(False))
    return F.when(bad, "needs attention").when(complete, "healthy").when(late_minutes > OVERDUE_MINUTES, "overdue").otherwise("crawl due")


def workflow_exit(code: Column, status: Column, enabled: Column, ok: Column, failed: Column, has_jobs: Column) -> Column:
    """0 for a usable partial run that ended with code 2; else the code itself."""
    usable = (code == 2) & (status == "partial") & (ok > 0) & (ok < enabled) & (failed > 0) & (ok + failed == enabled) & has_jobs
    return F.when(code == 0, 0).when(F.coalesce(usable, F.lit(False)), 0).otherwise(code)


def alert_kind(failed: Column, infrastructure: Column, source_failures: Column, matches: Column) -> Column:
    return F.when(failed | (infrastructure > 0), "failure").when(source_failures > 0, "source-warning").when(matches > 0, "matches").otherwise("none")


def alert_title(kind: Column, matches: Column, date: Column) -> Column:
    many = F.concat(F.lit("Monitor: "), matches.cast("string"), F.lit(" new match"), F.when(matches == 1, "").otherwise("es"))
    return F.concat(F.when(kind == "failure", "Monitor failed").when(kind == "source-warning", "Monitor source failure").otherwise(many), F.lit(" — "), date)


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table, as a backup's manifest states them."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
