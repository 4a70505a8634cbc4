"""Report tables and their files: matches, rejections, health, summaries."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import json
import re
import shutil
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import age_text
from ..schema import PRIORITIES

# Columns of the three reports, in order.
MATCH_COLUMNS = "company title location posted_at posting_date_kind posting_date_confidence source_url apply_url discovered_at event_type sponsorship_confidence sponsorship_score sponsorship_evidence role_sponsorship_signal match_score why_matches apply_priority extracted_min_years source source_job_id".split()
REJECTION_COLUMNS = "company title location posted_at source_url match_score sponsorship_score rejection_reasons source source_job_id".split()
HEALTH_COLUMNS = "company company_id enabled source status jobs_fetched requests warning error careers_url sponsorship_confidence".split()
LABELS = {"P0": "Apply immediately", "P1": "Strong match", "P2": "Worth reviewing"}


def iso(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit(""))


def report_rows(decided: DataFrame, now: Column) -> DataFrame:
    """All report columns, and job_key, company_id, age and seq, of decided postings (joined to their company's confidence and summary)."""
    c = F.col
    return decided.select(
        "company", "title", "location", iso(c("posted_at")).alias("posted_at"), "posting_date_kind", "posting_date_confidence", "source_url", "apply_url", iso(c("discovered_at")).alias("discovered_at"), c("event").alias("event_type"),
        c("confidence").alias("sponsorship_confidence"), "sponsorship_score", c("summary").alias("sponsorship_evidence"), c("role_signal").alias("role_sponsorship_signal"), "match_score", F.array_join("why", "; ").alias("why_matches"),
        c("priority").alias("apply_priority"), c("min_years").alias("extracted_min_years"), "source", "source_job_id", F.array_join("rejection_reasons", "; ").alias("rejection_reasons"), "job_key", "company_id", "seq", "emit", age_text(c("posted_at"), now).alias("age"),
    )


def priority_rank(priority: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, p in enumerate(PRIORITIES[:3]) for x in (F.lit(p), F.lit(k))]), priority), F.lit(9))


def matches(rows: DataFrame) -> DataFrame:
    """Emitted rows, best first; the key breaks ties."""
    return rows.where("emit").orderBy(priority_rank(F.col("apply_priority")), F.desc("match_score"), "company", "job_key")


def write_tables(path: str, matched: DataFrame, rejected: DataFrame, health: DataFrame) -> None:
    """All rows of a run's three reports as tables, written by the executors."""
    matched.select(*MATCH_COLUMNS, "job_key").write.parquet(f"{path}/matches")
    rejected.select(*REJECTION_COLUMNS, "job_key").write.parquet(f"{path}/rejections")
    health.select(*HEALTH_COLUMNS).write.parquet(f"{path}/health")


Rows = Callable[[], Iterable[dict[str, Any]]]


def rows_of(df: DataFrame) -> Rows:
    """Rows of an ordered table, fetched partition by partition each time they are asked for, so that reports of any length can be written."""
    return lambda: (r.asDict() for r in df.toLocalIterator())


def csv_lines(rows: Iterable[dict[str, Any]], columns: Sequence[str]) -> Iterator[str]:
    out = io.StringIO()
    w = csv.DictWriter(out, columns, extrasaction="ignore", lineterminator="\r\n")
    w.writeheader()
    for r in rows:
        w.writerow({k: "" if r.get(k) is None else r[k] for k in columns})
        yield out.getvalue()
        out.seek(0)
        out.truncate()
    yield out.getvalue()


def json_parts(metadata: dict[str, Any], rows: Iterable[dict[str, Any]]) -> Iterator[str]:
    """{"metadata", "jobs"} with an indent of two, job by job."""
    text = lambda value, by: json.dumps(value, indent=2, ensure_ascii=False, default=str).replace("\n", "\n" + " " * by)
    yield '{\n  "metadata": ' + text(metadata, 2) + ',\n  "jobs": ['
    none = True
    for r in rows:
        yield ("" if none else ",") + "\n    " + text(r, 4)
        none = False
    yield ("]" if none else "\n  ]") + "\n}\n"


def markdown_parts(title: str, metadata: dict[str, Any], rows: Iterable[dict[str, Any]]) -> Iterator[str]:
    """Rows come by priority; each priority has a heading."""
    yield f"# {title}\n\nRun `{metadata['run_id']}`, mode **{metadata['mode']}**, started {metadata['started_at']}: **{metadata['emitted_jobs']}** new or reposted.\n"
    last = None
    for r in rows:
        if r["apply_priority"] != last:
            last = r["apply_priority"]
            yield f"\n## {last} - {LABELS.get(last, '')}\n"
        facts = {"Location": r["location"], "Freshness": f"{r['age']} ({r['posting_date_kind']}, {r['posting_date_confidence']})", "Match": f"{r['match_score']:.1f}/100 - {r['why_matches']}", "Sponsorship": f"{r['sponsorship_confidence']} ({r['sponsorship_score']:.2f}); {r['role_sponsorship_signal']}", "Apply": r["apply_url"] or r["source_url"]}
        yield f"\n### [{r['company']} - {r['title']}]({r['source_url']})\n\n" + "".join(f"- **{k}:** {v}\n" for k, v in facts.items())
    if last is None:
        yield "\nNothing cleared every gate in this run. See company_health.csv for sources that failed or are disabled.\n"


def html_parts(title: str, metadata: dict[str, Any], rows: Iterable[dict[str, Any]]) -> Iterator[str]:
    e = lambda v: html.escape(str(v if v is not None else ""), quote=True)
    yield f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1><p>{e(metadata["mode"])} run, {e(metadata["emitted_jobs"])} emitted</p>'
    none = True
    for r in rows:
        none = False
        yield (
            f'<section class="{e(r["apply_priority"].lower())}"><h2><a href="{e(r["source_url"])}">{e(r["title"])}</a></h2><p>{e(r["apply_priority"])} · {e(r["company"])} · {e(r["location"])} · {e(r["age"])} · {e(r["event_type"])}</p>'
            f'<p>Match {r["match_score"]:.1f} · Sponsorship {r["sponsorship_score"]:.2f}</p><p>{e(r["why_matches"])}</p><p>{e(r["sponsorship_evidence"])}</p><a href="{e(r["apply_url"] or r["source_url"])}">Apply</a></section>'
        )
    yield ("<p>Nothing cleared every gate in this run.</p>" if none else "") + "</body></html>"


def export_run(output: Path, metadata: dict[str, Any], matched: Rows, rejected: Rows, health: Rows, title: str) -> Path:
    """Write a run's immutable folder row by row, then replace the latest files. All rows are written."""
    run = output / "runs" / metadata["run_id"]
    run.mkdir(parents=True, exist_ok=False)
    files = {
        "matches.csv": csv_lines(matched(), MATCH_COLUMNS),
        "matches.json": json_parts(metadata, matched()),
        "daily_report.md": markdown_parts(title, metadata, matched()),
        "daily_report.html": html_parts(title, metadata, matched()),
        "rejections_audit.csv": csv_lines(rejected(), REJECTION_COLUMNS),
        "company_health.csv": csv_lines(health(), HEALTH_COLUMNS),
    }
    for name, parts in files.items():
        with (run / name).open("w", encoding="utf-8", newline="") as f:
            f.writelines(parts)
    for name, source in {"latest.csv": "matches.csv", "latest.json": "matches.json", "latest.md": "daily_report.md", "latest.html": "daily_report.html", "company_health.csv": "company_health.csv"}.items():
        new = output / f".{name}.new"
        shutil.copyfile(run / source, new)
        new.replace(output / name)
    return run


def receipts_baseline(report: bytes) -> dict[str, Any]:
    """Delivery receipts of a finished report; ValueError for a failed one or jobs without priority, date or key."""
    body = json.loads(report)
    meta, jobs = body["metadata"], body["jobs"]
    if meta["status"] not in ("success", "partial"):
        raise ValueError("only a usable run's report can be acknowledged")
    if any(j.get("apply_priority") not in LABELS or not j.get("posted_at") or not j.get("job_key") for j in jobs):
        raise ValueError("a job lacks priority, date or key")
    return {"schema_version": 1, "report_id": meta["run_id"], "reported_at": meta["started_at"], "source_report_sha256": hashlib.sha256(report).hexdigest(), "jobs": [{"job_key": j["job_key"], "posted_at": j["posted_at"]} for j in jobs]}


def load_report(path: Path) -> dict[str, Any]:
    """A report, or {} where it is missing or damaged."""
    try:
        body = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return body if isinstance(body, dict) else {}


def last_error(lines: DataFrame, tail: int = 120) -> DataFrame:
    """One row: the last of the last tail log lines (lineno, value) that speaks of an error, or null."""
    newest = lines.orderBy(F.desc("lineno")).limit(tail)
    return newest.where(F.col("value").rlike(r"(?i)\b(?:error|exception|traceback|critical|fatal)\b")).agg(F.max_by("value", "lineno").alias("last_error"))


def merge_section(body: str, run_id: str, section: str) -> str:
    """Replace a run's marked section in a text, or append it; doing so twice changes nothing."""
    start, end = f"<!-- session:{run_id} -->", f"<!-- /session:{run_id} -->"
    block = f"{start}\n{section.strip()}\n{end}"
    pattern = re.compile(re.escape(start) + r".*?" + re.escape(end), re.S)
    if pattern.search(body):
        return pattern.sub(lambda _: block, body)
    return f"{body.rstrip()}\n\n{block}\n" if body.strip() else block + "\n"


def _line(value: Any, limit: int = 400) -> str:
    text = re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f]+", " ", str(value or ""))).strip()
    text = text if len(text) <= limit else text[: limit - 1] + "…"
    return re.sub(r"([\\`*_{}\[\]()#+!|<>~-])", r"\\\1", text)


def summary(report: dict[str, Any], failures: list[dict[str, Any]], exit_code: str = "", outcome: str = "success", steps: dict[str, str] | None = None, fatal: str = "") -> tuple[str, dict[str, Any]]:
    """(markdown, outputs) of a run: what failed, what matched, and which alert it deserves."""
    meta = report.get("metadata") if isinstance(report.get("metadata"), dict) else {}
    jobs = [j for j in report.get("jobs") or [] if isinstance(j, dict) and j.get("apply_priority") in LABELS]
    partial = meta.get("status") == "partial" and exit_code.strip() == "2"
    failed = not report or (outcome != "success" and not partial)
    broken = [f"{k}: {v.lower()}" for k, v in (steps or {}).items() if v.lower() in ("failure", "cancelled")]
    if failed or broken:
        jobs = []
    n_failed = max(len(failures), int(meta.get("companies_failed") or 0))
    kind = "failure" if failed or broken else "source-warning" if n_failed else "matches" if jobs else "none"
    count = f"{len(jobs)} new match{'' if len(jobs) == 1 else 'es'}"
    title = {"failure": "Monitor failed", "source-warning": "Monitor source failure"}.get(kind, f"Monitor: {count}")
    out = ["# Posting monitor", ""]
    if meta:
        out += [f"Run `{_line(meta.get('run_id'))}`: sources healthy **{meta.get('companies_ok', 0)}/{meta.get('companies_enabled', 0)}**, outcome **{_line(meta.get('status'))}**.", ""]
    if failed:
        cause = "the crawl exceeded its time limit" if exit_code == "124" else _line(fatal, 1000) or "no valid report"
        out += ["## Monitor failure", "", f"- {cause}", ""]
    if broken:
        out += ["## Workflow failures", "", *[f"- {_line(b)}" for b in broken], ""]
    if n_failed:
        out += ["## Source failures", "", *([f"- **{_line(r.get('company'))}** (`{_line(r.get('source'))}`): {_line(r.get('error') or r.get('warning') or 'unknown failure')}" for r in failures] or [f"- {n_failed} source(s) failed."]), ""]
    for j in jobs:
        url = j.get("apply_url") or j.get("source_url") or ""
        name = _line(j.get("title"))
        link = f"[{name}](<{url}>)" if re.match(r"(?i)^https?://[^\s/?#@]+(?:[/?#][^\s<>\"]*)?\Z", url) else name
        out += [f"### {j['apply_priority']} — {_line(j.get('company'))}: {link}", "", f"- {_line(j.get('location'))}; posted {_line(j.get('posted_at') or 'unverified')}; {_line(j.get('why_matches'))}", ""]
    if kind == "none":
        out += ["No new matches and no failures.", ""]
    return "\n".join(out), {"alert_kind": kind, "alert_title": title, "new_matches": len(jobs), "source_failures": n_failed}


def status_page(decision: dict[str, Any], health: str, latest: dict[str, Any], failures: list[dict[str, Any]], history: list[dict[str, Any]]) -> str:
    """Markdown of the monitor's state: health, due window, last run, problems and recent runs."""
    out = ["# Monitor status", "", f"**{health.upper()}**", "", f"- Due window: **{decision['window_key']}**, covered: **{'yes' if decision['window_complete'] else 'no'}**", f"- Latest run: **{latest.get('started_at') or 'never'}** ({_line(latest.get('status') or 'none')}), healthy {latest.get('companies_ok', 0)}/{latest.get('companies_total', 0)}", f"- Next target: **{decision['next_target_at']}**", f"- {decision['reason']}", ""]
    if failures:
        out += ["## Source problems", "", *[f"- **{_line(r['company_id'])}**: {_line(r.get('error') or r.get('warning') or r['status'], 1200)}" for r in failures], ""]
    out += ["## Recent runs", "", "| Start | Outcome | Healthy | New |", "|---|---|---|---|", *[f"| {r['started_at']} | {_line(r['status'])} | {r['companies_ok']}/{r['companies_total']} | {r['emitted_jobs']} |" for r in history[:6]], ""]
    return "\n".join(out)
