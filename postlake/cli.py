"""Command line: fetch requests into a bronze payload table, crawl over it, validate-config, schedule."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from datetime import datetime, timezone
from logging.handlers import RotatingFileHandler
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.crawl import crawl, import_receipts, validate_companies
from .plans.schedule import crontab, launchd
from .rules import load_rules
from .sources import fetch as fetching
from .sources.files import companies, load_json, payloads
from .state import StateStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="postlake")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl")
    c.add_argument("--companies", type=Path, required=True)
    c.add_argument("--profile", type=Path, required=True)
    c.add_argument("--payloads", required=True, help="Parquet table of source responses")
    c.add_argument("--state", required=True)
    c.add_argument("--output", type=Path, default=Path("reports"))
    c.add_argument("--mode", choices=("auto", "initial", "incremental"), default="auto")
    c.add_argument("--company", action="append", default=[])
    c.add_argument("--receipts", type=Path)
    c.add_argument("--log", type=Path)
    f = sub.add_parser("fetch")
    f.add_argument("--requests", required=True, help="JSON lines of requests")
    f.add_argument("--payloads", required=True, help="Parquet table to write")
    f.add_argument("--state", required=True)
    f.add_argument("--agent", required=True)
    f.add_argument("--interval", type=float, default=0.8)
    s = sub.add_parser("schedule")
    s.add_argument("--format", choices=("crontab", "launchd"), default="crontab")
    s.add_argument("--label", default="postlake.crawl")
    s.add_argument("run", nargs="+", help="the command to run")
    v = sub.add_parser("validate-config")
    v.add_argument("--companies", type=Path, required=True)
    v.add_argument("--profile", type=Path, required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "schedule":
        print(crontab(args.run) if args.format == "crontab" else launchd(args.label, args.run, str(Path.cwd()), str(Path.cwd() / "crawl.log")), end="")
        return 0
    spark = spark or SparkSession.builder.appName("postlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "fetch":
        store, run = StateStore(spark, args.state), f"fetch-{uuid.uuid4().hex[:8]}"
        wanted = spark.read.schema(fetching.REQUEST).json(args.requests)
        got = store.stage(run, "responses", fetching.fetch(wanted, store.read("raw_pages"), args.agent, interval=args.interval))
        fetching.payloads(got).write.parquet(args.payloads)
        store.commit(run, append={"raw_pages": fetching.pages(got)})
        return 0 if got.where("status = 0").isEmpty() else 2
    profile, table = load_json(args.profile), companies(spark, load_json(args.companies)["companies"])
    problems = validate_companies(table)
    if missing := [k for k in ("candidate", "filters") if k not in profile]:
        problems += [f"profile lacks {k}" for k in missing]
    load_rules(profile)
    if args.command == "validate-config" or problems:
        print("\n".join(problems) or "configuration is valid")
        return 1 if problems else 0
    if args.log:
        args.log.parent.mkdir(parents=True, exist_ok=True)
        logging.getLogger().addHandler(RotatingFileHandler(args.log, maxBytes=2_000_000, backupCount=3))
    store, now = StateStore(spark, args.state), datetime.now(timezone.utc)
    if args.receipts:
        import_receipts(store, json.loads(args.receipts.read_text()), f"receipts-{now:%Y%m%dT%H%M%SZ}")
    done = crawl(spark, table, payloads(spark, args.payloads), store, profile, now, args.mode, args.output, args.company or None)
    print(json.dumps(done.metadata, indent=2))
    return 0 if done.metadata["status"] == "success" else 2


if __name__ == "__main__":
    raise SystemExit(main())
