"""File and ledger scans."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import COMPANY
from .base import PAYLOAD


def load_json(path: str | Path) -> dict[str, Any]:
    """A configuration file; ValueError unless it holds one object."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold a JSON object")
    return value


def companies(spark: SparkSession, values: list[dict[str, Any]]) -> DataFrame:
    """Company objects (id, name, connector, sponsorship ...) as rows."""
    rows = []
    for v in values:
        c, s = v.get("connector") or {}, v.get("sponsorship") or {}
        rows.append((v["id"], v["name"], v.get("domain", ""), v.get("careers_url", ""), bool(v.get("enabled", True)), str(c.get("type", "manual")), json.dumps(c), str(c.get("default_country", "")), str(s.get("confidence", "unknown")), float(s.get("score", 0)), str(s.get("summary", "")), list(s.get("sources", [])), list(v.get("fit_tags", [])), str(v.get("notes", ""))))
    return spark.createDataFrame(rows, COMPANY)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).parquet(path)


def run_history(runs: DataFrame, newest: int = 500) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").limit(newest)


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """A report's jobs read back; a damaged file has none."""
    body = spark.read.text(path, wholetext=True)
    jobs = F.from_json("value", "struct<metadata:map<string,string>,jobs:array<map<string,string>>>")
    return body.select(jobs.alias("r")).select(F.col("r.metadata").alias("metadata"), F.explode(F.coalesce("r.jobs", F.array().cast("array<map<string,string>>"))).alias("job"))


def health_failures(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    idle = (F.lower("enabled") == "false") & (F.col("status") == "skipped")
    return df.where((F.col("status") != "ok") & ~idle)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(lineno, value) of a log file; a log is one small file, read whole."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\n")).alias("lineno", "value"))


def newest_pages(raw_pages: DataFrame) -> DataFrame:
    """The latest stored response per URL; one that was not modified (304) keeps the body before it."""
    w = Window.partitionBy("url").orderBy("fetched_at")
    body = F.last(F.when(F.col("status") != 304, F.col("body")), ignorenulls=True).over(w)
    tag = F.last("etag", ignorenulls=True).over(w)
    df = raw_pages.withColumn("_body", body).withColumn("_tag", tag)
    last = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("fetched_at")))
    return df.withColumn("_rn", last).where("_rn = 1").select("url", F.col("_tag").alias("etag"), "last_modified", "fetched_at", F.when(F.col("status") == 304, 200).otherwise(F.col("status")).alias("status"), F.col("_body").alias("body"))
