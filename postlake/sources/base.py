"""What all feeds share: the payload table, the registry of normalizers, budgets, and the scan result."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_datetime
from ..rules import RuleSet
from ..schema import POSTING_COLUMNS

#: The bronze table: one response per row. kind: list, detail, page or sitemap; key: id or URL; status: HTTP status (0: no response).
PAYLOAD = "company_id string, kind string, key string, page int, status int, body string"
RESULT = "company_id string, source string, fetched_jobs long, requests long, error string, warning string, skipped boolean, cursor_complete boolean"


@dataclass(frozen=True)
class Request:
    """What a normalizer works on.

    payloads: rows of PAYLOAD for this source. companies: id, name, connector (JSON), default_country, since, mode. known:
    company_id, source_url, posted_at, last_seen_at of stored jobs.
    """

    payloads: DataFrame
    companies: DataFrame
    known: DataFrame
    rules: RuleSet
    now: Column


@dataclass(frozen=True)
class Scan:
    """postings (POSTING columns), results (RESULT columns)."""

    postings: DataFrame
    results: DataFrame


Normalizer = Callable[[Request], Scan]
REGISTRY: dict[str, Normalizer] = {}


def register(name: str) -> Callable[[Normalizer], Normalizer]:
    def keep(f: Normalizer) -> Normalizer:
        REGISTRY[name] = f
        return f

    return keep


def normalizer(name: str) -> Normalizer:
    if name not in REGISTRY:
        raise ValueError(f"unknown connector type: {name}")
    return REGISTRY[name]


def option(name: str, kind: str, default) -> Column:
    """A connector's setting."""
    return F.coalesce(F.get_json_object("connector", f"$.{name}").try_cast(kind), F.lit(default).cast(kind))


def text(path: str, of: str = "item") -> Column:
    """A JSON value as text, "" where it is missing or null."""
    return F.coalesce(F.get_json_object(of, path), F.lit(""))


def items(df: DataFrame, path: str | None = None) -> DataFrame:
    """One row per element of a body's JSON array (at a key, or the body itself), as JSON in item, in feed order (seq).

    A body that is no such JSON has no items.
    """
    kind = "array<string>"
    values = F.from_json("body", kind) if path is None else F.from_json("body", f"struct<`{path}`:{kind}>")[path]
    return df.select("*", F.posexplode(F.coalesce(values, F.array().cast(kind))).alias("pos", "item")).withColumn("seq", F.struct("page", "pos"))


def date(value: Column, now: Column) -> Column:
    return parse_datetime(value, now)


def within(budget: Column, order: list[Column], wanted: Column) -> tuple[Column, Column]:
    """(taken, over): wanted rows within a company's budget, in order, and those past it."""
    rank = F.sum(F.when(wanted, 1).otherwise(0)).over(Window.partitionBy("company_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return wanted & (rank <= budget), wanted & (rank > budget)


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _merged(base: pd.Series, top: pd.Series) -> pd.Series:
    return pd.Series([a if not b else json.dumps({**json.loads(a), **json.loads(b)}, ensure_ascii=False) for a, b in zip(base, top, strict=True)], dtype=object)


def overlay(base: Column | str, top: Column) -> Column:
    """JSON objects merged; the second wins."""
    return F.pandas_udf(_merged, "string")(base, top)


def details(payloads: DataFrame) -> DataFrame:
    """(company_id, key, detail, detail_ok): detail responses; one per key, the last page wins."""
    d = payloads.where("kind in ('detail', 'page')").select("company_id", "key", F.col("body").alias("detail"), F.col("status").alias("detail_status"), "page")
    return first_of(d, ["company_id", "key"], F.desc("page")).drop("page")


def posting(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Select POSTING columns; those not named are empty."""
    base = {"company_id": F.col("company_id"), "company": F.col("name"), "source": F.lit(source), "raw": F.col("item")}
    given = {**base, **columns}
    return df.select(*[given.get(c, F.lit("")).alias(c) for c in POSTING_COLUMNS])


def dated(posted: Column, kind: str) -> dict[str, Column]:
    """Posting date with the kind and confidence of a source that states it."""
    return {
        "posted_at": posted,
        "posting_date_kind": F.when(posted.isNotNull(), kind).otherwise("unknown"),
        "posting_date_confidence": F.when(posted.isNotNull(), "high").otherwise("unknown"),
    }


def joined(*parts: Column, sep: str = " | ") -> Column:
    """Non-empty texts, each once, joined."""
    return F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))), sep)


def joined_array(values: Column, sep: str = " | ") -> Column:
    return F.array_join(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), sep)


def results(request: Request, source: str, postings: DataFrame, counts: DataFrame | None, warning: Column, complete: Column, skipped: Column | None = None, skip_warning: str = "") -> DataFrame:
    """One RESULT row per company; counts: company_id and the counters that warning and complete speak of."""
    n = postings.groupBy("company_id").agg(F.count("*").alias("fetched_jobs"))
    sent = request.payloads.groupBy("company_id").agg(F.count("*").alias("requests"), F.max(F.when(F.col("kind").isin("list") & (F.col("status") != 200), F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" for "), F.col("key")))).alias("error"))
    df = request.companies.withColumnRenamed("id", "company_id").join(n, "company_id", "left").join(sent, "company_id", "left")
    if counts is not None:
        df = df.join(counts, "company_id", "left")
    skipped = F.lit(False) if skipped is None else skipped
    return df.select(
        "company_id", F.lit(source).alias("source"), F.coalesce("fetched_jobs", F.lit(0)).alias("fetched_jobs"), F.coalesce("requests", F.lit(0)).alias("requests"),
        F.when(skipped, "").otherwise(F.coalesce("error", F.lit(""))).alias("error"), F.when(skipped, skip_warning).otherwise(F.coalesce(warning, F.lit(""))).alias("warning"),
        skipped.alias("skipped"), (F.coalesce(complete, F.lit(True)) & F.col("error").isNull()).alias("cursor_complete"),
    )


def say(*pairs: tuple[Column, Column | str]) -> Column:
    """Warnings whose conditions hold, joined by a blank."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs])), " ")


def number(c: str, before: str, after: str) -> Column:
    return F.concat(F.lit(before), F.col(c).cast("string"), F.lit(after))
