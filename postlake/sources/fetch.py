"""Live requests as a table operation: requests in, responses out, politely.

Requests of a host lie in one partition in order and are made one after the other, with a pause between two; hosts run side by
side on the cluster. A host's robots rules are fetched in the same way, once, and judged as rows; if they can't be had, nothing
is asked of it. What was read before is asked for with its validators, and "not modified" takes the stored body. A task that is
repeated asks again, so a caller stages the result before using it twice.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from http.client import HTTPException

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import request_url
from ..operators import robots
from ..ship import shared_dir
from .files import newest_pages

#: Columns of a request: policy is strict, documented_public_api (no robots check) or disabled; interval: seconds between requests of its host, at least.
REQUEST = "company_id string, kind string, key string, page int, url string, method string, body string, policy string, interval double"
RESPONSE = "company_id string, kind string, key string, page int, url string, status int, body string, etag string, last_modified string, fetched_at timestamp, from_cache boolean, requests int, error string"
# Statuses worth another try; the longest pause that a server may ask for, for pages and for robots rules.
AGAIN = frozenset({408, 425, 429, 500, 502, 503, 504})
LONGEST_PAUSE, LONGEST_ROBOTS_PAUSE = 120.0, 30.0
ACCEPT = "application/json,text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.5"


def pause_asked(value: str | None, now: datetime) -> float | None:
    """Seconds that a Retry-After header asks for (a number or a date), or None."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        try:
            return max(0.0, (parsedate_to_datetime(value) - now).total_seconds())
        except (TypeError, ValueError):
            return None


class Host:
    """One host's requests: a pause before each but the first."""

    def __init__(self, agent: str, timeout: float, tries: int, most: int, sleep: Callable[[float], None] = time.sleep):
        self.agent, self.timeout, self.tries, self.most, self.sleep = agent, timeout, tries, most, sleep
        self.last: float | None = None

    def _wait(self, interval: float) -> None:
        if self.last is not None:
            self.sleep(max(0.0, interval - (time.monotonic() - self.last)))
        self.last = time.monotonic()

    def ask(self, url: str, interval: float, method: str = "GET", body: str | None = None, headers: dict[str, str] | None = None, longest: float = LONGEST_PAUSE, give_up: bool = False) -> dict:
        """status (0: no answer), body, etag, last_modified, requests, error. give_up: a longer pause than longest ends the tries instead of being cut to it."""
        out = {"status": 0, "body": None, "etag": None, "last_modified": None, "requests": 0, "error": ""}
        data = body.encode() if body is not None and method == "POST" else None
        head = {"User-Agent": self.agent, "Accept": ACCEPT, **({"Content-Type": "application/json"} if data is not None else {}), **(headers or {})}
        for k in range(self.tries + 1):
            pause = min(30.0, 2.0**k + random.uniform(0.1, 0.8))
            self._wait(interval)
            out["requests"] += 1
            try:
                with urllib.request.urlopen(urllib.request.Request(url, data=data, method=method, headers=head), timeout=self.timeout) as answer:
                    raw = answer.read(self.most + 1)
                    if len(raw) > self.most:
                        return out | {"error": f"response is longer than {self.most} bytes"}
                    text = raw.decode(answer.headers.get_content_charset() or "utf-8", "replace")
                    return out | {"status": answer.status, "body": text, "etag": answer.headers.get("ETag"), "last_modified": answer.headers.get("Last-Modified"), "error": ""}
            except urllib.error.HTTPError as refusal:
                out |= {"status": refusal.code, "error": f"HTTP {refusal.code}"}
                if refusal.code not in AGAIN:
                    break
                asked = pause_asked(refusal.headers.get("Retry-After"), datetime.now(timezone.utc))
                if asked is not None:
                    if give_up and asked > longest:
                        break
                    pause = min(longest, asked)
            except (OSError, HTTPException, LookupError, ValueError) as trouble:
                out |= {"status": 0, "error": f"{type(trouble).__name__}: {trouble}"}
            if k < self.tries:
                self.sleep(pause)
        return out


def _asker(agent: str, timeout: float, tries: int, most: int, longest: float, give_up: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by host, with their answers in a column as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, host = None, None
        for pdf in batches:
            answers = []
            for r in pdf.itertuples():
                if r.host != name:
                    name, host = r.host, Host(agent, timeout, tries, most)
                known = {k: v for k, v in (("If-None-Match", r.etag), ("If-Modified-Since", r.last_modified)) if v}
                answers.append(json.dumps(host.ask(r.url, r.interval, r.method, r.body, known, longest, give_up)))
            yield pd.DataFrame({"id": pdf["id"], "answer": answers})

    return run


def _ask_all(df: DataFrame, agent: str, timeout: float, tries: int, most: int, longest: float = LONGEST_PAUSE, give_up: bool = False) -> DataFrame:
    """(id, status, body, etag, last_modified, requests, error) of rows with id, host, url, method, body, interval, etag, last_modified, seq."""
    dealt = df.repartition("host").sortWithinPartitions("host", "seq").select("id", "host", "url", "method", "body", "interval", "etag", "last_modified")
    made = dealt.mapInPandas(_asker(agent, timeout, tries, most, longest, give_up), "id string, answer string")
    shape = "struct<status:int,body:string,etag:string,last_modified:string,requests:int,error:string>"
    return made.select("id", F.from_json("answer", shape).alias("a")).select("id", "a.*")


def gate(requests: DataFrame, agent: str, timeout: float = 15.0, tries: int = 2, interval: float = 0.8) -> DataFrame:
    """requests (with id, url, policy) with may and why: whether their policy and their host's robots rules permit them.

    Rules that are missing (404) permit all, refused ones (401, 403) nothing, and unavailable ones nothing either.
    """
    at = requests.withColumn("origin", F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))).withColumn("target", F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$", ""))
    at = at.withColumn("target", F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(F.lit("/"), "target")))
    ask = at.where("policy = 'strict' and url is not null and origin != ''").select("origin").distinct()
    none = F.lit(None).cast("string")
    ask = ask.select(F.col("origin").alias("id"), F.col("origin").alias("host"), F.concat("origin", F.lit("/robots.txt")).alias("url"), F.lit("GET").alias("method"), none.alias("body"), F.lit(interval).alias("interval"), none.alias("etag"), none.alias("last_modified"), F.lit(0).alias("seq"))
    files = _ask_all(ask, agent, timeout, tries, 1_000_000, LONGEST_ROBOTS_PAUSE, True).select(F.col("id").alias("origin"), F.col("status").alias("robots_status"), F.col("body").alias("rules"), F.col("error").alias("robots_error"))
    path = f"{shared_dir(files.sparkSession)}/robots/{uuid.uuid4().hex}"
    files.write.parquet(path)  # asked once
    files = files.sparkSession.read.schema(files.schema).parquet(path)
    rules = robots.parse(files.where("robots_status = 200").select(F.col("origin").alias("host"), F.col("rules").alias("body")))
    judged = robots.allowed(at.select(F.col("origin").alias("host"), "target").distinct(), rules, agent).select(F.col("host").alias("origin"), "target", "can_fetch")
    out = at.join(files.drop("rules"), "origin", "left").join(judged, ["origin", "target"], "left")
    status = F.col("robots_status")
    why = (
        F.when(F.col("policy") == "disabled", "source disabled by access policy")
        .when(F.col("url").isNull(), "the URL cannot be requested")
        .when(F.col("policy") == "documented_public_api", "documented public interface")
        .when(status.isin(401, 403), "robots.txt is refused")
        .when(~F.coalesce(status.isin(200, 404), F.lit(False)), F.concat(F.lit("robots.txt unavailable: "), F.coalesce(F.nullif("robots_error", F.lit("")), F.lit("no answer"))))
        .when((status == 200) & ~F.col("can_fetch"), "disallowed by robots.txt")
        .otherwise("allowed by robots.txt")
    )
    return out.withColumn("why", why).withColumn("may", F.col("why").isin("documented public interface", "allowed by robots.txt")).drop("origin", "target", "robots_status", "robots_error", "can_fetch")


def fetch(requests: DataFrame, stored: DataFrame, agent: str, timeout: float = 25.0, tries: int = 3, most: int = 15_000_000, interval: float = 0.8) -> DataFrame:
    """Responses (RESPONSE) to requests (REQUEST), in which stored pages (the raw_pages table) spare what has not changed.

    A request that may not be made has status 0 and the reason as its error. Null methods are GET, null policies strict, null
    intervals the default; a longer interval of any request of a host holds for that request. Requests without an answer have status 0.
    """
    df = requests.withColumn("id", F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("company_id", "kind", "key", "page", "url", "method", "body")]), 256))
    df = df.dropDuplicates(["id"]).withColumns({"method": F.coalesce("method", F.lit("GET")), "policy": F.coalesce("policy", F.lit("strict")), "interval": F.greatest(F.coalesce("interval", F.lit(interval)), F.lit(interval)), "url": request_url(F.col("url"))})
    judged = gate(df, agent, min(timeout, 15.0), min(tries, 2), interval)
    cached = newest_pages(stored).where("status = 200").select("url", F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"), F.col("body").cast("string").alias("_body"))
    judged = judged.join(cached, "url", "left")
    get = F.col("method") == "GET"
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    asks = judged.where("may").select("id", host.alias("host"), "url", "method", "body", "interval", F.when(get, F.col("_etag")).alias("etag"), F.when(get, F.col("_modified")).alias("last_modified"), F.struct("company_id", "kind", "page", "key").alias("seq"))
    got = _ask_all(asks, agent, timeout, tries, most)
    a = {c: F.col(f"got.{c}") for c in ("status", "body", "etag", "last_modified", "requests", "error")}
    same = a["status"] == 304
    out = judged.alias("r").join(got.alias("got"), F.col("r.id") == F.col("got.id"), "left")
    return out.select(
        *[F.col(f"r.{c}").alias(c) for c in ("company_id", "kind", "key", "page", "url")], F.when(same & F.col("_body").isNotNull(), 200).otherwise(F.coalesce(a["status"], F.lit(0))).alias("status"),
        F.when(same, F.col("_body")).otherwise(a["body"]).alias("body"), F.coalesce(a["etag"], F.when(same, F.col("_etag"))).alias("etag"), F.coalesce(a["last_modified"], F.when(same, F.col("_modified"))).alias("last_modified"),
        F.current_timestamp().alias("fetched_at"), F.coalesce(same, F.lit(False)).alias("from_cache"), F.coalesce(a["requests"], F.lit(0)).alias("requests"), F.when(~F.col("may"), F.col("why")).when(same, "").otherwise(F.coalesce(a["error"], F.lit("no answer"))).alias("error"),
    )


def payloads(responses: DataFrame) -> DataFrame:
    """The bronze rows that normalizers read."""
    return responses.select("company_id", "kind", "key", "page", "status", "body")


def pages(responses: DataFrame) -> DataFrame:
    """The rows to add to raw_pages: what was read anew."""
    fresh = responses.where("status = 200 and not from_cache and url is not null")
    return fresh.select("url", "etag", "last_modified", "fetched_at", "status", F.col("body").cast("binary").alias("body"))
