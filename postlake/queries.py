"""Queries over the driver's tables and over literal rows, each with the same in SQL.

Scaled queries run an operator over whole tables with a rule set made from the data's vocabulary; literal ones put hand-written
cases through an operator, and their SQL states the rows that the rules ask for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import experience, html, text
from .operators import evidence, history, ledger, ranking, robots
from .operators.location import location_status
from .plans import reports, universe
from .plans.crawl import absent, scan
from .rules import RuleSet, load_rules, sample_profile, sample_rules
from .ship import shared_dir, spread
from .sources import boards, files, pages  # noqa: F401  register the normalizers
from .sources.base import PAYLOAD, Request, normalizer, within
from .streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 20, 12, 0, 0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_value(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S.%f}'"
    return "'" + str(v).replace("'", "''") + "'"


def values(columns: str, rows: Sequence[Sequence[Any]]) -> str:
    """SQL for literal rows; columns with a type are cast to it."""
    pairs = [c.split() for c in columns.split(", ")]
    names = ", ".join(p[0] for p in pairs)
    cast = ", ".join(f"CAST({p[0]} AS {' '.join(p[1:])}) AS {p[0]}" if len(p) > 1 else p[0] for p in pairs)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_sql_value, r)) + ')' for r in rows)}) t({names})"


def literal(schema: str, cases: Sequence[tuple], n_in: int, expected: str) -> Callable:
    """Register a query over the first n_in fields of the cases; its SQL is (first field, the fields after n_in) as columns of expected."""

    def keep(f: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.createDataFrame([c[:n_in] for c in cases], schema))

        QUERIES[f.__name__] = run
        SQL[f.__name__] = values(expected, [(c[0], *c[n_in:]) for c in cases])
        return run

    return keep


# --- rules over the corpus -------------------------------------------------------------------------------------------------

_EDGE = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _word(words: str) -> str:
    """A word rule that both engines read alike: no look-around, word edges by Unicode class."""
    return f"{_EDGE[0]}(?:{words}){_EDGE[1]}"


SKILLS = [("english", 10, _word("the|and|of")), ("german", 8, _word("der|die|und")), ("spanish", 8, _word("que|los|las")), ("french", 8, _word("le|des|et")), ("numbers", 6, r"[0-9]{2}"), ("mail", 7, r"@[a-z0-9]+\.")]
TITLES = [("short words", 18, _word("in|to|la|zu")), ("article", 10, _word("the|der|el|un")), ("ending", 12, "tion|ung|ción")]
GATES = [("internship/co-op", _word("intern|apprentice")), ("restricted", r"(?:akia|token)"), ("off scope", _word("lorem|ipsum"))]
CORPUS = {"filters": {"min_match_score": 20, "p1_match_score": 40, "p0_match_score": 50, "require_us_location": False}, "matching": {"skill_groups": [{"label": k, "weight": w, "patterns": [p]} for k, w, p in SKILLS], "title_score_rules": [{"label": k, "weight": w, "regex": p} for k, w, p in TITLES]}}


def _scored(docs: DataFrame) -> DataFrame:
    rules = load_rules(CORPUS)
    title, body = F.regexp_extract("text", r"^[^\n]*", 0), F.col("text")
    docs = spread(docs).withColumn("flags", F.array(*ranking.skill_flags(body, rules)))  # each pattern is matched once
    flags = [F.get("flags", k) for k in range(len(rules.skill_groups))]
    groups = F.array_compact(F.array(*[F.when(f, F.lit(k)) for f, (k, _, _) in zip(flags, rules.skill_groups, strict=True)]))
    return docs.withColumn("title", title).withColumn("title_points", ranking.title_score(title, rules)).withColumn("skill_points", ranking.skill_score(flags, rules)).withColumn("groups", groups)


def _sql_points(column: str, rules: list[tuple[str, int, str]], cap: int) -> str:
    return f"least({cap}.0, " + " + ".join(f"CASE WHEN regexp_matches({column}, {_sql_value(p)}, 'i') THEN {w}.0 ELSE 0.0 END" for _, w, p in rules) + ")"


_TITLE_SQL = "regexp_extract(text, '^[^\\n]*', 0)"
_SCORED_SQL = f"""s AS (SELECT *, {_TITLE_SQL} AS title, CAST({_sql_points(_TITLE_SQL, TITLES, 30)} AS DOUBLE) AS title_points, CAST({_sql_points("text", SKILLS, 42)} AS DOUBLE) AS skill_points,
  list_filter([{", ".join(f"CASE WHEN regexp_matches(text, {_sql_value(p)}, 'i') THEN {_sql_value(k)} END" for k, _, p in SKILLS)}], lambda x: x IS NOT NULL) AS groups FROM documents)"""
_KEY_SQL = "sha256(source || '|' || CAST(doc_id AS VARCHAR))"


@query(f"WITH {_SCORED_SQL} SELECT doc_id, title_points, skill_points, array_to_string(groups, ',') AS groups FROM s")
def q_regex_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped sums of weighted rules over title and text."""
    return _scored(table(spark, sf_dir, "documents")).select("doc_id", "title_points", "skill_points", F.array_join("groups", ",").alias("groups"))


@query(
    f"""WITH {_SCORED_SQL}, l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT s.*, CASE WHEN toxic = 1 THEN 0.0 WHEN quality = 1 THEN 0.82 WHEN quality = 0 THEN 0.45 ELSE 0.62 END AS sponsorship,
  title_points + skill_points + CASE WHEN len(groups) >= 4 THEN 6.0 WHEN len(groups) = 3 THEN 4.0 WHEN len(groups) = 2 THEN 2.0 ELSE 0.0 END AS score FROM s LEFT JOIN l USING (doc_id)),
g AS (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches({'title' if k == 'off scope' else 'text'}, {_sql_value(p)}, 'i') THEN {_sql_value(k)} END" for k, p in GATES)},
  CASE WHEN sponsorship < 0.55 THEN 'low evidence' END, CASE WHEN score < 20 THEN 'score below 20' END], lambda x: x IS NOT NULL) AS reasons FROM j)
SELECT doc_id, source, {_KEY_SQL} AS job_key, CAST(score AS DOUBLE) AS score, CAST(sponsorship AS DOUBLE) AS sponsorship, array_to_string(reasons, '; ') AS reasons,
  CASE WHEN len(reasons) > 0 THEN 'REJECT' WHEN score >= 50 AND sponsorship >= 0.75 THEN 'P0' WHEN score >= 40 AND sponsorship >= 0.6 THEN 'P1' ELSE 'P2' END AS priority FROM g"""
)
def q_flagship_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings with their labels as employer evidence: gates, capped score, priority, key, in report order."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    df = _scored(table(spark, sf_dir, "documents")).join(labels, "doc_id", "left")
    known = F.when(F.col("toxic") == 1, 0.0).when(F.col("quality") == 1, 0.82).when(F.col("quality") == 0, 0.45).otherwise(0.62)
    df = df.withColumn("sponsorship", known).withColumn("score", F.col("title_points") + F.col("skill_points") + ranking.breadth_bonus(F.col("groups")))
    gates = [(text.matches(F.col("title") if k == "off scope" else F.col("text"), p), k) for k, p in GATES]
    df = df.withColumn("reasons", ranking.notes(*gates, (F.col("sponsorship") < 0.55, "low evidence"), (F.col("score") < 20, "score below 20")))
    rank = F.when(F.size("reasons") > 0, "REJECT").when((F.col("score") >= 50) & (F.col("sponsorship") >= 0.75), "P0").when((F.col("score") >= 40) & (F.col("sponsorship") >= 0.6), "P1").otherwise("P2")
    key = text.job_key(F.col("source"), F.col("doc_id").cast("string"), F.lit(""), F.lit(""), F.lit(""))
    out = df.select("doc_id", "source", key.alias("job_key"), "score", "sponsorship", F.array_join("reasons", "; ").alias("reasons"), rank.alias("priority"))
    # The sort samples its input first; behind a shuffle of the narrow rows, that doesn't judge every text twice.
    return out.repartition(F.col("job_key")).orderBy(F.col("priority"), F.desc("score"), "job_key")


@query(f"SELECT doc_id, {_KEY_SQL} AS job_key FROM documents")
def q_job_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.job_key(F.col("source"), F.col("doc_id").cast("string"), F.lit(""), F.lit(""), F.lit("")).alias("job_key"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(lang, '\\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || '|') AS content_hash FROM documents")
def q_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.content_hash([F.col("lang"), F.col("source"), F.col("text"), F.lit("")]).alias("content_hash"))


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5")
def q_topn_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's five longest per source."""
    docs = table(spark, sf_dir, "documents").withColumns({"company_id": F.col("source"), "shorter": -F.col("n_chars")})
    return history.top_rejections(docs, 5, "shorter", "doc_id").select("doc_id", "source", "n_chars")


# --- pages --------------------------------------------------------------------------------------------------------------------

_TRACK_SQL = ", ".join(map(_sql_value, text.TRACKING_KEYS))


@query(
    f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?([^#]*))?', ['s', 'h', 'path', 'qq', 'q']) AS u FROM pages),
c AS (SELECT page_id, lower(u.s) || '://' || lower(u.h) || CASE WHEN regexp_replace(regexp_replace(u.path, '/+', '/', 'g'), '/$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(u.path, '/+', '/', 'g'), '/$', '') END AS base,
  array_to_string(list_sort(list_filter(string_split(u.q, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK_SQL}))), '&') AS q FROM p)
SELECT page_id, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM c"""
)
def q_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')) AS text FROM pages"""
)
def q_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS INTEGER) AS n_links, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def q_html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).alias("n_links"), F.array_join(links, " ").alias("links"))


ROBOTS = [("*", False, "/en/1"), ("*", True, "/en/12"), ("*", False, "/*?page="), ("*", False, "/de/*.html$"), ("other", False, "/")]


@query(
    """WITH t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS target FROM pages),
r(allow, rx, n) AS (VALUES (false, '^/en/1', 5), (true, '^/en/12', 6), (false, '^/.*\\?page=', 8), (false, '^/de/.*\\.html$', 10)),
m AS (SELECT page_id, arg_max(allow, n * 2 + CASE WHEN allow THEN 1 ELSE 0 END) AS ok FROM t JOIN r ON regexp_matches(target, rx) GROUP BY page_id)
SELECT page_id, coalesce(ok, true) AS can_fetch FROM t LEFT JOIN m USING (page_id)"""
)
def q_robots_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: page paths against one host's rules."""
    df = table(spark, sf_dir, "pages").withColumn("host", F.lit("h")).withColumn("target", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1))
    rules = spark.createDataFrame([("h", *r) for r in ROBOTS], "host string, agent string, allow boolean, pattern string")
    return robots.allowed(df, rules, "monitor/1.0").select("page_id", "can_fetch")


# --- events as sightings ------------------------------------------------------------------------------------------------------

_SIGHT_SQL = "e AS (SELECT event_id, CAST(user_id AS VARCHAR) || '|' || event_type AS job_key, ts, ts - to_hours(CAST(event_id % 48 AS INTEGER)) AS posted_at, event_id % 7 <> 0 AS usable, event_id % 3 <> 0 AS accepted FROM events)"


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    key = F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("event_type"))
    posted = F.col("ts") - F.make_dt_interval(hours=(F.col("event_id") % 48).cast("int"))
    return e.select("event_id", key.alias("job_key"), "ts", posted.alias("posted_at"), (F.col("event_id") % 7 != 0).alias("usable"), (F.col("event_id") % 3 != 0).alias("accepted"))


@query(
    f"""WITH {_SIGHT_SQL}, w AS (SELECT *, max(CASE WHEN usable OR rn = 1 THEN posted_at END) OVER b AS watermark FROM (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY ts, event_id) AS rn FROM e)
  WINDOW b AS (PARTITION BY job_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, coalesce(posted_at BETWEEN ts - INTERVAL 36 HOUR AND ts + INTERVAL 24 HOUR, false) AS in_window FROM w),
f AS (SELECT *, min(CASE WHEN usable AND accepted AND in_window THEN rn END) OVER (PARTITION BY job_key) AS start FROM c),
d AS (SELECT *, coalesce(start < rn, false) AS delivered FROM f),
r AS (SELECT *, delivered AND coalesce(posted_at > watermark + INTERVAL 12 HOUR AND posted_at >= ts - INTERVAL 36 HOUR, false) AS repost FROM d)
SELECT event_id, watermark, delivered, CASE WHEN repost THEN 'reposted' WHEN delivered THEN 'seen' ELSE 'new' END AS event, usable AND accepted AND CASE WHEN delivered THEN repost ELSE in_window END AS emitted FROM r"""
)
def q_event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole history decided in two windowed passes."""
    s = _sightings(spark, sf_dir).withColumns({"run_at": F.col("ts"), "run_id": F.lpad(F.col("event_id").cast("string"), 12, "0"), "mode": F.lit("incremental"), "since": F.col("ts") - F.expr("interval 36 hours"), "verified": F.lit(True), "open": F.lit(True)})
    return history.replay(s).select("event_id", F.col("watermark").cast("timestamp_ntz").alias("watermark"), "delivered", "event", "emitted")


@query(f"WITH {_SIGHT_SQL} SELECT job_key, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM e GROUP BY job_key")
def q_first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.first_last_seen(_sightings(spark, sf_dir), at="ts")
    return out.select("job_key", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"), F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen_at"))


@query(
    """WITH l AS (SELECT event_id, timezone('America/Los_Angeles', timezone('UTC', ts)) - INTERVAL '7 hours 17 minutes' AS local FROM events)
SELECT event_id, strftime(local, '%Y-%m-%d') || CASE WHEN hour(local) < 12 THEN '-morning' ELSE '-evening' END AS window_key FROM l"""
)
def q_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-day sessions of local wall time."""
    return table(spark, sf_dir, "events").select("event_id", ledger.session_key(F.col("ts").cast("timestamp")).alias("window_key"))


@query("SELECT event_id, ts BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-21 12:00:00' AS fresh, event_type IN ('click', 'view') AS verified FROM events")
def q_fresh_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dated with a confidence that counts, within the window to a day past now."""
    rules = load_rules({"filters": {"date_confidence_allowed": ["click", "view"]}})
    ts, now = F.col("ts").cast("timestamp"), F.lit(NOW)
    return table(spark, sf_dir, "events").select("event_id", history.in_window(ts, now - F.expr("interval 7 days"), now).alias("fresh"), history.date_verified(ts, F.col("event_type"), rules).alias("verified"))


@query(
    """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS k, ts, value, event_id FROM events WHERE ts < TIMESTAMP '2024-01-15'), d AS (SELECT CAST(user_id AS VARCHAR) AS k, ts, value, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
x AS (SELECT k, arg_max(ts, ts) AS ts FROM b GROUP BY k), y AS (SELECT k, max(ts) AS ts FROM d GROUP BY k)
SELECT coalesce(x.k, y.k) AS job_key, greatest(x.ts, y.ts) AS posted_at, CASE WHEN y.ts > x.ts OR x.ts IS NULL THEN 'delta' ELSE 'base' END AS report_id FROM x FULL JOIN y ON x.k = y.k"""
)
def q_receipts_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: receipts of two halves of the events, the later date staying."""
    e = table(spark, sf_dir, "events").withColumn("job_key", F.col("user_id").cast("string"))
    part = lambda cond, name: e.where(cond).groupBy("job_key").agg(F.max("ts").alias("posted_at")).withColumn("report_id", F.lit(name))
    return history.merge_receipts(part("ts < timestamp_ntz'2024-01-15'", "base"), part("ts >= timestamp_ntz'2024-01-15'", "delta")).select("job_key", "posted_at", "report_id")


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def q_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: of a key's postings in a run the first that may be emitted is."""
    e = table(spark, sf_dir, "events").withColumns({"job_key": F.concat_ws("|", "user_id", "event_type"), "posted_at": F.col("ts").cast("timestamp"), "seq": F.struct("ts", "event_id")})
    e = e.withColumns({"mode": F.lit("initial"), "accepted": F.lit(True), "raw": F.lit("{}"), "since": F.lit(D(2000, 1, 1)), "posting_date_confidence": F.lit("high"), "content_hash": F.lit("h"), "rejection_reasons": F.array().cast("array<string>")})
    none = spark.createDataFrame([], "job_key string, posted_at timestamp, first_seen_at timestamp, content_hash string")
    out = history.decide_events(e, none, none.select("job_key", "posted_at"), none.select("job_key"), load_rules({}), F.lit(D(2030, 1, 1)))
    return out.where("emit").select("user_id", "event_type", "event_id", "ts")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS sightings, count(DISTINCT user_id) AS keys, count(*) FILTER (WHERE value > 50) AS emitted FROM events GROUP BY ALL")
def q_sightings_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("day", "event_type").agg(F.count("*").alias("sightings"), F.countDistinct("user_id").alias("keys"), F.count_if(F.col("value") > 50).alias("emitted"))


@query(
    """WITH m AS (SELECT event_type AS company_id, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS page, max(ts) AS newest, min(ts) AS oldest FROM events GROUP BY ALL),
o AS (SELECT *, newest < TIMESTAMP '2024-01-19' AS old, coalesce(newest > lag(oldest) OVER w + INTERVAL 24 HOUR, false) AS jump FROM m WINDOW w AS (PARTITION BY company_id ORDER BY page)),
p AS (SELECT *, old AND coalesce(lag(old) OVER w, false) AND NOT max(jump) OVER (PARTITION BY company_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS stop FROM o WINDOW w AS (PARTITION BY company_id ORDER BY page))
SELECT company_id, page, newest, coalesce(max(stop) OVER (PARTITION BY company_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM p"""
)
def q_page_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages in a row with nothing newer than the horizon end a listing."""
    e = table(spark, sf_dir, "events").withColumns({"company_id": F.col("event_type"), "page": F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).cast("long"), "at": F.col("ts").cast("timestamp")})
    ages = e.groupBy("company_id", "page").agg(F.max("at").alias("newest"), F.min("at").alias("oldest"), F.lit(0).alias("unread"), F.lit(D(2024, 1, 20)).alias("since"), F.first("page").cast("string").alias("print"))
    return boards.list_ends(ages).select("company_id", "page", F.col("newest").cast("timestamp_ntz").alias("newest"), "ended")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS company_id, s <= 10 AND wanted AS taken, wanted AND s > 10 AS over FROM (SELECT *, value > 10 AS wanted, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)")
def q_request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten wanted rows of a company are taken, the rest is left unseen."""
    e = table(spark, sf_dir, "events").withColumn("company_id", F.col("user_id").cast("string"))
    taken, over = within(F.lit(10), [F.col("ts"), F.col("event_id")], F.col("value") > 10)
    return e.select("event_id", "company_id", taken.alias("taken"), over.alias("over"))


# --- orders as runs, customers as companies -----------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sightings, runs): an order is a run that showed its customer; F and O are usable."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    runs = o.select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"))
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job_key"), (F.col("o_totalprice") > 100000).alias("emitted")), runs


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')) AS delivered FROM customer")
def q_delivered_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a usable run emitted the key."""
    sent = history.delivered(*_orders(spark, sf_dir)).withColumn("d", F.lit(True))
    return table(spark, sf_dir, "customer").join(sent, F.col("c_custkey") == F.col("job_key"), "left").select("c_custkey", F.coalesce("d", F.lit(False)).alias("delivered"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000 AND o_orderstatus IN ('F', 'O'))")
def q_never_delivered_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = history.delivered(*_orders(spark, sf_dir))
    return table(spark, sf_dir, "customer").join(sent, F.col("c_custkey") == F.col("job_key"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS active FROM customer")
def q_deactivate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a complete snapshot did not show go inactive."""
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_key"), F.lit("c").alias("company_id"), F.lit(True).alias("active"))
    return history.deactivate_missing(jobs, _orders(spark, sf_dir)[0], ["c"]).select(F.col("job_key").alias("c_custkey"), "active")


@query("SELECT CAST(o_custkey AS VARCHAR) AS company_id, 'board' AS source, max(o_orderdate) AS last_ok FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def q_company_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of the newest usable run in which the source completed."""
    s, runs = _orders(spark, sf_dir)
    ok = F.when(F.col("status") == "success", "ok").otherwise("degraded")
    by = s.join(runs, "run_id").select("run_id", F.col("job_key").cast("string").alias("company_id"), F.lit("board").alias("source"), ok.alias("status"))
    return history.cursors(by, runs).select("company_id", "source", "last_ok")


_PLAN_SQL = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 4 AS r FROM customer), k AS (SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderdate) AS last_ok FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


@query(f"{_PLAN_SQL} SELECT id, CASE WHEN last_ok IS NULL OR r <> 0 THEN 'initial' ELSE 'incremental' END AS mode, CASE WHEN last_ok IS NULL OR r <> 0 THEN TIMESTAMP '2024-01-13 12:00:00' ELSE last_ok - INTERVAL 6 HOUR END AS since, r <> 0 AS backfill FROM c LEFT JOIN k USING (id)")
def q_profile_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-company mode and start; a changed rule set means a backfill."""
    rules = load_rules({})
    s, runs = _orders(spark, sf_dir)
    ok = F.when(F.col("status") == "success", "ok").otherwise("degraded")
    cursor = history.cursors(s.join(runs, "run_id").select("run_id", F.col("job_key").cast("string").alias("company_id"), F.lit("board").alias("source"), ok.alias("status")), runs)
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("board").alias("connector_type"), "c_custkey")
    prints = companies.where("c_custkey % 4 < 2").select(F.col("id").alias("company_id"), F.lit("board").alias("source"), F.when(F.col("c_custkey") % 4 == 0, rules.fingerprint).otherwise("old").alias("profile_fingerprint"))
    out = history.plan_sources(companies.drop("c_custkey"), cursor.withColumn("last_ok", F.col("last_ok").cast("timestamp")), prints, rules, "auto", F.lit(NOW))
    return out.select("id", "mode", F.col("since").cast("timestamp_ntz").alias("since"), "backfill")


_RUN_SQL = "r AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, count(*) FILTER (WHERE o_orderstatus = 'F') AS companies_ok, count(*) FILTER (WHERE o_orderstatus <> 'F') AS companies_failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS companies_degraded, CAST(sum(o_custkey) AS BIGINT) AS fetched_jobs FROM orders GROUP BY 1)"


@query(f"WITH {_RUN_SQL} SELECT *, CASE WHEN companies_ok + companies_degraded = 0 THEN 'failed' WHEN companies_failed > 0 THEN 'partial' ELSE 'success' END AS status FROM r")
def q_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: what a month's orders, as sources, make of their run."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "degraded").otherwise("error")
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run"), status.alias("status"), F.col("o_custkey").alias("fetched_jobs"))
    return ledger.run_statistics(o, "run").withColumn("status", ledger.run_status(F.col("companies_ok"), F.col("companies_degraded"), F.col("companies_failed")))


@query(
    """SELECT n_name AS company, CAST(n_nationkey AS VARCHAR) AS company_id, n_regionkey <> 0 AS enabled, 'board' AS source,
CASE WHEN n_regionkey = 0 THEN 'skipped' WHEN s.n % 3 = 0 THEN 'error' WHEN s.n % 3 = 1 THEN 'degraded' ELSE 'ok' END AS status, s.n AS jobs_fetched, r_name AS sponsorship_confidence
FROM nation JOIN region ON r_regionkey = n_regionkey JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey"""
)
def q_health_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their company, by status."""
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    c = nation.join(F.broadcast(region), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 0).alias("enabled"), F.lit("").alias("careers_url"), F.col("r_name").alias("confidence"))
    n = supplier.groupBy(F.col("s_nationkey").cast("string").alias("company_id")).agg(F.count("*").alias("fetched_jobs"))
    k = F.col("fetched_jobs") % 3
    rows = n.join(F.broadcast(c.select(F.col("id").alias("company_id"), F.col("enabled").alias("on"))), "company_id").select("company_id", F.lit("board").alias("source"), "fetched_jobs", F.lit(1).alias("requests"), F.when(k == 0, "boom").otherwise("").alias("error"), F.lit("").alias("warning"), (~F.col("on")).alias("skipped"), (k == 2).alias("cursor_complete"))
    return ledger.health(ledger.source_status(rows), c).select("company", "company_id", "enabled", "source", "status", "jobs_fetched", "sponsorship_confidence")


@query(
    """WITH b AS (SELECT o_custkey AS k, max(o_orderdate) AS d, min(o_orderdate) AS f FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_orderdate) AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT CAST(coalesce(b.k, n.k) AS VARCHAR) AS job_key, greatest(b.d, n.d) AS posted_at, coalesce(b.f, TIMESTAMP '2024-01-20 12:00:00') AS first_seen_at, CASE WHEN n.k IS NULL THEN b.d ELSE TIMESTAMP '2024-01-20 12:00:00' END AS last_seen_at, true AS active FROM b FULL JOIN n ON b.k = n.k"""
)
def q_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys joined in full with a run's, dates only moving on."""
    return _merged_jobs(spark, sf_dir, True)


@query(
    """WITH b AS (SELECT o_custkey AS k, max(o_orderdate) AS d, min(o_orderdate) AS f FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_orderdate) AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT CAST(coalesce(b.k, n.k) AS VARCHAR) AS job_key, coalesce(b.d, n.d) AS posted_at, coalesce(b.f, TIMESTAMP '2024-01-20 12:00:00') AS first_seen_at, CASE WHEN n.k IS NULL THEN b.d ELSE TIMESTAMP '2024-01-20 12:00:00' END AS last_seen_at, true AS active FROM b FULL JOIN n ON b.k = n.k"""
)
def q_failed_run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: a failed run is seen, but moves no date that is stored."""
    return _merged_jobs(spark, sf_dir, False)


@query(
    """WITH new AS (SELECT CAST(user_id AS VARCHAR) AS company_id, event_type AS source, max(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL), old AS (SELECT CAST(user_id AS VARCHAR) AS company_id, event_type AS source, max(value) AS value FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE (company_id, source) NOT IN (SELECT (company_id, source) FROM new)"""
)
def q_upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's rows in the place of stored ones of their key."""
    e = table(spark, sf_dir, "events")
    part = lambda cond: e.where(cond).groupBy(F.col("user_id").cast("string").alias("company_id"), F.col("event_type").alias("source")).agg(F.max("value").alias("value"))
    return history.upsert(part("ts < timestamp_ntz'2024-01-20'"), part("ts >= timestamp_ntz'2024-01-20'"), ["company_id", "source"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS job_key, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AS seen FROM customer")
def q_has_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keys the store knows."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("job_key"))
    return history.has_seen(table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").cast("string").alias("job_key")), keys)


@query("SELECT n_name AS a, coalesce(nullif(n_name, 'FRANCE'), nullif(r_name, 'ASIA'), 'none') AS first FROM nation JOIN region ON r_regionkey = n_regionkey")
def q_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that is neither null nor empty."""
    df = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    blank = lambda c, v: F.when(F.col(c) != v, F.col(c)).otherwise("")
    return df.select(F.col("n_name").alias("a"), text.present(blank("n_name", "FRANCE"), blank("r_name", "ASIA"), default="none").alias("first"))


def _merged_jobs(spark: SparkSession, sf_dir: str, promote: bool) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")).withColumn("job_key", F.col("o_custkey").cast("string"))
    blank = {c: F.lit("") for c in ("company_id", "source_job_id", "source_url", "title", "location", "content_hash")}
    old = o.where("at < timestamp'1996-01-01'").groupBy("job_key").agg(F.max("at").alias("posted_at"), F.min("at").alias("first_seen_at")).withColumn("last_seen_at", F.col("posted_at")).withColumns(blank).withColumn("last_emitted_at", F.lit(None).cast("timestamp")).withColumn("active", F.lit(True))
    new = o.where("at >= timestamp'1996-01-01'").groupBy("job_key").agg(F.max("at").alias("posted_at")).withColumns(blank).withColumn("emit", F.lit(True)).withColumn("seq", F.lit(0))
    out = history.merge_jobs(old, new, F.lit(NOW), promote=promote)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("job_key", ntz("posted_at"), ntz("first_seen_at"), ntz("last_seen_at"), "active")


@query(
    """WITH a AS (SELECT lower(c_mktsegment) AS key, 'A' AS batch, max(c_acctbal) AS score, min(c_name) AS name FROM customer GROUP BY 1), b AS (SELECT lower(r_name) AS key, 'B' AS batch, 0.0 AS score, r_name AS name FROM region UNION ALL SELECT lower(c_mktsegment), 'B', min(c_acctbal), 'second' FROM customer WHERE c_mktsegment LIKE 'B%' GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN 'A+B' ELSE coalesce(a.batch, b.batch) END AS batch, coalesce(a.score, b.score) AS score, coalesce(a.name, b.name) AS name FROM a FULL JOIN b ON a.key = b.key"""
)
def q_universe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches joined in full, the first outranking the second."""
    c, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "region")
    full = {"id": F.col("key"), "domain": F.lit(""), "careers_url": F.lit(""), "enabled": F.lit(True), "connector": F.lit("{}"), "monitor_status": F.lit(""), "confidence": F.lit(""), "summary": F.lit(""), "sources": F.array().cast("array<string>"), "evidence_year": F.lit(""), "certified": F.lit(0), "software_related": F.lit(0), "change_employer": F.lit(0), "fit_tags": F.array().cast("array<string>"), "notes": F.lit(""), "sector": F.lit("")}
    a = c.groupBy(F.lower("c_mktsegment").alias("key")).agg(F.max("c_acctbal").alias("score"), F.min("c_name").alias("name")).withColumns(full).withColumn("batch", F.lit("A"))
    b = r.select(F.lower("r_name").alias("key"), F.lit(0.0).alias("score"), F.col("r_name").alias("name")).unionByName(c.where("c_mktsegment like 'B%'").groupBy(F.lower("c_mktsegment").alias("key")).agg(F.min("c_acctbal").alias("score"), F.lit("second").alias("name")))
    return universe.merge(a, b.withColumns(full).withColumn("batch", F.lit("B")).select(*a.columns)).select("key", "batch", "score", "name")


@query(
    """WITH n AS (SELECT l_suppkey, count(*) FILTER (WHERE l_linestatus = 'F') AS certified, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS relevant, coalesce(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) END), 0) AS changes FROM lineitem GROUP BY 1)
SELECT l_suppkey, certified, relevant, CAST(changes AS BIGINT) AS changes, CASE WHEN certified >= 300 AND relevant >= 100 AND changes > 0 THEN 'high' WHEN certified >= 280 AND relevant >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM n"""
)
def q_lca_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An employer's confidence from counts of its filings."""
    df = table(spark, sf_dir, "lineitem")
    return evidence.rubric(df, "l_suppkey", F.col("l_linestatus") == "F", F.col("l_returnflag") == "R", F.col("l_quantity").cast("long"), (300, 100), (280, 50))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS company_id, lower(r_name) AS source, 'ValueError: unknown connector type: ' || lower(r_name) AS error FROM nation JOIN region ON r_regionkey = n_regionkey")
def q_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of all connector types in one table; types without a normalizer fail company by company."""
    companies = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    companies = companies.select(F.col("n_nationkey").cast("string").alias("id"), F.lower("r_name").alias("connector_type"))
    done = scan(spark, companies, spark.createDataFrame([], PAYLOAD), spark.createDataFrame([], "company_id string, source_url string"), load_rules({}), F.lit(NOW))
    return done.results.select("company_id", "source", "error")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer EXCEPT SELECT CAST(s_suppkey * 3 AS VARCHAR) FROM supplier")
def q_except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted but not there."""
    ids = lambda t, c: table(spark, sf_dir, t).select(c.cast("string").alias("id"))
    return absent(ids("customer", F.col("c_custkey")), ids("supplier", F.col("s_suppkey").cast("long") * 3))


@query(
    """WITH n AS (SELECT n_regionkey AS k, list(DISTINCT n_name) AS names FROM nation GROUP BY 1), s AS (SELECT n_regionkey AS k, list(DISTINCT n_name) AS names FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0 GROUP BY 1)
SELECT k, list_has_any(n.names, coalesce(s.names, [])) AS overlaps, array_to_string(list_sort(list_distinct(list_concat(n.names, coalesce(s.names, [])))), ',') AS tags FROM n LEFT JOIN s USING (k)"""
)
def q_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection test and sorted union of tag sets."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    n = nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.collect_set("n_name").alias("a"))
    s = supplier.where("s_acctbal > 0").join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey")).groupBy(F.col("n_regionkey").alias("k")).agg(F.collect_set("n_name").alias("b"))
    b = F.coalesce("b", F.array().cast("array<string>"))
    return n.join(s, "k", "left").select("k", F.arrays_overlap("a", b).alias("overlaps"), F.array_join(F.array_sort(F.array_union("a", b)), ",").alias("tags"))


@query("SELECT table_name AS \"table\", rows FROM (SELECT 'customer' AS table_name, count(*) AS rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders)")
def q_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: row counts of all tables, as a backup's manifest has them."""
    return ledger.integrity({t: table(spark, sf_dir, t) for t in ("customer", "nation", "orders")})


# --- literal cases ------------------------------------------------------------------------------------------------------------

D = datetime
DATES = [
    (1, None, None), (2, "", None), (3, "today", D(2024, 1, 20)), (4, "Posted Yesterday", D(2024, 1, 19)), (5, "Posted 3 days ago", D(2024, 1, 17, 12)), (6, "2 hours ago", D(2024, 1, 20, 10)), (7, "1 month ago", D(2023, 12, 21, 12)),
    (8, "2024-01-05", D(2024, 1, 5)), (9, "2024-01-05T10:20:30Z", D(2024, 1, 5, 10, 20, 30)), (10, "2024-01-05T10:20:30.123456789+02:00", D(2024, 1, 5, 8, 20, 30, 123456)), (11, "2024-1-5", D(2024, 1, 5)), (12, "01/31/2024", D(2024, 1, 31)),
    (13, "January 5, 2024", D(2024, 1, 5)), (14, "Feb 7, 2024", D(2024, 2, 7)), (15, "Fri, 05 Jan 2024 10:00:00 +0100", D(2024, 1, 5, 9)), (16, "2024", None), (17, "2024-01", None), (18, "12:30", None), (19, "soon", None), (20, "2024-02-30", None),
    (21, "20240105", D(2024, 1, 5)), (22, "2024-W02-3", D(2024, 1, 10)), (23, "2024-01-05T10", D(2024, 1, 5, 10)), (24, "30+ days", None), (25, "2 weeks ago", D(2024, 1, 6, 12)),
]


@literal("id int, value string", DATES, 2, "id INTEGER, parsed TIMESTAMP")
def q_parse_datetime(df: DataFrame) -> DataFrame:
    """X1."""
    return df.select("id", text.parse_datetime(F.col("value"), F.lit(NOW)).cast("timestamp_ntz").alias("parsed"))


URLS = [
    (1, "HTTPS://Example.COM//a//b/?utm_source=x&b=2&a=1#frag", "https://example.com/a/b?a=1&b=2"), (2, "http://h.example", "http://h.example/"), (3, "", ""), (4, None, ""), (5, "https://h.example/x?q=a+b&q=%7E&gh_jid=9", "https://h.example/x?q=a+b&q=~"),
    (6, "https://h.example/x?empty=&flag", "https://h.example/x?empty=&flag="), (7, "/relative//path/", "/relative/path"), (8, "https://h.example/p?a=*&A=ü", "https://h.example/p?A=%C3%BC&a=%2A"), (9, "https://h.example/?Source=feed", "https://h.example/"),
]


@literal("id int, url string", URLS, 2, "id INTEGER, canonical VARCHAR")
def q_canonical_url_cases(df: DataFrame) -> DataFrame:
    """X5."""
    return df.select("id", text.canonical_url(F.col("url")).alias("canonical"))


TEXTS = [
    (1, "ACME Corp. & Sons!", "acme-corp-sons", "ACME Corp. & Sons!", 12), (2, "--x--", "x", "--x--", None), (3, "a; b ;;c", "a-b-c", "a|b|c", None), (4, "12 had software", "12-had-software", "12 had software", 12), (5, "", "", "", None),
]


@literal("id int, value string", [(a, b, c, d, (12 if a == 4 else None)) for a, b, c, d, _ in TEXTS], 2, "id INTEGER, slug VARCHAR, parts VARCHAR, n INTEGER")
def q_slug(df: DataFrame) -> DataFrame:
    """X10, X11, X12."""
    v = F.col("value")
    return df.select("id", text.slug(v).alias("slug"), F.array_join(text.split_values(v), "|").alias("parts"), text.integer_from(r"(\d+)\s+had software", v).alias("n"))


HYPHENS = [(1, "a‐b–c—d―e", "a-b-c-d-e", 3, "three"), (2, "plain", "plain", 12, "12"), (3, "", "", None, "many")]


@literal("id int, value string, word string", [(i, v, w, f, n) for i, v, f, n, w in HYPHENS], 3, "id INTEGER, folded VARCHAR, years INTEGER")
def q_fold_and_years(df: DataFrame) -> DataFrame:
    """X14, X18."""
    return df.select("id", text.fold_hyphens(F.col("value")).alias("folded"), text.year_value(F.col("word")).alias("years"))


PLACES = [
    (1, "New York, NY", "", "[]", "", "us"), (2, "London, United Kingdom", "", "[]", "US", "non_us"), (3, "Remote", "", "[]", "US", "us_inferred_remote"), (4, "Remote", "", "[]", "", "unknown"), (5, "Dublin, OH", "", "[]", "", "us"),
    (6, "Bengaluru | Austin, TX", "", "[]", "", "us"), (7, "Remote - CA", "", "[]", "", "unknown"), (8, "Toronto; Pune", "", "[]", "", "non_us"), (9, "Anywhere", "", '["United States"]', "", "us"), (10, "Austin, TX", "", '["DE"]', "", "non_us"),
    (11, "london, or maybe here", "", "[]", "", "non_us"), (12, "Mexico City, Mexico", "", "[]", "", "non_us"), (13, "Santa Fe, New Mexico", "", "[]", "", "us"), (14, "", "", "[]", "US", "unknown"), (15, "Vancouver, WA (Hybrid)", "", "[]", "", "us"),
    *[(20 + k, place, "", "[]", "US", "non_us") for k, place in enumerate(["Toronto, CA", "Panamá, Provincia de Panamá, PA", "Karnataka, Karnātaka, IN", "Batumi, Georgia", "Remote - Argentina", "Remote - Costa Rica", "Tbilisi, Georgia"])],
    *[(30 + k, place, "", "[]", "US", "us") for k, place in enumerate(["Dublin, CA", "London, Kentucky", "New London, CT", "Mexico, Missouri", "Brazil, IN", "Panama City, FL Hybrid", "Vancouver, WA Remote", "Toronto, Canada | New York, US", "US", "Seattle, US"])],
    *[(40 + k, place, "", "[]", "US", "unknown") for k, place in enumerate(["Remote, CA", "Remote, IN", "Location TBD or negotiable"])], (50, "Karnataka, IN", "", '["IN"]', "US", "non_us"),
    (16, "India, Remote - US", "", "[]", "", "us"), (17, "Georgia", "Remote", "[]", "", "us"), (18, "Mars", "", "[]", "", "unknown"),
]


@literal("id int, location string, workplace string, countries string, country string", PLACES, 5, "id INTEGER, status VARCHAR")
def q_location_status(df: DataFrame) -> DataFrame:
    """C1."""
    return df.select("id", location_status(F.col("location"), F.col("workplace"), F.from_json("countries", "array<string>"), F.col("country")).alias("status"))


SIGNALS = [
    (1, "We will not sponsor work visas.", "explicit_no_sponsorship", 0.0), (2, "No visa sponsorship", "explicit_no_sponsorship", 0.0), (3, "H-1B sponsorship is available", "explicit_h1b_sponsorship_available", 0.92), (4, "Visa sponsorship available", "explicit_sponsorship_available", 0.62),
    *[(20 + k, say, "explicit_no_sponsorship", 0.0) for k, say in enumerate(["This job is not eligible for employment-based sponsorship.", "People requiring visa sponsorship will not be considered.", "Sponsorship is unavailable.", "We may not be able to employ some visa categories or support H-1B sponsorship.", "H-1B transfers are not supported.", "No immigration assistance is available.", "You must have unrestricted work authorization.", "We are not considering people who require visa sponsorship.", "Sponsorship for employment authorization is not available.", "Visa sponsorship cannot be accommodated.", "We won’t sponsor visas.", "H1B candidates cannot be considered.", "Applicants must not now or in the future require visa sponsorship.", "Sponsorship: None.", "We cannot transfer H-1Bs.", "Immigration support is not provided."])],
    (40, "H-1B transfer sponsorship is available.", "explicit_h1b_sponsorship_available", 0.92), (41, "Without a doubt, visa sponsorship is available", "explicit_sponsorship_available", 0.62), (42, "No visa sponsorship required for citizens", "not_stated", 0.62),
    (5, "We build tools", "not_stated", 0.62), (6, "We sponsor H1B; no sponsorship.", "explicit_no_sponsorship", 0.0), (7, "Must be authorized to work in the US without sponsorship", "explicit_no_sponsorship", 0.0), (8, "Our charity sponsors events", "not_stated", 0.62), (9, "We do sponsor visas", "explicit_sponsorship_available", 0.62),
]


@literal("id int, text string", SIGNALS, 2, "id INTEGER, signal VARCHAR, score DOUBLE")
def q_sponsor_signal(df: DataFrame) -> DataFrame:
    """C2, C3, C4."""
    s = evidence.role_signal(F.col("text"))
    return df.select("id", s.alias("signal"), evidence.role_score(s, evidence.employer_score(F.lit("medium"))).cast("double").alias("score"))


def _read(rules: RuleSet) -> Column:
    return experience.read_experience(F.col("text"), F.col("text"), rules.secondary_groups, rules["work_authorization_restriction_regex"], rules.required_scopes, rules.degree, rules["core_technology_regex"])


YEARS = [
    (1, "5+ years of experience in backend", 5.0, 5.0), (2, "3-5 years of software development", 3.0, 5.0), (3, "Founded 20 years ago", None, None), (4, "Minimum of two years of Java", 2.0, 2.0), (5, "more than 3 years of experience", 4.0, 4.0),
    (6, "Bachelor's and 5 years of experience or Master's and 3 years of experience", 3.0, 3.0), (7, "Preferred qualifications: 8 years of experience", 8.0, 8.0), (8, "Minimum qualifications: 2 years of experience. Preferred qualifications: 6 years of experience", 2.0, 2.0), (9, "no numbers", None, None), (10, "", None, None),
    (11, "We have been around; our team has 30 years of experience", None, None), (12, "You have 4 years working with Kafka", 4.0, 4.0), (13, "Options vest over 4 years", None, None), (14, "Master's degree and 5 years of experience, or 8 years of experience without a degree", 5.0, 5.0),
]


@literal("id int, text string", YEARS, 2, "id INTEGER, min_years DOUBLE, max_years DOUBLE")
def q_years(df: DataFrame) -> DataFrame:
    """P1 to P4, P6."""
    r = _read(sample_rules())
    return df.withColumn("r", r).select("id", F.col("r.min_years").alias("min_years"), F.col("r.max_years").alias("max_years"))


BOUND = [
    (1, "3 years of experience with Kafka", "Kafka/MSK:3", False, ""), (2, "3 years of Java or Python", "", False, ""), (3, "3 years of Python", "Python/FastAPI:3", False, ""), (4, "3 years of AWS experience and Python familiarity", "", False, ""), (5, "Kafka (preferred)", "", False, ""),
    (6, "U.S. citizenship is required", "", True, ""), (7, "U.S. citizenship is required is preferred", "", False, ""), (8, "Experience with full-stack", "", False, "full-stack/frontend ownership"), (9, "Redis, Kafka: 2 years of experience", "Redis/ElastiCache:2,Kafka/MSK:2", False, ""), (10, "Nice to have: experience with full-stack", "", False, ""),
]


@literal("id int, text string", BOUND, 2, "id INTEGER, overages VARCHAR, restricted BOOLEAN, scopes VARCHAR")
def q_bound_technology(df: DataFrame) -> DataFrame:
    """P5, P7, G10, G16, G22."""
    r = _read(sample_rules())
    over = F.array_join(F.transform("r.overages", lambda o: F.concat(o["label"], F.lit(":"), o["years"].cast("string"))), ",")
    return df.withColumn("r", r).select("id", over.alias("overages"), F.col("r.restricted").alias("restricted"), F.array_join("r.scopes", ",").alias("scopes"))


OPEN = [(1, '{"validThrough": "2024-01-19"}', False), (2, '{"validThrough": "2024-01-20T00:00:00Z"}', True), (3, '{"canApply": false}', False), (4, '{"isListed": false}', False), (5, '{"canApply": null}', True), (6, "{}", True), (7, None, True), (8, '{"application_deadline": "soon"}', True)]


@literal("id int, raw string", OPEN, 2, "id INTEGER, open BOOLEAN")
def q_open_for_application(df: DataFrame) -> DataFrame:
    """F3."""
    return df.select("id", history.open_for_application(F.col("raw"), F.lit(NOW)).alias("open"))


RANKS = [
    (1, True, True, False, False, 3.0, 90.0, 0.8, 1.0, "P0"), (2, True, True, False, False, 3.0, 90.0, 0.8, 3.0, "P1"), (3, True, False, False, False, 3.0, 75.0, 0.65, 1.0, "P1"), (4, True, True, True, False, 3.0, 90.0, 0.8, 1.0, "P1"), (5, True, True, False, True, 3.0, 90.0, 0.8, 1.0, "P2"),
    (6, True, True, False, False, None, 90.0, 0.8, 1.0, "P2"), (7, True, True, False, False, 2.0, 90.0, 0.8, 1.0, "P2"), (8, False, True, False, False, 3.0, 90.0, 0.8, 1.0, "REJECT"), (9, True, True, False, False, 3.0, 90.0, 0.8, None, "P0"), (10, True, True, False, False, 3.0, 60.0, 0.8, 1.0, "P2"),
]


@literal("id int, accepted boolean, specialty boolean, secondary boolean, band boolean, years double, score double, sponsorship double, age double", RANKS, 9, "id INTEGER, priority VARCHAR")
def q_priority(df: DataFrame) -> DataFrame:
    """R6."""
    c = F.col
    return df.select("id", ranking.priority(c("accepted"), c("specialty"), c("secondary"), c("band"), c("years"), c("score"), c("sponsorship"), c("age"), load_rules({})).alias("priority"))


_GOOD = "Build backend services in Java. 3+ years of experience."
JOBS = [
    (1, "Platform Engineer", _GOOD, "Austin, TX", 0.8, True, "", "P1"), (2, "Platform Engineer Intern", _GOOD, "Austin, TX", 0.8, False, "internship/co-op", "REJECT"), (3, "Platform Engineer", _GOOD, "Berlin, Germany", 0.8, False, "non-US location", "REJECT"), (4, "Chef", _GOOD, "Austin, TX", 0.8, False, "title lacks a target engineering discipline", "REJECT"),
    (5, "Staff Platform Engineer", _GOOD, "Austin, TX", 0.8, False, "staff/principal/architect/lead level", "REJECT"), (6, "Platform Engineer", "Build backend services in Java. 9+ years of experience.", "Austin, TX", 0.8, False, "requires about 9+ years; match score 48 is below 50", "REJECT"),
    (7, "Platform Engineer", _GOOD, "Austin, TX", 0.2, False, "employer/role sponsorship confidence below threshold", "REJECT"), (8, "Senior Platform Engineer", "Build backend services in Java.", "Austin, TX", 0.8, False, "Senior title with no verifiable 3-4 year experience floor; match score 48 is below 50", "REJECT"),
    (9, "Platform Engineer", _GOOD + " No visa sponsorship.", "Austin, TX", 0.8, False, "posting explicitly rules out sponsorship; employer/role sponsorship confidence below threshold", "REJECT"), (10, "Platform Engineer", "<p>Build backend services in Java.</p><p>1-3 years of experience.</p>", "Austin, TX", 0.8, False, "experience range is an early-career band (1-3 years); match score 45 is below 50", "REJECT"),
    (11, "Platform Engineer", "Gardening", "Austin, TX", 0.8, False, "posting lacks a professionally evidenced core technology or domain; operations-oriented title lacks software-development evidence; match score 28 is below 50", "REJECT"),
]


@literal("seq int, title string, description string, location string, score double", JOBS, 5, "seq INTEGER, accepted BOOLEAN, reasons VARCHAR, priority VARCHAR")
def q_gates(df: DataFrame) -> DataFrame:
    """G1 to G28, R1 to R6 through the whole evaluation."""
    rules = load_rules({"filters": {"min_match_score": 50, "p1_match_score": 55, "p0_match_score": 82}})
    rest = {c: F.lit("") for c in ("department", "employment_type", "workplace_type", "raw", "default_country")}
    df = df.withColumns(rest).withColumns({"source_url": F.lit("https://h.example/1"), "posted_at": F.lit(NOW), "confidence": F.lit("high")})
    return ranking.evaluate(df, rules, F.lit(NOW)).select("seq", "accepted", F.array_join("rejection_reasons", "; ").alias("reasons"), "priority")


_OK = "Build Java backend services on AWS. Requires 3+ years of software engineering experience."
_SCOPE, _LEVEL = "title is outside backend/platform/security/SRE scope", "level-IV/V role exceeds target seniority"
GATE_CASES = [  # title, description, location, department, url: reasons by the sample profile
    (1, "Backend Engineer", _OK, "Austin, TX", "", "u", ""), (2, "", _OK, "Austin, TX", "", "u", "title lacks a target engineering discipline"), (3, "Backend Engineer", _OK, "Austin, TX", "", "", "missing title or official source URL"),
    (4, "Junior Backend Engineer", _OK, "Austin, TX", "", "u", "new-grad/entry-level"), (5, "Backend Engineer, Senior Associate", _OK, "Austin, TX", "", "u", ""), (6, "Backend Engineer", _OK, "Austin, TX", "University Recruiting", "u", "new-grad/entry-level"),
    (7, "Backend Engineer Manager", _OK, "Austin, TX", "", "u", "people-management role"), (8, "Backend Engineer", _OK, "Austin, TX", "Mobile", "u", "department is outside backend/platform/security/SRE scope"), (9, "Backend Engineer", _OK, "Austin, TX", "Machine Learning Platform", "u", ""),
    (10, "Backend Engineer I", _OK, "Austin, TX", "", "u", "level-I/junior role"), (11, "Backend Engineer I/O", _OK, "Austin, TX", "", "u", ""), (12, "Backend Engineer IV", _OK, "Austin, TX", "", "u", _LEVEL), (13, "Software Engineer, Quantum Platform", _OK, "Austin, TX", "", "u", _SCOPE),
    (14, "Software Engineer, Verification Platform", _OK, "Austin, TX", "", "u", _SCOPE), (15, "Data Engineer, Streaming", "Run Kafka topics on AWS. Requires 3+ years of experience.", "Austin, TX", "", "u", "streaming data-engineer title lacks software-development evidence"), (16, "Data Engineer, Streaming", _OK, "Austin, TX", "", "u", ""),
    (17, "Backend Engineer", _OK + " Tune GPU kernels.", "Austin, TX", "", "u", "posting requires a specialist domain not established by the resume"), (18, "Backend Engineer", _OK + " Own full-stack features.", "Austin, TX", "", "u", "posting requires full-stack/frontend ownership"),
    (19, "Backend Engineer", _OK, "Location TBD or negotiable", "", "u", "US eligibility could not be verified from location"), (20, "Backend Engineer", "Java on AWS. Requires 1-2 years of experience.", "Austin, TX", "", "u", "experience range is explicitly junior (at most two years)"),
    (21, "Backend Engineer", "Java on AWS. Requires 1 year of experience.", "Austin, TX", "", "u", "experience floor is explicitly junior (one year or less)"), (22, "Senior Backend Engineer", "Java on AWS. Requires 5+ years of experience.", "Austin, TX", "", "u", "requires about 5+ years; Senior role exceeds configured experience ceiling"),
    (23, "Backend Engineer", _OK + " Must be a citizen of the United States.", "Austin, TX", "", "u", "citizenship/clearance-restricted or federal role"), (24, "Backend Engineer", _OK + " Security clearance is a plus.", "Austin, TX", "", "u", ""), (25, "Federal Backend Engineer", _OK, "Austin, TX", "", "u", "citizenship/clearance-restricted or federal role"),
    (26, "Backend Engineer", _OK + " Requires 3+ years building AI platforms.", "Austin, TX", "", "u", "requires 3+ years of AI/ML application infrastructure, beyond verified resume depth"), (27, "Backend Engineer", _OK + " No H-1B transfers.", "Austin, TX", "", "u", "posting explicitly rules out sponsorship; employer/role sponsorship confidence below threshold"),
]


@literal("id int, title string, description string, location string, department string, source_url string", GATE_CASES, 6, "id INTEGER, reasons VARCHAR")
def q_gate_cases(df: DataFrame) -> DataFrame:
    """G1, G3 to G5, G7 to G10, G14 to G16, G18, G19, G21, G22, G25, G26 with the sample profile, scores aside."""
    profile = sample_profile()
    profile["filters"] |= {"min_match_score": 0}
    rest = {c: F.lit("") for c in ("employment_type", "workplace_type", "raw", "default_country")}
    df = df.withColumns(rest).withColumns({"posted_at": F.lit(NOW), "confidence": F.lit("high"), "score": F.lit(0.8)})
    return ranking.evaluate(df, load_rules(profile), F.lit(NOW)).select("id", F.array_join("rejection_reasons", "; ").alias("reasons"))


_H = lambda *a: D(2024, 1, *a)
EVENTS = [  # id, mode, posted, prev, receipt, sent before, accepted, raw: event, emit, stale reason?
    (1, "initial", _H(19), None, None, False, True, "{}", "new", True, False), (2, "initial", _H(1), None, None, False, True, "{}", "new", False, True), (3, "incremental", _H(19), None, None, False, True, "{}", "new", True, False), (4, "incremental", _H(1), None, None, False, True, "{}", "new", False, True),
    (5, "incremental", _H(19, 13), _H(19), None, True, True, "{}", "reposted", True, False), (6, "incremental", _H(19, 11), _H(19), None, True, True, "{}", "reposted", False, False), (7, "incremental", _H(19), None, _H(18), False, True, "{}", "reposted", True, False), (8, "incremental", _H(19), _H(19), None, True, True, "{}", "seen", False, False),
    (9, "initial", _H(19, 13), _H(18), None, True, True, "{}", "reposted", False, False), (10, "incremental", _H(19), None, None, False, False, "{}", "new", False, False), (11, "incremental", _H(19), None, None, False, True, '{"canApply": false}', "new", False, False), (12, "incremental", None, None, None, False, True, "{}", "new", False, True),
]


@query(values("id INTEGER, event VARCHAR, emit BOOLEAN, stale BOOLEAN", [(e[0], *e[8:]) for e in EVENTS]))
def q_event_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth table of event decisions."""
    df = spark.createDataFrame([e[:8] for e in EVENTS], "id int, mode string, posted_at timestamp, prev timestamp, told timestamp, sent boolean, accepted boolean, raw string").withColumn("job_key", F.col("id").cast("string"))
    jobs = df.where("prev is not null").select("job_key", F.col("prev").alias("posted_at"), F.col("prev").alias("first_seen_at"), F.lit("h").alias("content_hash"))
    receipts = df.where("told is not null").select("job_key", F.col("told").alias("posted_at"))
    found = df.select("id", "mode", "posted_at", "accepted", "raw", "job_key").withColumns({"since": F.lit(D(2024, 1, 13, 12)), "posting_date_confidence": F.lit("high"), "content_hash": F.lit("h"), "rejection_reasons": F.array().cast("array<string>"), "seq": F.col("id")})
    out = history.decide_events(found, jobs, receipts, df.where("sent").select("job_key"), load_rules({}), F.lit(NOW))
    return out.select("id", "event", "emit", (F.size("rejection_reasons") > 0).alias("stale"))


CHECKS = [
    ("a", D(2024, 1, 10, 16), "2024-01-10-morning", True, 0, "No successful full crawl in the current window; running catch-up now."), ("b", D(2024, 1, 11, 16), "2024-01-11-morning", False, 1, "Current window already has a successful full crawl; no additional crawl needed."),
    ("c", D(2024, 1, 12, 16), "2024-01-12-morning", False, 1, "Previous crawl was incomplete; waiting for the one-hour recovery cooldown."), ("d", D(2024, 1, 12, 18), "2024-01-12-morning", True, 1, "No successful full crawl in the current window; running catch-up now."),
    ("e", D(2024, 1, 13, 20), "2024-01-13-morning", False, 3, "Retry limit reached for this window; source failures remain visible. Next window will retry."), ("f", D(2024, 7, 1, 14, 17), "2024-07-01-morning", True, 0, "No successful full crawl in the current window; running catch-up now."),
    ("g", D(2024, 7, 1, 14, 16), "2024-06-30-evening", True, 0, "No successful full crawl in the current window; running catch-up now."),
]
RUNS = [("r1", D(2024, 1, 11, 15, 30), D(2024, 1, 11, 15, 40), "success", 5, 5, 0), ("r2", D(2024, 1, 12, 15, 30), D(2024, 1, 12, 15, 40), "partial", 5, 4, 1), *[(f"s{k}", D(2024, 1, 13, 15 + k, 30), D(2024, 1, 13, 15 + k, 40), "partial", 5, 4, 1) for k in range(3)], ("t", D(2024, 1, 10, 15, 30), D(2024, 1, 10, 15, 40), "success", 2, 2, 0)]


@query(values("now TIMESTAMP, window_key VARCHAR, should_run BOOLEAN, attempts BIGINT, reason VARCHAR", [c[1:] for c in CHECKS]))
def q_schedule_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run is due, across daylight saving."""
    checks = spark.createDataFrame([(c[1], 5) for c in CHECKS], "now timestamp, expected int")
    runs = spark.createDataFrame(RUNS, "run_id string, started_at timestamp, finished_at timestamp, status string, companies_total int, companies_ok int, companies_failed int")
    return ledger.decide(checks, runs).select(F.col("now").cast("timestamp_ntz").alias("now"), "window_key", "should_run", "attempts", "reason")


OUTCOMES = [  # id, code, status, enabled, ok, failed, jobs?, matches, issues, complete, late: exit, kind, health
    (1, 0, "success", 5, 5, 0, True, 2, 0, True, 10, 0, "matches", "healthy"), (2, 2, "partial", 5, 4, 1, True, 2, 0, False, 10, 0, "source-warning", "needs attention"), (3, 2, "partial", 5, 0, 5, True, 0, 0, False, 10, 2, "source-warning", "needs attention"), (4, 1, "failed", 5, 0, 5, False, 0, 1, False, 100, 1, "failure", "needs attention"),
    (5, 0, "success", 5, 5, 0, True, 0, 0, False, 100, 0, "none", "overdue"), (6, 0, "success", 5, 5, 0, True, 0, 0, False, 10, 0, "none", "crawl due"),
]


@literal("id int, code int, status string, enabled int, ok int, failed int, jobs boolean, matches int, issues int, complete boolean, late int", OUTCOMES, 11, "id INTEGER, exit_code INTEGER, kind VARCHAR, health VARCHAR")
def q_outcomes(df: DataFrame) -> DataFrame:
    """A11, A12, A13."""
    c = F.col
    return df.select("id", ledger.workflow_exit(c("code"), c("status"), c("enabled"), c("ok"), c("failed"), c("jobs")).alias("exit_code"), ledger.alert_kind(c("status") == "failed", c("issues"), c("failed"), c("matches")).alias("kind"), ledger.status_health(c("issues"), c("status"), c("complete"), c("late")).alias("health"))


AGES = [(1, D(2024, 1, 20, 9), "3h old"), (2, D(2024, 1, 20, 11, 50), "1h old"), (3, D(2024, 1, 18), "2.5d old"), (4, None, "date unavailable"), (5, D(2024, 1, 21), "1h old")]


@literal("id int, posted timestamp", AGES, 2, "id INTEGER, age VARCHAR")
def q_age_text(df: DataFrame) -> DataFrame:
    """X9."""
    return df.select("id", text.age_text(F.col("posted"), F.lit(NOW)).alias("age"))


HTMLS = [
    (1, "<p>One</p><p>two &amp;amp; three</p>", "One two & three", ""), (2, "&lt;b&gt;bold&lt;/b&gt; text", "bold text", ""), (3, None, "", ""), (4, "a<!-- no -->b<script>x=1</script>", "a b x=1", ""),
    (5, '<script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": "A", "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX", "addressCountry": {"name": "US"}}}}]}</script>', '{"@graph": [{"@type": ["JobPosting"], "title": "A", "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX", "addressCountry": {"name": "US"}}}}]}', "Austin, TX, US"),
    (6, '<script type="application/ld+json">[{"@type": "jobposting", "jobLocationType": "telecommute"}]</script>', '[{"@type": "jobposting", "jobLocationType": "telecommute"}]', "Remote"), (7, '<script type="application/ld+json">{broken</script>', "{broken", ""),
]


@literal("id int, html string", HTMLS, 2, "id INTEGER, text VARCHAR, places VARCHAR")
def q_html_parse(df: DataFrame) -> DataFrame:
    """X2, X3, X4."""
    found = html.extract_jsonld(F.col("html"))
    df = df.select("id", html.strip_html(F.col("html")).alias("text"), F.explode_outer(found).alias("item"))
    return df.groupBy("id", "text").agg(F.coalesce(F.array_join(F.collect_list(html_place(F.col("item"))), " / "), F.lit("")).alias("places"))


def html_place(item):
    return F.nullif(html.jsonld_location(item), F.lit(""))


COUNTRIES = [(1, '{"country": "US"}', "US"), (2, '{"country": {"name": "US"}}', ""), (3, '{"location": {"country": {"name": "Germany"}}}', "Germany"), (4, '{"jobLocation": [{"address": {"addressCountry": "IN"}}, {"address": {"addressCountry": {"code": "US"}}}]}', "IN,US"), (5, '{"office": {"country": "FR"}}', ""), (6, "not json", ""), (7, None, "")]


@literal("id int, raw string", COUNTRIES, 2, "id INTEGER, countries VARCHAR")
def q_countries(df: DataFrame) -> DataFrame:
    """X17."""
    return df.select("id", F.array_join(html.explicit_countries(F.col("raw")), ",").alias("countries"))


TITLES_SEEN = [(1, "Software Engineer", True), (2, "Engineering Manager, Platform", False), (3, "Chef", False), (4, "Data Engineer, Streaming Telemetry", True), (5, "Principal Associate, Cloud", True), (6, "Staff Software Engineer", False), (7, "", False), (8, None, None)]


@literal("id int, title string", TITLES_SEEN, 2, "id INTEGER, likely BOOLEAN")
def q_likely_title(df: DataFrame) -> DataFrame:
    """F1."""
    return df.select("id", ranking.likely_detail(F.col("title"), load_rules({})).alias("likely"))


LINKS = [(1, "https://h.example/a?b=c", "https://h.example/a?b=c", "https://h.example/a?b=c"), (2, "javascript:alert(1)", "", "javascript:alert(1)"), (3, "http://u:p@h.example/", "", "https://u:p@h.example/"), (4, "http://h.example", "http://h.example", "https://h.example"), (5, None, "", None), (6, "ftp://h.example", "", "ftp://h.example")]


@literal("id int, url string", LINKS, 2, "id INTEGER, safe VARCHAR, https VARCHAR")
def q_safe_url(df: DataFrame) -> DataFrame:
    """X19, X23."""
    return df.select("id", text.safe_url(F.col("url")).alias("safe"), text.https_url(F.col("url")).alias("https"))


MARKED = [(1, "a [b](c)\n*d*", "a \\[b\\]\\(c\\) \\*d\\*"), (2, None, ""), (3, "x" * 300, "x" * 199 + "…"), (4, "plain text", "plain text")]


@literal("id int, value string", MARKED, 2, "id INTEGER, line VARCHAR")
def q_markdown_text(df: DataFrame) -> DataFrame:
    """X19."""
    return df.select("id", text.markdown_text(F.col("value")).alias("line"))


TENANTS = [(1, "https://acme.wd5.myworkdayjobs.com/en-US/Careers", "acme.wd5.myworkdayjobs.com", "acme", "Careers"), (2, "acme:wd1:Jobs", "acme.wd1.myworkdayjobs.com", "acme", "Jobs"), (3, "acme", None, None, None), (4, "", None, None, None)]


@literal("id int, value string", TENANTS, 2, "id INTEGER, host VARCHAR, tenant VARCHAR, site VARCHAR")
def q_tenant_parts(df: DataFrame) -> DataFrame:
    """X13."""
    p = text.tenant_parts(F.col("value"))
    return df.select("id", p["host"].alias("host"), p["tenant"].alias("tenant"), p["site"].alias("site"))


@query("SELECT event_id, timezone('America/Los_Angeles', timezone('UTC', ts)) AS local FROM events")
def q_local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20."""
    return table(spark, sf_dir, "events").select("event_id", text.local_time(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("local"))


@query("SELECT user_id, sha256('[' || string_agg('\"' || event_type || '\"', ',' ORDER BY ts, event_id) || ']') AS print FROM events GROUP BY user_id")
def q_page_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's paths, in order, as one digest."""
    e = table(spark, sf_dir, "events")
    paths = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return e.groupBy("user_id").agg(paths.alias("paths")).select("user_id", text.page_fingerprint(F.col("paths")).alias("print"))


@query("SELECT max(o_orderdate) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS usable, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS success FROM orders")
def q_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, O5."""
    runs = _orders(spark, sf_dir)[1]
    a, b = history.latest_run(runs), history.latest_run(runs, ("success",))
    both = a.select(F.lit(1).alias("k"), F.col("started_at").alias("usable")).join(b.select(F.lit(1).alias("k"), F.col("started_at").alias("success")), "k")
    return both.drop("k")


@query("SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, o_orderdate AS started_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def q_run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 runs."""
    return files.run_history(_orders(spark, sf_dir)[1])


HEALTH = [("a", True, "ok"), ("b", False, "skipped"), ("c", True, "error"), ("d", True, "skipped"), ("e", True, "degraded")]


@query(values("company VARCHAR, status VARCHAR", [("c", "error"), ("d", "skipped"), ("e", "degraded")]))
def q_health_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13."""
    return ledger.failures(spark.createDataFrame(HEALTH, "company string, enabled boolean, status string")).select("company", "status")


ASKED = [
    (1, "https://bücher.example/über uns?q=straße&x=%20#é", "https://xn--bcher-kva.example/%C3%BCber%20uns?q=stra%C3%9Fe&x=%20#%C3%A9"), (2, "https://h.example:8443/a%2Fb", "https://h.example:8443/a%2Fb"), (3, "http://u@h.example/", "http://u@h.example/"), (4, None, None), (5, "https://" + "x" * 70 + ".example/", None),
]


@literal("id int, url string", ASKED, 2, "id INTEGER, request VARCHAR")
def q_request_url(df: DataFrame) -> DataFrame:
    """X22."""
    return df.select("id", text.request_url(F.col("url")).alias("request"))


_ROW = {"company": "A,B", "title": 'The "x"', "location": "é", "apply_priority": "P0", "source_url": "https://h/1", "apply_url": "", "age": "today", "posting_date_kind": "k", "posting_date_confidence": "high", "match_score": 81.25, "why_matches": "w", "sponsorship_confidence": "high", "sponsorship_score": 0.8, "role_sponsorship_signal": "not_stated", "sponsorship_evidence": "<s>", "event_type": "new", "job_key": "j"}
_META = {"run_id": "r1", "mode": "initial", "started_at": "t", "emitted_jobs": 1}
FILES = [
    ("csv", 'company,title,location,posted_at,source_url,match_score,sponsorship_score,rejection_reasons,source,source_job_id\r\n"A,B","The ""x""",é,,https://h/1,81.25,0.8,,,\r\n'),
    ("json", json.dumps({"metadata": _META, "jobs": [_ROW]}, indent=2, ensure_ascii=False) + "\n"),
    ("json, none", json.dumps({"metadata": _META, "jobs": []}, indent=2, ensure_ascii=False) + "\n"),
    ("markdown", '# T\n\nRun `r1`, mode **initial**, started t: **1** new or reposted.\n\n## P0 - Apply immediately\n\n### [A,B - The "x"](https://h/1)\n\n- **Location:** é\n- **Freshness:** today (k, high)\n- **Match:** 81.2/100 - w\n- **Sponsorship:** high (0.80); not_stated\n- **Apply:** https://h/1\n'),
    ("html", '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>T</title></head><body><h1>T</h1><p>initial run, 1 emitted</p><section class="p0"><h2><a href="https://h/1">The &quot;x&quot;</a></h2><p>P0 · A,B · é · today · new</p><p>Match 81.2 · Sponsorship 0.80</p><p>w</p><p>&lt;s&gt;</p><a href="https://h/1">Apply</a></section></body></html>'),
]


@query(values("name VARCHAR, body VARCHAR", FILES))
def q_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 to K5: the files of a report, row by row."""
    made = {
        "csv": reports.csv_lines([_ROW], reports.REJECTION_COLUMNS), "json": reports.json_parts(_META, [_ROW]), "json, none": reports.json_parts(_META, []),
        "markdown": reports.markdown_parts("T", _META, [_ROW]), "html": reports.html_parts("T", _META, [_ROW]),
    }
    return spark.createDataFrame([(k, "".join(v)) for k, v in made.items()], "name string, body string")


FETCHED = [("u", "e1", D(2024, 1, 1), 200, "one"), ("u", None, D(2024, 1, 2), 304, ""), ("v", "e2", D(2024, 1, 1), 200, "two"), ("v", "e3", D(2024, 1, 3), 200, "three"), ("w", None, D(2024, 1, 1), 404, "gone")]


@query(values("url VARCHAR, etag VARCHAR, status INTEGER, body VARCHAR", [("u", "e1", 200, "one"), ("v", "e3", 200, "three"), ("w", None, 404, "gone")]))
def q_newest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest response per URL, a 304 keeping the body before it."""
    df = spark.createDataFrame(FETCHED, "url string, etag string, fetched_at timestamp, status int, body string").withColumn("last_modified", F.lit(None).cast("string"))
    return files.newest_pages(df).select("url", "etag", "status", F.col("body").cast("string").alias("body"))


LOG = [(0, "ERROR one"), (1, "fine"), (2, "fatal: two"), (3, "fine")]


@query(values("last_error VARCHAR", [("fatal: two",)]))
def q_last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14."""
    return reports.last_error(spark.createDataFrame(LOG, "lineno int, value string"))


BATCH_A = [("Acme", "manual", "", "High", "120 Certified H-1B LCA; 30 had software", "b;a"), ("Solo", "greenhouse", "https://boards.example/solo", "", "", "")]
BATCH_B = [("ACME", "lever", "acme", "low", "9", "c;a"), ("Beta", "workday", "t:wd1:site", "medium high", "5", "")]


@query(values("id VARCHAR, enabled BOOLEAN, connector_type VARCHAR, batch VARCHAR, score DOUBLE, certified INTEGER, fit_tags VARCHAR, monitor_status VARCHAR", [
    ("acme", True, "lever", "A+B", 0.82, 120, "a,b,c", "enabled-documented-public-api"), ("beta", False, "workday", "B", 0.72, 5, "", "disabled-pending-tenant-review"), ("solo", False, "greenhouse", "A", 0.3, None, "", "disabled-by-user")]))
def q_universe_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two research batches to one company table."""
    a = spark.createDataFrame(BATCH_A, "canonical_name string, ats_type string, ats_identifier_or_base_url string, sponsorship_confidence string, evidence_summary string, role_fit_tags string")
    b = spark.createDataFrame(BATCH_B, "canonical_name string, ats_type string, `ats_identifier/base_url` string, sponsorship_confidence string, fy2025_q4_certified_records string, role_fit_tags string")
    out = universe.build(a, b, excluded=["Solo"])
    return out.select("id", "enabled", "connector_type", "batch", "score", "certified", F.array_join("fit_tags", ",").alias("fit_tags"), "monitor_status")


@query(
    """WITH w AS (SELECT CAST(user_id AS VARCHAR) || '|' || event_type AS job_key, ts AS posted_at, max(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM events)
SELECT *, CASE WHEN watermark IS NULL THEN 'new' WHEN posted_at > watermark + INTERVAL 12 HOUR THEN 'reposted' ELSE 'seen' END AS event FROM w"""
)
def q_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same classification as a stream with a watermark per key as state, read until the input is used up."""
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    # By a pattern, as a stream's path is a folder otherwise: the table may be one file or a folder of many.
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    keyed = stream.select(F.concat_ws("|", "user_id", "event_type").alias("job_key"), F.col("ts").cast("timestamp").alias("posted_at"))
    events = streams.classify(keyed)
    streams.to_table(events, f"{base}/checkpoint", f"{base}/table")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.schema(events.schema).parquet(f"{base}/table").select("job_key", ntz("posted_at"), ntz("watermark"), "event")


# --- feeds --------------------------------------------------------------------------------------------------------------------

_J = json.dumps
_LD = lambda **k: '<script type="application/ld+json">' + _J({"@type": "JobPosting", **k}) + "</script>"
_MAP = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'
_INDEX = '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://s.example/jobs.xml</loc></sitemap></sitemapindex>'
#: Per source: connector, payload rows (kind, key, page, status, body), and the expected (id, title, location, posted, kind) rows.
FEEDS: dict[str, tuple[dict, list[tuple], list[tuple]]] = {
    "greenhouse": (
        {"max_detail_requests": 1},
        [("list", "u", 0, 200, _J({"jobs": [{"id": 1, "internal_job_id": 5, "title": "Platform Engineer", "first_published": "2024-01-18", "updated_at": "2024-01-19", "location": {"name": "Austin, TX"}, "absolute_url": "https://h/1", "content": "&lt;p&gt;x&lt;/p&gt;"}, {"id": 2, "internal_job_id": None, "title": "Platform prospects", "first_published": "2024-01-18"}, {"id": 3, "internal_job_id": 7, "title": "Software Engineer", "location": {"name": "Reno, NV"}}, {"id": 4, "internal_job_id": 8, "title": "Cloud Engineer"}], "meta": {"total": 4}})), ("detail", "3", 0, 200, _J({"first_published": "2024-01-17", "content": "y"}))],
        [("1", "Platform Engineer", "Austin, TX", D(2024, 1, 18), "first_published"), ("3", "Software Engineer", "Reno, NV", D(2024, 1, 17), "first_published")],
    ),
    "lever": (
        {},
        [("list", "u", 0, 200, _J([{"id": "a", "text": "Platform Engineer", "createdAt": 1705536000000, "hostedUrl": "https://h/a", "categories": {"location": "Austin, TX"}}, {"id": "b", "text": "Cook", "createdAt": 1705536000000, "hostedUrl": "https://h/b", "categories": {"allLocations": ["Reno", "Elko"]}}, {"id": "a", "text": "again", "hostedUrl": "https://h/c"}, {"id": "d", "text": "Cloud Engineer", "createdAt": 1705536000000, "hostedUrl": "https://h/d", "categories": {}}])), ("page", "https://h/a", 0, 200, _LD(datePosted="2024-01-18")), ("page", "https://h/d", 0, 200, _LD(datePosted="2023-01-01"))],
        [("a", "Platform Engineer", "Austin, TX", D(2024, 1, 18), "jsonld_datePosted"), ("b", "Cook", "Reno | Elko", D(2024, 1, 18), "lever_createdAt_unverified")],
    ),
    "ashby": (
        {},
        [("list", "u", 0, 200, _J({"apiVersion": "1", "jobs": [{"title": "A", "location": "Austin", "address": {"postalAddress": {"addressLocality": "Austin", "addressRegion": "TX"}}, "secondaryLocations": [{"location": "Reno", "address": {"postalAddress": {"addressCountry": "US"}}}], "publishedAt": "2024-01-18T00:00:00Z", "jobUrl": "https://h/board/x-1/", "isListed": True}, {"title": "B", "isListed": False, "jobUrl": "https://h/board/x-2"}]}))],
        [("x-1", "A", "Austin | Austin, TX | Reno | US", D(2024, 1, 18), "last_published")],
    ),
    "smartrecruiters": (
        {"access_policy": "documented_public_api"},
        [("list", "u", 0, 200, _J({"totalFound": 2, "content": [{"id": "1", "name": "Platform Engineer", "releasedDate": "2024-01-18", "location": {"city": "Austin", "region": "TX", "remote": True}}, {"id": "2", "name": "Cook", "releasedDate": "2024-01-18", "location": {"fullLocation": "Reno, NV"}}]})), ("detail", "1", 0, 200, _J({"name": "Platform Engineer II", "jobAd": {"sections": {"jobDescription": {"text": "<p>d</p>"}}}}))],
        [("1", "Platform Engineer II", "Remote | Austin, TX", D(2024, 1, 18), "releasedDate"), ("2", "Cook", "Reno, NV", D(2024, 1, 18), "releasedDate")],
    ),
    "workday": (
        {"access_approved": True, "host": "t.example", "tenant": "t", "site": "s"},
        [("list", "u", 0, 200, _J({"total": 3, "jobPostings": [{"title": "Platform Engineer", "externalPath": "/p/1", "postedOn": "Posted 2 Days Ago", "locationsText": "Austin, TX"}, {"title": "Cloud Engineer", "externalPath": "/p/2", "postedOn": "Posted Today"}, {"title": "Cook", "externalPath": "/p/3", "postedOn": "Posted Today"}]})), ("detail", "/p/1", 0, 200, _J({"jobPostingInfo": {"id": "w1", "title": "Platform Engineer", "startDate": "2024-01-17", "location": "Austin", "additionalLocations": [{"descriptor": "Reno"}]}})), ("detail", "/p/2", 0, 200, _J({"jobPostingInfo": {"id": "w2", "canApply": False}}))],
        [("w1", "Platform Engineer", "Austin | Austin, TX | Reno", D(2024, 1, 17), "posting_start_date")],
    ),
    "amazon": (
        {"endpoint": "https://jobs.example/search.json"},
        [("list", "k1", 0, 200, _J({"jobs": [{"id": "1", "title": "Old", "posted_date": "January 18, 2024", "job_path": "/j/1", "location": "Austin"}, {"id": "2", "title": "Boss", "is_manager": True}]})), ("list", "k2", 1, 200, _J({"jobs": [{"id": "1", "title": "New", "posted_date": "January 18, 2024", "job_path": "/j/1", "locations": ['{"normalizedLocation": "Austin, TX"}']}, {"id": "3", "title": "Far", "country_code": "CAN"}]}))],
        [("1", "New", "Austin, TX", D(2024, 1, 18), "posted_date")],
    ),
    "sitemap": (
        {"sitemap_url": "https://s.example/index.xml", "url_exclude_regex": "intern", "max_detail_requests": 2, "hiring_organization_aliases": ["Acme Cloud"]},
        [("sitemap", "https://s.example/index.xml", 0, 200, _INDEX), ("sitemap", "https://s.example/jobs.xml", 0, 200, _MAP.format("".join(f"<url><loc>https://s.example/jobs/{n}</loc><lastmod>{d}</lastmod></url>" for n, d in (("a", "2024-01-19"), ("b", "2024-01-18"), ("c", "2024-01-17"), ("old", "2023-01-01"), ("intern", "2024-01-19"))))), ("page", "https://s.example/jobs/a", 0, 200, _LD(title="A", datePosted="2024-01-19", identifier={"value": "ia"}, hiringOrganization={"name": "ACME CLOUD"}, jobLocationType="TELECOMMUTE")), ("page", "https://s.example/jobs/b", 0, 200, _LD(title="B", hiringOrganization={"name": "Other"}))],
        [("ia", "A", "Remote", D(2024, 1, 19), "jsonld_datePosted")],
    ),
    "jsonld_pages": (
        {"urls": ["https://s.example/1", "https://s.example/2"]},
        [("page", "https://s.example/1", 0, 200, _LD(name="N", datePosted="2024-01-18")), ("page", "https://s.example/2", 0, 404, "")],
        [("https://s.example/1", "N", "", D(2024, 1, 18), "jsonld_datePosted")],
    ),
}


def scan_feed(spark: SparkSession, name: str, mode: str = "initial", known: Sequence[tuple] = ()):
    """A feed's literal payloads through its normalizer."""
    connector, rows, _ = FEEDS[name]
    payloads = spark.createDataFrame([("co", *r) for r in rows], PAYLOAD)
    companies = spark.createDataFrame([("co", "Zenith", json.dumps({"type": name, **connector}), "US", D(2024, 1, 13), mode)], "id string, name string, connector string, default_country string, since timestamp, mode string")
    stored = spark.createDataFrame(list(known), "company_id string, source_url string, posted_at timestamp, last_seen_at timestamp")
    return normalizer(name)(Request(payloads, companies, stored, load_rules({}), F.lit(NOW)))


def _feed_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = scan_feed(spark, name).postings
        return p.select("source_job_id", "title", "location", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "posting_date_kind")

    QUERIES[f"q_source_{name}"] = run
    SQL[f"q_source_{name}"] = values("source_job_id VARCHAR, title VARCHAR, location VARCHAR, posted_at TIMESTAMP, posting_date_kind VARCHAR", FEEDS[name][2])


for _name in FEEDS:
    _feed_query(_name)
