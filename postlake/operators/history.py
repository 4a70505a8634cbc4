"""Change detection against history: keys, cursors, watermarks, events, and their replay over many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, job_key, parse_datetime
from ..rules import RuleSet
from ..schema import USABLE_RUN

# How much later a date must be to count as a repost, and how far ahead of now a posting may be dated.
REPOST_AFTER, FUTURE = "interval 12 hours", "interval 24 hours"
STALE = {"initial": "not a verified posting from the initial 7-day window", "incremental": "newly discovered, but posting date is stale or unverified"}


def usable(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*USABLE_RUN)


def keyed(postings: DataFrame) -> DataFrame:
    """postings with job_key and content_hash."""
    c = F.col
    key = job_key(c("company_id"), c("source_job_id"), c("source_url"), c("title"), c("location"))
    return postings.withColumn("job_key", key).withColumn("content_hash", content_hash([c("title"), c("location"), c("description"), c("source_url")]))


def latest_run(runs: DataFrame, statuses: Sequence[str] = USABLE_RUN) -> DataFrame:
    """One row: started_at of the newest run with such a status (null: none)."""
    return runs.where(F.col("status").isin(*statuses)).agg(F.max("started_at").alias("started_at"))


def cursors(company_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """(company_id, source, last_ok): start of the newest usable run in which the source completed."""
    ok = company_runs.where("status = 'ok'").join(runs.where(usable()).select("run_id", "started_at"), "run_id")
    return ok.groupBy("company_id", "source").agg(F.max("started_at").alias("last_ok"))


def plan_sources(companies: DataFrame, cursor: DataFrame, fingerprints: DataFrame, rules: RuleSet, mode: str, now: Column) -> DataFrame:
    """companies with mode, since and backfill per company.

    A company is initial when the run is, when it never completed, or when the rules changed since it last did (a backfill).
    """
    c = companies.join(cursor, (companies["id"] == cursor["company_id"]) & (companies["connector_type"] == cursor["source"]), "left").drop("company_id", "source")
    f = fingerprints.select(F.col("company_id").alias("_cid"), F.col("source").alias("_src"), "profile_fingerprint")
    c = c.join(f, (c["id"] == f["_cid"]) & (c["connector_type"] == f["_src"]), "left").drop("_cid", "_src")
    changed = ~F.col("profile_fingerprint").eqNullSafe(F.lit(rules.fingerprint))
    first = F.lit(mode == "initial") | F.col("last_ok").isNull() | changed
    since = F.when(first, now - F.make_dt_interval(days=F.lit(rules.lookback_days))).otherwise(F.col("last_ok") - F.make_dt_interval(mins=F.lit(int(rules.overlap_hours * 60))))
    return c.withColumn("mode", F.when(first, "initial").otherwise("incremental")).withColumn("since", since).withColumn("backfill", changed).drop("profile_fingerprint", "last_ok")


def delivered(sightings: DataFrame, runs: DataFrame) -> DataFrame:
    """job_keys that a usable run emitted."""
    return sightings.where("emitted").join(runs.where(usable()).select("run_id"), "run_id", "left_semi").select("job_key").distinct()


def open_for_application(raw: Column, now: Column) -> Column:
    """False where a deadline's date is before now's, or the payload says that it is closed or unlisted."""
    at = lambda k: F.get_json_object(raw, f"$.{k}")
    past = [F.coalesce(F.to_date(parse_datetime(at(k), now)) < F.to_date(now), F.lit(False)) for k in ("validThrough", "application_deadline", "PostingEndDate")]
    shut = [F.coalesce(at(k) == "false", F.lit(False)) for k in ("canApply", "isListed")]
    out = F.lit(True)
    for bad in past + shut:
        out = out & ~bad
    return out


def date_verified(posted: Column, confidence: Column, rules: RuleSet) -> Column:
    return posted.isNotNull() & F.coalesce(confidence.isin(*rules.date_confidence), F.lit(False))


def in_window(posted: Column, since: Column, now: Column) -> Column:
    return posted.between(since, now + F.expr(FUTURE))


def decide_events(found: DataFrame, jobs: DataFrame, receipts: DataFrame, emitted_before: DataFrame, rules: RuleSet, now: Column) -> DataFrame:
    """Add what history says about each evaluated posting.

    found: keyed, evaluated, with mode and since. Adds event (provisional), stored_event (for the sighting), fresh,
    emit, discovered_at, and the stale reason to rejection_reasons. Of rows with one key, only the first (by seq) is emitted.
    All four lookups are equi-joins on job_key; the three small-key sides hold one row per key.
    """
    prev = jobs.select("job_key", F.col("posted_at").alias("_prev_posted"), F.col("first_seen_at").alias("_first_seen"), F.col("content_hash").alias("_prev_hash"), F.lit(True).alias("_known"))
    told = receipts.select("job_key", F.col("posted_at").alias("_told"))
    sent = emitted_before.select("job_key", F.lit(True).alias("_sent"))
    df = found.join(prev, "job_key", "left").join(told, "job_key", "left").join(sent, "job_key", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    posted = F.col("posted_at")
    before = F.greatest("_prev_posted", "_told")
    done = yes("_sent") | F.col("_told").isNotNull()
    sure = date_verified(posted, F.col("posting_date_confidence"), rules)
    new_window = sure & in_window(posted, F.col("since"), now)
    initial = F.col("mode") == "initial"
    undated = F.lit(rules.allow_undated) & posted.isNull()
    repost = ~initial & done & sure & F.coalesce((posted > before + F.expr(REPOST_AFTER)) & (posted >= F.col("since")), F.lit(False))
    fresh = F.when(initial, new_window).when(~done, new_window | undated).otherwise(repost)
    event = F.when(repost, "reposted").when(done, "seen").otherwise("new")
    stale = F.when(initial & ~new_window, STALE["initial"]).when(~initial & ~done & ~(new_window | undated), STALE["incremental"])
    stored = F.when(~yes("_known"), "new").when(F.coalesce(posted > F.col("_prev_posted"), F.lit(False)), "reposted").when(F.col("content_hash") != F.col("_prev_hash"), "updated").otherwise("seen")
    df = df.withColumn("fresh", F.coalesce(fresh, F.lit(False))).withColumn("provisional", event).withColumn("stored_event", stored)
    df = df.withColumn("event", F.when(F.col("provisional") == "seen", F.col("stored_event")).otherwise(F.col("provisional")))
    df = df.withColumn("rejection_reasons", F.concat("rejection_reasons", F.array_compact(F.array(stale)))).withColumn("discovered_at", F.coalesce("_first_seen", now))
    can = F.col("accepted") & F.col("fresh") & open_for_application(F.col("raw"), now) & F.col("provisional").isin("new", "reposted")
    first = F.row_number().over(Window.partitionBy("job_key").orderBy(F.when(F.col("_can"), 0).otherwise(1), "seq"))
    df = df.withColumn("_can", can).withColumn("emit", F.col("_can") & (first == 1))
    return df.drop("_prev_posted", "_first_seen", "_prev_hash", "_known", "_told", "_sent", "_can", "provisional")


def replay(sightings: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """Which sightings of a whole history are emitted, without going run by run.

    sightings: run_id, run_at, usable, mode, since, job_key, posted_at, verified, accepted, open (one row per run and key).
    Adds watermark, delivered, event and emitted. Before a key's first emission only "new" can fire, after it only
    "reposted", and the watermark does not depend on what was emitted; so the first emission is one windowed minimum,
    and the rest is a comparison with the watermark: two passes over one partitioning by key.
    """
    w = Window.partitionBy("job_key").orderBy("run_at", "run_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(w) == 1
    df = sightings
    if receipts is not None:
        df = df.join(receipts.select("job_key", F.col("posted_at").alias("_told")), "job_key", "left")
    else:
        df = df.withColumn("_told", F.lit(None).cast("timestamp"))
    counted = F.when(F.col("usable") | first, F.col("posted_at"))
    df = df.withColumn("_counted", counted)
    df = df.withColumn("watermark", F.greatest(F.max("_counted").over(before), F.col("_told")))
    initial = F.col("mode") == "initial"
    window = F.coalesce(F.col("verified") & in_window(F.col("posted_at"), F.col("since"), F.col("run_at")), F.lit(False))
    could = F.col("usable") & F.col("accepted") & F.col("open") & window
    start = F.when(could, F.struct("run_at", "run_id"))
    df = df.withColumn("_start", F.min(start).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    here = F.struct("run_at", "run_id")
    df = df.withColumn("delivered", F.col("_told").isNotNull() | F.coalesce(F.col("_start") < here, F.lit(False)))
    repost = ~initial & F.col("delivered") & F.coalesce(F.col("verified") & (F.col("posted_at") > F.col("watermark") + F.expr(REPOST_AFTER)) & (F.col("posted_at") >= F.col("since")), F.lit(False))
    df = df.withColumn("event", F.when(repost, "reposted").when(F.col("delivered"), "seen").otherwise("new"))
    return df.withColumn("emitted", F.col("usable") & F.col("accepted") & F.col("open") & F.when(F.col("delivered"), repost).otherwise(window)).drop("_told", "_counted", "_start")


def merge_jobs(jobs: DataFrame, found: DataFrame, now: Column, promote: bool) -> DataFrame:
    """The next version of jobs: stored rows joined in full with this run's (keyed, decided) rows.

    A new key takes the sighting's date; a known one keeps its date unless promote, when the later date wins (runs that
    deliver). first_seen_at stays, last_seen_at moves, text and hash are replaced.
    """
    w = Window.partitionBy("job_key").orderBy(F.desc("seq"))
    last = found.withColumn("_rn", F.row_number().over(w)).withColumn("_emit", F.max("emit").over(Window.partitionBy("job_key"))).where("_rn = 1")
    n = last.select("job_key", *[F.col(c).alias(f"n_{c}") for c in ("company_id", "source_job_id", "source_url", "title", "location", "posted_at", "content_hash")], F.col("_emit").alias("n_emit"))
    df = jobs.join(n, "job_key", "full_outer")
    seen, known = F.col("n_company_id").isNotNull(), F.col("first_seen_at").isNotNull()
    new = lambda c: F.when(seen, F.col(f"n_{c}")).otherwise(F.col(c))
    date = F.when(~known, F.col("n_posted_at")).otherwise(F.greatest("posted_at", "n_posted_at") if promote else F.col("posted_at"))
    sent = F.when(F.lit(promote) & F.coalesce("n_emit", F.lit(False)), now).otherwise(F.col("last_emitted_at"))
    return df.select(
        "job_key", new("company_id").alias("company_id"), new("source_job_id").alias("source_job_id"), new("source_url").alias("source_url"), new("title").alias("title"), new("location").alias("location"),
        date.alias("posted_at"), F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), sent.alias("last_emitted_at"),
        new("content_hash").alias("content_hash"), F.when(seen, True).otherwise(F.col("active")).alias("active"),
    )


def merge_receipts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One receipt per key; a later posting date replaces an earlier one."""
    w = Window.partitionBy("job_key").orderBy(F.desc("posted_at"), "_new")
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.select(*stored.columns).withColumn("_new", F.lit(1)))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def bad_receipts(incoming: DataFrame) -> DataFrame:
    """Receipts whose key is no sha256 in hex or whose date is missing; any row here voids the whole import."""
    return incoming.where(~F.coalesce(F.col("job_key").rlike(r"^[a-f0-9]{64}\z"), F.lit(False)) | F.col("posted_at").isNull())


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of incoming, and of stored those whose key is not among them."""
    return stored.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming.select(*stored.columns))


def deactivate_missing(jobs: DataFrame, sightings: DataFrame, company_ids: Sequence[str]) -> DataFrame:
    """jobs with active false where a complete snapshot of their company did not show them."""
    seen = sightings.select("job_key", F.lit(True).alias("_seen")).distinct()
    gone = F.col("company_id").isin(*company_ids) & F.col("_seen").isNull()
    return jobs.join(seen, "job_key", "left").withColumn("active", F.when(gone, False).otherwise(F.col("active"))).drop("_seen")


def first_last_seen(sightings: DataFrame, key: str = "job_key", at: str = "seen_at") -> DataFrame:
    return sightings.groupBy(key).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))


def top_rejections(rejected: DataFrame, limit: int, *order: str) -> DataFrame:
    """At most limit rows per company, in order."""
    w = Window.partitionBy("company_id").orderBy(*(order or ("seq", "job_key")))
    return rejected.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def has_seen(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (job_key) with seen: whether the store knows them."""
    return keys.join(jobs.select("job_key", F.lit(True).alias("seen")).distinct(), "job_key", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
