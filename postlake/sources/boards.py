"""Normalizers of JSON boards: payload rows to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.html import extract_jsonld, strip_html
from ..functions.text import parse_epoch, path_of
from ..operators.ranking import likely_detail
from .base import Request, Scan, date, dated, details, first_of, items, joined, joined_array, number, option, overlay, posting, register, results, say, text, within

DAY = "interval 1 day"


def _lists(r: Request, path: str | None) -> DataFrame:
    ok = r.payloads.where("kind = 'list' and status = 200").select("company_id", "page", "body")
    return items(ok.join(F.broadcast(r.companies.withColumnRenamed("id", "company_id")), "company_id"), path)


def _labels(array_path: str, field: str, of: str = "item") -> Column:
    return F.transform(F.from_json(F.get_json_object(of, array_path), "array<string>"), lambda x: F.coalesce(F.get_json_object(x, f"$.{field}"), F.lit("")))


def _objects(path: str, of: str = "item") -> Column:
    return F.coalesce(F.from_json(F.get_json_object(of, path), "array<string>"), F.array().cast("array<string>"))


@register("greenhouse")
def greenhouse(r: Request) -> Scan:
    """A bulk list; the first publication date only. Likely titles without a date or a text take their detail's, within a budget."""
    every = _lists(r, "jobs")
    prospect = F.get_json_object("item", "$.internal_job_id").isNull() & option("exclude_prospect_posts", "boolean", True)
    listed = every.where(~prospect).withColumn("key", text("$.id")).withColumn("title", text("$.title"))
    lacks = date(F.get_json_object("item", "$.first_published"), r.now).isNull() | (text("$.content") == "")
    taken, over = within(option("max_detail_requests", "int", 80), [F.col("seq")], likely_detail(F.col("title"), r.rules) & lacks)
    df = listed.withColumn("over", over).withColumn("taken", taken).join(details(r.payloads), ["company_id", "key"], "left")
    df = df.withColumn("failed", F.col("taken") & ~F.coalesce(F.col("detail_status") == 200, F.lit(False)))
    df = df.withColumn("both", overlay("item", F.when(F.col("taken") & ~F.col("failed"), F.col("detail"))))
    posted = F.coalesce(date(F.get_json_object("both", "$.first_published"), r.now), date(F.get_json_object("item", "$.first_published"), r.now))
    t = lambda p: text(p, "both")
    out = posting(
        df.where("not over and not failed"), "greenhouse", source_job_id=t("$.id"), title=t("$.title"), location=t("$.location.name"), description=strip_html(t("$.content")),
        source_url=t("$.absolute_url"), apply_url=t("$.absolute_url"), department=joined_array(_labels("$.departments", "name", "both")), raw=F.col("both"), **dated(posted, "first_published"),
    )
    n = df.groupBy("company_id").agg(F.count_if("failed").alias("failures"), F.count_if("over").alias("skips"))
    lists = r.payloads.where("kind = 'list'")
    total = lists.groupBy("company_id").agg(F.max(F.get_json_object("body", "$.meta.total").try_cast("int")).alias("total"), F.sum(F.coalesce(F.size(F.from_json("body", "struct<jobs:array<string>>")["jobs"]), F.lit(0))).alias("returned"))
    n = total.join(n, "company_id", "left").withColumn("differs", F.coalesce(F.col("total") != F.col("returned"), F.lit(False)))
    bad, skips = F.coalesce("failures", F.lit(0)) > 0, F.coalesce("skips", F.lit(0)) > 0
    warning = say((F.col("differs"), "The stated total differs from the number of jobs returned."), (bad, number("failures", "Left ", " failed detail candidate(s) unseen for retry.")), (skips, number("skips", "Left ", " candidate(s) unseen after the detail budget was exhausted.")))
    return Scan(out, results(r, "greenhouse", out, n, warning, ~(F.col("differs") | bad | skips)))


@register("lever")
def lever(r: Request) -> Scan:
    """Pages of postings, first of an id wins. Creation dates are no posting dates: likely recent or known postings are checked against the date on their page, and withheld unless it agrees or is a later repost."""
    every = _lists(r, None).withColumn("key", text("$.id")).where("key != ''")
    df = first_of(every, ["company_id", "key"], F.col("seq"))
    created = date(F.get_json_object("item", "$.createdAt"), r.now)
    epoch = F.get_json_object("item", "$.createdAt").try_cast("double")
    df = df.withColumn("created", F.coalesce(parse_epoch(epoch), created)).withColumn("url", text("$.hostedUrl")).withColumn("title", text("$.text"))
    known = first_of(r.known.select("company_id", F.col("source_url").alias("url"), F.col("posted_at").alias("prev_posted"), F.col("last_seen_at").alias("prev_seen")), ["company_id", "url"], F.desc("prev_seen"))
    df = df.join(known, ["company_id", "url"], "left")
    was = F.col("prev_seen").isNotNull() & (F.col("mode") == "incremental") & (F.col("url") != "")
    df = df.withColumn("was", was).withColumn("prev_posted", F.when(F.col("was"), F.col("prev_posted")))
    recent = F.col("created").isNull() | (F.col("created") >= F.col("since") - F.expr("interval 2 days"))
    df = df.withColumn("recent", recent).withColumn("checks", likely_detail(F.col("title"), r.rules) & (F.col("recent") | F.col("was")))
    order = [F.when(F.col("recent") | ~F.col("was"), 0).otherwise(1), F.when(F.col("recent") | ~F.col("was"), -F.unix_micros(F.coalesce("created", r.now))), F.col("prev_seen").asc_nulls_first(), F.col("seq")]
    reachable = F.col("checks") & (F.col("url") != "")
    old = F.col("was") & F.col("created").isNotNull() & ~F.col("recent")
    new_ok, new_over = within(option("max_date_validation_requests", "int", 60), order, reachable & ~old)
    old_ok, old_over = within(option("max_repost_validation_requests", "int", 6), order, reachable & old)
    df = df.withColumn("new_over", new_over).withColumn("old_over", old_over).withColumn("taken", new_ok | old_ok)
    pages = details(r.payloads).withColumnRenamed("key", "url")
    df = df.join(pages, ["company_id", "url"], "left").withColumn("failed", F.col("taken") & ~F.coalesce(F.col("detail_status") == 200, F.lit(False)))
    first = F.try_element_at(extract_jsonld(F.when(F.col("taken") & ~F.col("failed"), F.col("detail"))), F.lit(1))
    df = df.withColumn("stated", date(F.get_json_object(first, "$.datePosted"), r.now))
    agrees = F.col("stated").isNotNull() & F.coalesce(F.abs(F.datediff("stated", "created")) <= 1, F.lit(True))
    repost = F.col("stated") > F.col("prev_posted")
    kind = F.when(~F.col("taken"), F.when(F.col("created").isNotNull(), "lever_createdAt_unverified").otherwise("unknown")).when(agrees, "jsonld_datePosted").when(repost, "jsonld_datePosted_verified_repost").when(F.col("stated").isNotNull(), "jsonld_conflicts_with_createdAt").otherwise("unknown")
    df = df.withColumn("kind", kind).withColumn("verified", F.col("taken") & F.col("kind").isin("jsonld_datePosted", "jsonld_datePosted_verified_repost"))
    held = (F.col("checks") & (F.col("url") == "")) | (F.col("taken") & ~F.col("failed") & ~F.col("verified"))
    df = df.withColumn("held", held)
    section = F.from_json(F.get_json_object("item", "$.lists"), "array<struct<text:string,content:string>>")
    lists_html = F.array_join(F.flatten(F.transform(F.coalesce(section, F.array().cast("array<struct<text:string,content:string>>")), lambda s: F.array(F.coalesce(s["text"], F.lit("")), F.coalesce(s["content"], F.lit(""))))), " <br> ")
    plain = lambda a, b: F.when(text(a) != "", text(a)).otherwise(strip_html(text(b)))
    body = F.trim(F.regexp_replace(F.concat_ws(" ", plain("$.descriptionPlain", "$.description"), strip_html(lists_html), plain("$.additionalPlain", "$.additional")), " +", " "))
    spots = _objects("$.categories.allLocations")
    place = F.when(F.size(spots) > 0, F.array_join(F.filter(spots, lambda x: x != ""), " | ")).otherwise(text("$.categories.location"))
    out = posting(
        df.where("not failed and not held and not new_over and not old_over"), "lever", source_job_id=F.col("key"), title=F.col("title"), location=place, description=body, source_url=F.col("url"), apply_url=text("$.applyUrl"),
        posted_at=F.when(F.col("verified"), F.col("stated")).otherwise(F.col("created")), posting_date_kind=F.col("kind"), posting_date_confidence=F.when(F.col("verified"), "medium_high").when(F.col("created").isNotNull(), "low").otherwise("unknown"),
        employment_type=text("$.categories.commitment"), department=joined(text("$.categories.department"), text("$.categories.team")), workplace_type=text("$.workplaceType"),
    )
    n = df.groupBy("company_id").agg(F.count_if("failed").alias("failures"), F.count_if("held").alias("unverified"), F.count_if("new_over").alias("skips"), F.count_if("old_over").alias("deferred"))
    last = _lists(r, None).groupBy("company_id", "page").agg(F.count("*").alias("size"), F.first("connector").alias("connector")).groupBy("company_id").agg(F.max_by("size", "page").alias("last_size"), F.max("page").alias("last_page"), F.first("connector").alias("connector"))
    n = last.join(n, "company_id", "left").withColumn("cut_off", (F.col("last_size") >= F.least(F.lit(100), option("page_size", "int", 100))) & (F.col("last_page") + 1 >= option("max_pages", "int", 30))).drop("connector")
    pos = lambda c: F.coalesce(c, F.lit(0)) > 0
    warning = say((F.col("cut_off"), "Pagination stopped at the configured number of pages."), (pos("failures"), number("failures", "Left ", " failed date-validation candidate(s) unseen for retry.")), (pos("unverified"), number("unverified", "Left ", " unverified date candidate(s) unseen.")), (pos("skips"), number("skips", "Left ", " candidate(s) unseen after the date-validation budget was exhausted.")), (pos("deferred"), number("deferred", "Deferred ", " known historical candidate(s) to later rotating repost checks.")))
    return Scan(out, results(r, "lever", out, n, warning, ~(F.coalesce("cut_off", F.lit(False)) | pos("failures") | pos("unverified") | pos("skips"))))


def _address(path: str, of: str = "item") -> Column:
    inner = F.coalesce(F.get_json_object(of, f"{path}.postalAddress"), F.get_json_object(of, path))
    return F.array_join(F.filter(F.array(*[F.get_json_object(inner, f"$.{k}") for k in ("addressLocality", "addressRegion", "addressCountry")]), lambda x: x.isNotNull() & (x != "")), ", ")


@register("ashby")
def ashby(r: Request) -> Scan:
    """One list; unlisted jobs out; all locations, texts before structured addresses; the id is the last part of the URL's path."""
    df = _lists(r, "jobs").where(F.coalesce(F.get_json_object("item", "$.isListed"), F.lit("true")) != "false")
    more = F.flatten(F.transform(_objects("$.secondaryLocations"), lambda s: F.array(F.coalesce(F.get_json_object(s, "$.location"), F.lit("")), _address("$.address", s))))
    url = text("$.jobUrl")
    tail = F.element_at(F.split(F.regexp_replace(path_of(url), "/+$", ""), "/"), -1)
    posted = date(F.get_json_object("item", "$.publishedAt"), r.now)
    remote = F.when(text("$.isRemote") == "true", "Remote").otherwise("")
    out = posting(
        df, "ashby", source_job_id=F.when(F.coalesce(tail, F.lit("")) != "", tail).otherwise(url), title=text("$.title"), location=joined_array(F.concat(F.array(text("$.location"), _address("$.address")), more)),
        description=F.when(text("$.descriptionPlain") != "", text("$.descriptionPlain")).otherwise(strip_html(text("$.descriptionHtml"))), source_url=url, apply_url=text("$.applyUrl"),
        employment_type=text("$.employmentType"), department=F.array_join(F.filter(F.array(text("$.department"), text("$.team")), lambda x: x != ""), " | "), workplace_type=F.coalesce(F.get_json_object("item", "$.workplaceType"), remote), **dated(posted, "last_published"),
    )
    version = r.payloads.where("kind = 'list'").groupBy("company_id").agg(F.max(F.get_json_object("body", "$.apiVersion")).alias("version"))
    odd = F.coalesce(F.col("version") != "1", F.lit(False))
    return Scan(out, results(r, "ashby", out, version, say((odd, number("version", "Unexpected apiVersion=", ""))), F.lit(True)))


@register("smartrecruiters")
def smartrecruiters(r: Request) -> Scan:
    """List and detail; needs the policy documented_public_api; likely recent titles take their detail within a budget."""
    allowed = option("access_policy", "string", "disabled") == "documented_public_api"
    every = _lists(r, "content").where(allowed).withColumn("key", text("$.id")).where("key != ''")
    df = first_of(every, ["company_id", "key"], F.col("seq"))
    posted = date(F.get_json_object("item", "$.releasedDate"), r.now)
    wanted = likely_detail(text("$.name"), r.rules) & (posted.isNull() | (posted >= F.col("since") - F.expr(DAY)))
    taken, over = within(option("max_detail_requests", "int", 80), [F.col("seq")], wanted)
    df = df.withColumn("over", over).withColumn("taken", taken).join(details(r.payloads), ["company_id", "key"], "left")
    df = df.withColumn("failed", F.col("taken") & ~F.coalesce(F.col("detail_status") == 200, F.lit(False))).withColumn("both", overlay("item", F.when(F.col("taken") & ~F.col("failed"), F.col("detail"))))
    t = lambda p: text(p, "both")
    sections = F.concat_ws(" ", *[F.nullif(strip_html(t(f"$.jobAd.sections.{s}.text")), F.lit("")) for s in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")])
    bits = F.array_join(F.filter(F.array(t("$.location.city"), t("$.location.region"), t("$.location.country")), lambda x: x != ""), ", ")
    remote = t("$.location.remote") == "true"
    place = F.when(t("$.location.fullLocation") != "", t("$.location.fullLocation")).when(remote & (bits != ""), F.concat(F.lit("Remote | "), bits)).when(remote, "Remote").otherwise(bits)
    out = posting(
        df.where("not over and not failed"), "smartrecruiters", source_job_id=F.col("key"), title=t("$.name"), location=place, description=sections, source_url=F.when(t("$.postingUrl") != "", t("$.postingUrl")).otherwise(t("$.ref")), apply_url=t("$.applyUrl"),
        employment_type=t("$.typeOfEmployment.label"), department=F.array_join(F.filter(F.array(t("$.department.label"), t("$.function.label")), lambda x: x != ""), " | "), workplace_type=F.when(remote, "Remote").when(t("$.location.hybrid") == "true", "Hybrid").otherwise(""), raw=F.col("both"), **dated(posted, "releasedDate"),
    )
    n = df.groupBy("company_id").agg(F.count_if("failed").alias("failures"), F.count_if("over").alias("skips"))
    total = r.payloads.where("kind = 'list'").groupBy("company_id").agg(F.max(F.get_json_object("body", "$.totalFound").try_cast("int")).alias("total"), F.sum(F.coalesce(F.size(F.from_json("body", "struct<content:array<string>>")["content"]), F.lit(0))).alias("returned"))
    n = total.join(n, "company_id", "left").withColumn("short", F.coalesce(F.col("returned") < F.col("total"), F.lit(False)))
    bad, skips = F.coalesce("failures", F.lit(0)) > 0, F.coalesce("skips", F.lit(0)) > 0
    warning = say((F.col("short"), number("total", "Pagination stopped before totalFound=", ".")), (bad, number("failures", "Left ", " failed detail candidate(s) unseen for retry.")), (skips, number("skips", "Left ", " candidate(s) unseen after the detail budget was exhausted.")))
    return Scan(out, results(r, "smartrecruiters", out, n, warning, ~(F.coalesce("short", F.lit(False)) | bad | skips), ~allowed, "Disabled unless access_policy=documented_public_api is set."))


def list_ends(ages: DataFrame) -> DataFrame:
    """Pages of lists (company_id, page, print, newest, oldest, unread, since) with ended: a page of the same print came before, or two old pages in a row, as long as dates only fall and all were read."""
    w = Window.partitionBy("company_id").orderBy("page")
    again = F.row_number().over(Window.partitionBy("company_id", "print").orderBy("page")) > 1
    old = F.coalesce(F.col("newest") < F.col("since") - F.expr(DAY), F.lit(False))
    ages = ages.withColumn("again", again).withColumn("old", old).withColumn("jumps", F.coalesce(F.col("newest") > F.lag("oldest").over(w) + F.expr("interval 24 hours"), F.lit(False)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ages = ages.withColumn("steady", ~F.max("jumps").over(upto) & (F.sum("unread").over(upto) == 0)).withColumn("stop", F.col("steady") & F.col("old") & F.coalesce(F.lag("old").over(w), F.lit(False)))
    return ages.withColumn("ended", F.coalesce(F.max(F.col("stop")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) | F.max("again").over(upto))


@register("workday")
def workday(r: Request) -> Scan:
    """Pages of summaries joined to details; needs access_approved; a repeated page and two old pages in a row end the list."""
    approved = option("access_approved", "boolean", False)
    every = _lists(r, "jobPostings").where(approved).withColumn("posted_age", date(F.get_json_object("item", "$.postedOn"), r.now)).withColumn("path", text("$.externalPath"))
    ages = every.groupBy("company_id", "page").agg(F.max("posted_age").alias("newest"), F.min("posted_age").alias("oldest"), F.count_if(F.col("posted_age").isNull()).alias("unread"), F.first("since").alias("since"), F.sort_array(F.collect_list(F.struct("pos", "path"))).alias("paths"))
    ages = ages.withColumn("print", F.sha2(F.to_json(F.transform("paths", lambda p: p["path"])), 256))
    ages = list_ends(ages)
    df = every.join(ages.select("company_id", "page", "ended"), ["company_id", "page"]).where("not ended")
    wanted = likely_detail(text("$.title"), r.rules) & (F.col("posted_age").isNull() | (F.col("posted_age") >= F.col("since") - F.expr("interval 2 days")))
    taken, over = within(option("max_detail_requests", "int", 120), [F.col("seq")], wanted)
    df = df.withColumn("over", over).withColumn("taken", taken).withColumn("key", F.col("path")).join(details(r.payloads), ["company_id", "key"], "left")
    df = df.withColumn("failed", F.col("taken") & ~F.coalesce(F.col("detail_status") == 200, F.lit(False))).withColumn("info", F.coalesce(F.get_json_object("detail", "$.jobPostingInfo"), F.col("detail")))
    t = lambda p: text(p, "info")
    open_ = (t("$.posted") != "false") & (t("$.canApply") != "false")
    host = F.regexp_replace(F.when(option("host", "string", "").rlike("^http"), option("host", "string", "")).otherwise(F.concat(F.lit("https://"), option("host", "string", ""))), "/+$", "")
    url = F.when(t("$.externalUrl") != "", t("$.externalUrl")).otherwise(F.concat(host, F.lit("/"), option("site", "string", ""), F.col("path")))
    more = F.transform(_objects("$.additionalLocations", "info"), lambda s: F.when(s.startswith("{"), F.coalesce(F.get_json_object(s, "$.descriptor"), F.get_json_object(s, "$.name"), F.lit(""))).otherwise(s))
    exact = date(F.get_json_object("info", "$.startDate"), r.now)
    stated = t("$.startDate") != ""
    out = posting(
        df.where("taken and not failed").where(open_), "workday", source_job_id=F.coalesce(*[F.nullif(t(f"$.{k}"), F.lit("")) for k in ("id", "jobPostingId", "jobReqId")], F.col("path")), title=F.when(t("$.title") != "", t("$.title")).otherwise(text("$.title")),
        location=joined_array(F.concat(F.array(t("$.location"), text("$.locationsText")), more)), description=strip_html(t("$.jobDescription")), source_url=url, apply_url=url, posted_at=F.coalesce(exact, F.col("posted_age")),
        posting_date_kind=F.when(stated, "posting_start_date").otherwise("relative_postedOn"), posting_date_confidence=F.when(stated, "high").otherwise("medium"), employment_type=t("$.timeType"), raw=F.col("info"),
    )
    n = df.groupBy("company_id").agg(F.count_if("failed").alias("failures"), F.count_if("over").alias("skips"))
    seen = ages.groupBy("company_id").agg(F.max("again").alias("again"), F.max("stop").alias("stop"), F.max("page").alias("last_page"))
    total = r.payloads.where("kind = 'list' and page = 0").groupBy("company_id").agg(F.max(F.get_json_object("body", "$.total").try_cast("int")).alias("total"))
    got = every.groupBy("company_id").agg(F.count("*").alias("returned"), F.first("connector").alias("connector"))
    n = total.join(seen, "company_id", "left").join(got, "company_id", "left").join(n, "company_id", "left")
    n = n.withColumn("cut_off", (F.col("returned") < F.col("total")) & (F.col("last_page") + 1 >= F.least(F.lit(100), option("max_pages", "int", 100))) & ~F.col("stop")).drop("connector")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    pos = lambda c: F.coalesce(c, F.lit(0)) > 0
    capped = F.coalesce(F.col("total") == 2000, F.lit(False))
    warning = say((capped, "The source reported its 2,000-record cap."), (yes("again"), "The source repeated a page; pagination stopped."), (yes("cut_off"), "Pagination reached the configured number of pages."), (pos("skips"), number("skips", "Detail request budget was exhausted; ", " candidate(s) were not evaluated.")), (pos("failures"), number("failures", "Skipped ", " failed detail request(s).")))
    return Scan(out, results(r, "workday", out, n, warning, ~(capped | yes("again") | yes("cut_off") | pos("skips") | pos("failures")), ~approved, "Disabled: access_approved is not true."))


@register("amazon")
def keyword_search(r: Request) -> Scan:
    """The union of an employer's keyword searches; of a job found twice, the last wins; interns, students, managers and foreign countries out."""
    df = _lists(r, "jobs").withColumn("key", F.coalesce(*[F.nullif(text(f"$.{k}"), F.lit("")) for k in ("id", "id_icims", "job_path")]))
    df = first_of(df.where(F.col("key").isNotNull()), ["company_id", "key"], F.desc("seq"))
    flag = lambda k: ~text(f"$.{k}").isin("", "false", "0")
    df = df.where(~(flag("is_intern") | flag("university_job") | flag("is_manager")) & F.upper(text("$.country_code")).isin("", "US", "USA"))
    path = text("$.job_path")
    url = F.when(path.startswith("http"), path).otherwise(F.concat(F.regexp_extract(option("endpoint", "string", "https://www.amazon.jobs/en/search.json"), r"^https?://[^/]+", 0), path))
    basic, wish = strip_html(text("$.basic_qualifications")), strip_html(text("$.preferred_qualifications"))
    body = F.concat_ws(" ", F.nullif(strip_html(text("$.description")), F.lit("")), F.when(basic != "", F.concat(F.lit("Basic Qualifications: "), basic)), F.when(wish != "", F.concat(F.lit("Preferred Qualifications: "), wish)))
    spot = lambda s: F.when(F.ltrim(s).startswith("{"), F.coalesce(F.get_json_object(s, "$.normalizedLocation"), F.get_json_object(s, "$.location"), F.get_json_object(s, "$.locationNonStemming"), F.lit(""))).otherwise(s)
    spots = _objects("$.locations")
    place = joined_array(F.transform(F.when(F.size(spots) > 0, spots).otherwise(F.array(text("$.location"))), spot))
    posted = date(F.get_json_object("item", "$.posted_date"), r.now)
    out = posting(
        df, "amazon", source_job_id=F.col("key"), title=text("$.title"), location=place, description=body, source_url=url, apply_url=F.when(text("$.url_next_step") != "", text("$.url_next_step")).otherwise(url),
        employment_type=text("$.job_schedule_type"), department=text("$.job_category"), **dated(posted, "posted_date"),
    )
    sizes = r.payloads.where("kind = 'list'").withColumn("size", F.coalesce(F.size(F.from_json("body", "struct<jobs:array<string>>")["jobs"]), F.lit(0)))
    last = sizes.groupBy("company_id", "key").agg(F.max_by("size", "page").alias("size"), F.count("*").alias("pages"))
    last = last.join(F.broadcast(r.companies.withColumnRenamed("id", "company_id").select("company_id", "connector")), "company_id")
    cut = (F.col("size") >= F.least(F.lit(100), option("page_size", "int", 100))) & (F.col("pages") >= option("max_pages_per_query", "int", 3))
    n = last.groupBy("company_id").agg(F.array_join(F.sort_array(F.collect_list(F.when(cut, F.concat(F.lit("Query '"), F.col("key"), F.lit("' reached its page limit."))))), " ").alias("cuts"))
    return Scan(out, results(r, "amazon", out, n, F.col("cuts"), F.coalesce(F.col("cuts") == "", F.lit(True))))

