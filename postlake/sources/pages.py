"""Normalizers of sitemaps and pages with embedded JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import extract_jsonld, jsonld_location, strip_html
from ..functions.text import FLAGS, host_of, https_url, path_of
from .base import Request, Scan, date, details, first_of, number, option, posting, register, results, say, text, within

NODE = "array<struct<loc:string,lastmod:string>>"


def nodes(df: DataFrame, row: str) -> DataFrame:
    """(company_id, key, loc, lastmod) of a sitemap's url or sitemap entries; broken XML has none."""
    parsed = F.from_xml("body", f"`{row}` {NODE}", {"mode": "PERMISSIVE"})
    return df.select("company_id", "key", F.explode(F.coalesce(parsed[row], F.array().cast(NODE))).alias("n")).select("company_id", "key", F.trim("n.loc").alias("loc"), F.trim("n.lastmod").alias("lastmod"))


def _matches_option(value: Column, name: str, default: str | None = None) -> Column:
    """A connector's own regex; true where it has none (and there is no default)."""
    pattern = F.coalesce(F.get_json_object("connector", f"$.{name}"), F.lit(default))
    return F.coalesce(F.rlike(value, F.concat(F.lit(FLAGS), pattern)), F.lit(True))


def candidates(r: Request) -> DataFrame:
    """Job URLs of all reachable sitemaps that pass the company's filters, each once: company_id, loc, modified, seen and the company's columns."""
    maps = r.payloads.where("kind = 'sitemap' and status = 200").select("company_id", "key", "body").dropDuplicates(["company_id", "key"])
    companies = r.companies.withColumnRenamed("id", "company_id")
    upgrade = lambda c: F.when(option("upgrade_http_to_https", "boolean", False), https_url(c)).otherwise(c)
    starts = F.coalesce(F.from_json(F.get_json_object("connector", "$.sitemap_urls"), "array<string>"), F.array(F.get_json_object("connector", "$.sitemap_url")))
    level = companies.select("company_id", F.explode(starts).alias("key"))
    links = nodes(maps, "sitemap").join(F.broadcast(companies), "company_id").withColumn("loc", upgrade(F.col("loc"))).withColumn("modified", date(F.col("lastmod"), r.now))
    links = links.where("loc != '' and (modified is null or modified >= since - interval 2 days)").select("company_id", "key", "loc")
    reached = level
    while not level.isEmpty():  # one join per level of nested indexes; one that was reached before (a cycle) is not followed again
        level = level.join(links, ["company_id", "key"]).select("company_id", F.col("loc").alias("key")).distinct().join(reached, ["company_id", "key"], "left_anti")
        reached = reached.unionByName(level)
    df = nodes(maps.join(reached, ["company_id", "key"], "left_semi"), "url").join(F.broadcast(companies), "company_id")
    df = df.withColumn("loc", upgrade(F.col("loc"))).withColumn("modified", date(F.col("lastmod"), r.now))
    path = path_of(F.col("loc"))
    exempt = F.get_json_object("connector", "$.url_exclude_exempt_regex")
    kept = F.when(exempt.isNotNull(), F.regexp_replace(path, F.concat(F.lit(FLAGS), F.coalesce(exempt, F.lit("(?!x)x"))), F.lit(""))).otherwise(path)
    excluded = F.get_json_object("connector", "$.url_exclude_regex").isNotNull() & _matches_option(kept, "url_exclude_regex")
    df = df.where((F.col("loc") != "") & _matches_option(F.col("loc"), "job_url_regex", r"/jobs?/|/careers?/") & _matches_option(path, "url_include_regex") & ~excluded & (F.col("modified").isNull() | (F.col("modified") >= F.col("since") - F.expr("interval 2 days"))))
    df = first_of(df, ["company_id", "loc"], F.col("key"))
    known = r.known.select("company_id", F.col("source_url").alias("loc"), F.lit(True).alias("known")).distinct()
    return df.join(known, ["company_id", "loc"], "left").withColumn("seen", (F.col("mode") == "incremental") & F.coalesce("known", F.lit(False))).drop("known")


def _identifier() -> Column:
    value = F.get_json_object("item", "$.identifier")
    inner = F.coalesce(*[F.nullif(F.get_json_object(value, f"$['{k}']"), F.lit("")) for k in ("value", "name", "@id")])
    return F.when(value.startswith("{"), F.coalesce(inner, F.lit(""))).otherwise(F.coalesce(value, F.lit("")))


def _postings(df: DataFrame, r: Request, source: str, lastmod: Column) -> DataFrame:
    """Postings of pages with url, item, name, connector."""
    stated = text("$.datePosted") != ""
    dated = date(F.get_json_object("item", "$.datePosted"), r.now)
    posted = F.coalesce(dated, F.when(option("allow_lastmod_as_posted_date", "boolean", False), lastmod))
    own = F.when(text("$.url") != "", text("$.url")).otherwise(F.col("url"))
    url = F.when(own.startswith("http://") & F.col("url").startswith("https://") & (host_of(own) == host_of(F.col("url"))), https_url(own)).otherwise(own) if source == "sitemap" else own
    title = F.when(text("$.title") != "", text("$.title")).otherwise(text("$.name"))
    ident = _identifier()
    fallback = "sitemap_lastmod" if source == "sitemap" else "unknown"
    return posting(
        df, source, source_job_id=F.when(ident != "", ident).otherwise(url), title=title, location=jsonld_location(F.col("item")), description=strip_html(text("$.description")), source_url=url, apply_url=url, posted_at=posted,
        posting_date_kind=F.when(stated, "jsonld_datePosted").otherwise(fallback), posting_date_confidence=F.when(stated, "high").when(posted.isNotNull(), "low").otherwise("unknown"),
        employment_type=text("$.employmentType"), workplace_type=text("$.jobLocationType"),
    )


@register("sitemap")
def sitemap(r: Request) -> Scan:
    """Sitemaps to pages to JSON-LD postings: new URLs first, newest first, within a budget of pages; other employers' postings out."""
    found = candidates(r)
    newest = F.coalesce(F.unix_micros("modified"), F.lit(-(2**62)))
    order = [F.when(F.col("seen"), 1).otherwise(0), -newest, F.col("loc")]
    taken, over = within(option("max_detail_requests", "int", 80), order, F.lit(True))
    df = found.withColumn("over", over).withColumn("taken", taken).withColumn("key", F.col("loc")).join(details(r.payloads), ["company_id", "key"], "left")
    status = F.coalesce("detail_status", F.lit(0))
    df = df.withColumn("gone", F.col("taken") & status.isin(404, 410)).withColumn("failed", F.col("taken") & (status != 200) & ~status.isin(404, 410)).withColumn("denied", F.col("failed") & status.isin(401, 403))
    before = Window.partitionBy("company_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("stopped", F.coalesce(F.max("denied").over(before), F.lit(False)))  # nothing is read past a refusal
    pages = df.where("taken and not gone and not failed and not stopped").withColumn("url", F.col("loc")).withColumn("item", F.explode(extract_jsonld(F.col("detail"))))
    org = F.lower(F.trim(text("$.hiringOrganization.name")))
    name = F.lower(F.trim("name"))
    aliases = F.transform(F.coalesce(F.from_json(F.get_json_object("connector", "$.hiring_organization_aliases"), "array<string>"), F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))
    ours = (org == "") | F.contains(org, name) | F.contains(name, org) | F.array_contains(aliases, org)
    pages = pages.withColumn("ours", ours)
    out = _postings(pages.where("ours"), r, "sitemap", F.col("modified"))
    live = df.where("not stopped")
    n = live.groupBy("company_id").agg(F.count("*").alias("listed"), F.count_if("gone").alias("gones"), F.count_if("failed").alias("failures"), F.count_if("denied").alias("denials"))
    n = n.join(df.groupBy("company_id").agg(F.count_if("over").alias("overs")), "company_id", "left").join(pages.where("not ours").groupBy("company_id").agg(F.count("*").alias("foreign")), "company_id", "left")
    broken = r.payloads.where("kind = 'sitemap'").groupBy("company_id").agg(F.count_if((F.col("status") != 200) | ~F.coalesce(F.col("body"), F.lit("")).rlike(r"(?s)<(?:\w+:)?(?:urlset|sitemapindex)\b.*</(?:\w+:)?(?:urlset|sitemapindex)>")).alias("broken"))
    n = broken.join(n, "company_id", "left")
    pos = lambda c: F.coalesce(c, F.lit(0)) > 0
    warning = say((pos("broken"), number("broken", "", " invalid sitemap(s).")), (pos("failures"), number("failures", "Skipped ", " failed detail page(s).")), (pos("denials"), "Access denied: stopped remaining detail requests for this source."), (pos("foreign"), number("foreign", "Skipped ", " posting(s) with a mismatched hiringOrganization.")), (pos("overs"), number("overs", "", " candidate URL(s) past the detail budget.")), (pos("gones"), number("gones", "Skipped ", " gone detail page(s).")))
    return Scan(out, results(r, "sitemap", out, n, warning, ~(pos("broken") | pos("failures") | pos("overs"))))


@register("jsonld_pages")
def jsonld_pages(r: Request) -> Scan:
    """A fixed list of pages."""
    companies = r.companies.withColumnRenamed("id", "company_id")
    urls = companies.withColumn("url", F.explode(F.from_json(F.get_json_object("connector", "$.urls"), "array<string>"))).withColumn("key", F.col("url"))
    df = urls.join(details(r.payloads), ["company_id", "key"], "left")
    pages = df.where("detail_status = 200").withColumn("item", F.explode(extract_jsonld(F.col("detail"))))
    out = _postings(pages, r, "jsonld_pages", F.lit(None).cast("timestamp"))
    n = df.groupBy("company_id").agg(F.count_if(~F.coalesce(F.col("detail_status") == 200, F.lit(False))).alias("failures"))
    bad = F.coalesce("failures", F.lit(0)) > 0
    return Scan(out, results(r, "jsonld_pages", out, n, say((bad, number("failures", "", " page(s) failed."))), ~bad))
