"""Dates, URLs, keys and text normalisation as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java flags under which rule patterns mean what they mean in Python: no case, Unicode classes, only \n ends a line.
FLAGS = "(?iUd)"
CASED = "(?Ud)"

# Query keys that only track where a visitor came from.
TRACKING_KEYS = ("gh_jid", "gh_src", "lever-source", "source", "src", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
# Number words that count years.
YEAR_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def matches(text: Column, pattern: str, cased: bool = False) -> Column:
    return text.rlike((CASED if cased else FLAGS) + pattern)


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(rf"{FLAGS}^(?:{pattern})\z")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def present(*values: Column, default: str = "") -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def parse_epoch(value: Column) -> Column:
    """Seconds, or milliseconds where the number is too large for seconds, as a timestamp."""
    x = value.cast("double")
    micros = F.when(x > 1e10, x * 1000).otherwise(x * 1_000_000)
    return F.when(F.abs(micros) < 2.5e17, F.timestamp_micros(micros.cast("long")))


def _iso(text: Column) -> Column:
    """ISO 8601 date, or date and time, with any number of fraction digits (the first six count); no zone means UTC."""
    shape = r"^(\d{4}-\d{2}-\d{2}|\d{8})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?\z"
    g = lambda k: F.regexp_extract(text, shape, k)
    day = F.when(F.length(g(1)) == 8, F.concat_ws("-", F.substring(g(1), 1, 4), F.substring(g(1), 5, 2), F.substring(g(1), 7, 2))).otherwise(g(1))
    part = lambda k: F.when(g(k) == "", "00").otherwise(g(k))
    zone = F.when(g(6).isin("", "Z"), "+00:00").otherwise(F.concat(F.substring(g(6), 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substring(g(6), 4, 3), ":", ""), 2, "0")))
    stamp = F.concat(day, F.lit(" "), part(2), F.lit(":"), part(3), F.lit(":"), part(4), F.lit("."), F.rpad(F.substring(g(5), 1, 6), 6, "0"), zone)
    return F.when(text.rlike(shape), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSxxx")))


def _iso_week(text: Column) -> Column:
    shape = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?\z"
    g = lambda k: F.regexp_extract(text, shape, k)
    first = F.to_date(F.date_trunc("week", F.try_to_timestamp(F.concat(g(1), F.lit("-01-04")), F.lit("yyyy-MM-dd"))))
    day = F.when(g(3) == "", 1).otherwise(g(3).try_cast("int"))
    return F.when(text.rlike(shape) & g(2).try_cast("int").between(1, 53), F.date_add(first, ((g(2).try_cast("int") - 1) * 7 + day - 1).cast("int")).cast("timestamp"))


def parse_datetime(value: Column, now: Column) -> Column:
    """Feed dates as text: relative words, ISO forms, calendar forms, mail dates; null for all else."""
    text = strip(value)
    low = F.lower(text)
    ago = r"(\d+)\s+(hour|day|week|month)s?\s+ago"
    count = F.regexp_extract(low, ago, 1).try_cast("int")
    unit = F.regexp_extract(low, ago, 2)
    hours = count * F.when(unit == "hour", 1).when(unit == "day", 24).when(unit == "week", 168).otherwise(720)
    mail = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun), (\d{1,2} [a-z]{3} \d{4} \d{1,2}:\d{2}:\d{2} )(Z|[+-]\d{2}:?\d{2})\z"
    mail_text = F.concat(F.regexp_extract(text, mail, 1), F.when(F.regexp_extract(text, mail, 2) == "Z", "+0000").otherwise(F.replace(F.regexp_extract(text, mail, 2), F.lit(":"), F.lit(""))))
    by_form = lambda shape, form: F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)))
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(low.isin("today", "posted today", "just posted"), F.date_trunc("day", now))
        .when(low.isin("yesterday", "posted yesterday"), F.date_trunc("day", now - F.expr("interval 1 day")))
        .when(low.rlike(ago), F.try_add(now, F.make_dt_interval(hours=-hours)))
        .otherwise(
            F.coalesce(
                _iso(text),
                _iso_week(text),
                by_form(r"^\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d"),
                by_form(r"^\d{1,2}/\d{1,2}/\d{4}\z", "M/d/yyyy"),
                by_form(r"(?i)^[a-z]{3,9} \d{1,2}, \d{4}\z", "MMMM d, yyyy"),
                by_form(r"(?i)^[a-z]{3} \d{1,2}, \d{4}\z", "MMM d, yyyy"),
                F.when(text.rlike(mail), F.try_to_timestamp(mail_text, F.lit("d MMM yyyy H:mm:ss xx"))),
            )
        )
    )


def _quoted(text: Column) -> Column:
    """Form-encoding that leaves ~ and escapes *."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.translate(text, "+", " "))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, single slashes, no tracking keys, sorted query, no fragment; "" for null or empty."""
    whole = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"
    part = lambda k: F.regexp_extract(F.regexp_replace(url, r"[\t\r\n]", ""), whole, k)
    path = F.regexp_replace(F.regexp_replace(part(3), "/+", "/"), "/$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.transform(
        F.filter(F.split(part(4), "&"), lambda p: p != ""),
        lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(p["v"]))), "&")
    scheme = F.lower(part(1))
    host = F.when(part(2) != "", F.lower(part(2))).when(scheme.isin("http", "https"), "//").otherwise("")
    out = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.isNull() | (url == ""), "").otherwise(out)


def job_key(company_id: Column, source_job_id: Column, url: Column, title: Column, location: Column) -> Column:
    identity = present(strip(source_job_id), canonical_url(url), F.concat(F.lower(title), F.lit("|"), F.lower(location)))
    return F.sha2(F.concat(company_id, F.lit("|"), identity), 256)


def content_hash(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lower(strip(collapse(p))) for p in parts]), 256)


def age_text(posted: Column, now: Column) -> Column:
    hours = (F.unix_micros(now) - F.unix_micros(posted)) / F.lit(3.6e9)
    days = F.concat(F.format_string("%.1f", F.bround(hours / 24, 1)), F.lit("d old"))
    young = F.concat(F.greatest(F.lit(1), F.bround(hours, 0).cast("int")).cast("string"), F.lit("h old"))
    return F.when(posted.isNull(), "date unavailable").when(hours < 24, young).otherwise(days)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def split_values(text: Column, sep: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), strip), lambda x: x != "")


def integer_from(pattern: str, text: Column) -> Column:
    return F.replace(F.regexp_extract(text, FLAGS + pattern, 1), F.lit(","), F.lit("")).try_cast("int")


def tenant_parts(identifier: Column) -> Column:
    """struct(host, tenant, site) from a board URL or from tenant:cluster:site; null where it is neither."""
    url = r"(?i)^https?://(([a-z0-9-]+)\.[^/]+)/(?:[a-z]{2}-[a-z]{2}/)?([^/?#]+)"
    g = lambda k: F.regexp_extract(identifier, url, k)
    p = F.split(identifier, ":")
    by_url = F.struct(F.lower(g(1)).alias("host"), F.lower(g(2)).alias("tenant"), g(3).alias("site"))
    by_parts = F.struct(F.concat(p[0], F.lit("."), p[1], F.lit(".myworkdayjobs.com")).alias("host"), p[0].alias("tenant"), p[2].alias("site"))
    return F.when(identifier.rlike(url), by_url).when(identifier.rlike(r"^[^:/]+:[^:/]+:[^:/]+\z"), by_parts)


def fold_hyphens(text: Column) -> Column:
    return F.translate(text, "‐‑‒–—―", "------")


def year_value(word: Column) -> Column:
    w = F.lower(strip(word))
    table = F.create_map(*[x for k, name in enumerate(YEAR_WORDS) for x in (F.lit(name), F.lit(k))])
    return F.coalesce(F.when(w.rlike(r"^\d+\z"), w.try_cast("int")), F.try_element_at(table, w))


def markdown_text(text: Column, limit: int = 200) -> Column:
    """One line, control characters out, mark-up escaped, cut at limit."""
    line = strip(collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]+", " ")))
    cut = F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)
    return F.regexp_replace(cut, r"([\\`*_{}\[\]()#+!|<>~-])", r"\\$1")


def safe_url(url: Column) -> Column:
    """http(s) URLs with a host and without credentials; "" for all else."""
    return F.when(url.rlike(r"(?i)^https?://[^\s/?#@]+(?:[/?#][^\s<>\"]*)?\z"), url).otherwise("")


def local_time(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    return F.from_utc_timestamp(ts, zone)


def https_url(url: Column) -> Column:
    return F.regexp_replace(url, "(?i)^http:", "https:")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def page_fingerprint(paths: Column) -> Column:
    """sha256 of a page's paths as a JSON list; equal for a page that a feed serves twice."""
    return F.sha2(F.to_json(paths), 256)


_KEEP = "/?#[]@!$&'()*+,;=:%-._~"


def ascii_url(url: str | None) -> str | None:
    """A URL as it may be requested: the host in IDNA, all else that is not ASCII (or is a blank) percent-encoded; escapes stay. None for a host that IDNA refuses."""
    if url is None:
        return None
    parts = urlsplit(url)
    try:
        host = (parts.hostname or "").encode("idna").decode()
        port = f":{parts.port}" if parts.port is not None else ""
    except (UnicodeError, ValueError):
        return None
    user, at, _ = parts.netloc.rpartition("@")
    host = f"[{host}]" if ":" in host else host
    safe = lambda s: quote(s, safe=_KEEP)
    return urlunsplit((parts.scheme, safe(user) + at + host + port, safe(parts.path), safe(parts.query), safe(parts.fragment)))


def request_url(url: Column) -> Column:
    """ascii_url over a column, in Arrow batches: IDNA needs tables that the JVM functions lack."""
    return F.pandas_udf(lambda urls: urls.map(ascii_url), "string")(url)


def strip_tags(html: Column) -> Column:
    """Catalyst-only HTML to text: comments and tags become blanks, common references are decoded. See html.strip_html for exact parsing."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n\f]+", " "))
