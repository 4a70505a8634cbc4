"""HTML and JSON-LD parsing in Arrow batches, where exact parsing or recursion is needed."""

from __future__ import annotations

import json
import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = re.compile(r"\s+")


class _Reader(HTMLParser):
    """Collects text nodes, or the contents of JSON-LD scripts."""

    def __init__(self, scripts: bool):
        super().__init__(convert_charrefs=True)
        self.scripts, self.found, self.inside = scripts, [], None

    def handle_starttag(self, tag, attrs):
        if self.scripts and tag == "script" and any(k == "type" and v and "ld+json" in v.lower() for k, v in attrs):
            self.inside = []

    def handle_endtag(self, tag):
        if tag == "script" and self.inside is not None:
            self.found.append("".join(self.inside).strip())
            self.inside = None

    def handle_data(self, data):
        if self.inside is not None:
            self.inside.append(data)
        elif not self.scripts and data.strip():
            self.found.append(data.strip())


def text_of(html: str | None) -> str:
    """Text nodes joined by single spaces, after up to three rounds of entity decoding (feeds escape twice)."""
    if not html:
        return ""
    for _ in range(3):
        plain = unescape(html)
        if plain == html:
            break
        html = plain
    if "<" not in html:
        return SPACE.sub(" ", html).strip()
    reader = _Reader(scripts=False)
    reader.feed(html)
    reader.close()
    return SPACE.sub(" ", " ".join(reader.found)).strip()


def postings_of(html: str | None) -> list[str]:
    """The JobPosting objects of a page's JSON-LD blocks as JSON, through lists and @graph at any depth."""
    if not html or "ld+json" not in html.lower():
        return []
    reader = _Reader(scripts=True)
    reader.feed(html)
    reader.close()
    out = []
    for block in reader.found:
        try:
            stack = [json.loads(block)]
        except ValueError:
            continue
        while stack:
            value = stack.pop()
            if isinstance(value, list):
                stack += reversed(value)
            elif isinstance(value, dict):
                kinds = value.get("@type", "")
                if any(str(k).lower() == "jobposting" for k in (kinds if isinstance(kinds, list) else [kinds])):
                    out.append(json.dumps(value, ensure_ascii=False))
                if value.get("@graph"):
                    stack.append(value["@graph"])
    return out


def _part(value):
    return (value.get("name") or value.get("value") or value.get("@id")) if isinstance(value, dict) else value


def place_of(posting: str | None) -> str:
    """Locations of a JobPosting, joined by " | ", with Remote first for telecommuting."""
    item = json.loads(posting) if posting else {}
    spots = item.get("jobLocation") or item.get("applicantLocationRequirements") or []
    out = ["Remote"] if str(item.get("jobLocationType", "")).upper() == "TELECOMMUTE" else []
    for spot in spots if isinstance(spots, list) else [spots]:
        address = spot.get("address", spot) if isinstance(spot, dict) else None
        if isinstance(address, str):
            out.append(address)
        elif isinstance(address, dict):
            text = ", ".join(str(v) for v in map(_part, map(address.get, ("addressLocality", "addressRegion", "addressCountry"))) if v)
            out += [text] if text else []
    return " | ".join(dict.fromkeys(out))


# Keys under which feeds put countries, and the objects that describe where a job is.
COUNTRY_KEYS = frozenset({"addresscountry", "country", "countrycode", "normalizedcountrycode"})
PLACE_KEYS = frozenset({"address", "additionallocations", "applicantlocationrequirements", "joblocation", "location", "locations", "secondarylocations", "worklocation"})


def countries_of(raw: str | None) -> list[str]:
    """Country values of a payload: at its root as text, or anywhere below its location objects."""
    try:
        top = json.loads(raw) if raw else None
    except ValueError:
        return []
    if not isinstance(top, dict):
        return []
    bare = lambda key: re.sub(r"[^a-z]", "", key.lower())
    out, stack = [], []
    for key, value in reversed(top.items()):
        name = bare(key)
        if name in PLACE_KEYS or name in COUNTRY_KEYS and isinstance(value, dict):
            stack.append(value)
        elif name in COUNTRY_KEYS and isinstance(value, str):
            stack.append((value,))
    while stack:
        value = stack.pop()
        if isinstance(value, tuple):
            out.append(value[0].strip())
        elif isinstance(value, list):
            stack += reversed(value)
        elif isinstance(value, dict):
            below = []
            for key, child in value.items():
                if bare(key) not in COUNTRY_KEYS:
                    below.append(child)
                elif isinstance(child, str):
                    below.append((child,))
                elif isinstance(child, dict):
                    below += [(child[k],) for k in ("name", "value", "code") if isinstance(child.get(k), str)]
            stack += reversed(below)
    return [v for v in out if v]


def _arrow(fn, kind: str):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action=None)

    return run


def strip_html(html: Column) -> Column:
    return _arrow(text_of, "string")(html)


def strip_html_where_marked(text: Column) -> Column:
    """Strip only texts with a tag or an escaped one; the rest never leaves the JVM's columns unchanged."""
    marked = text.rlike(r"<[/A-Za-z]|&(?:amp;|lt;|gt;|#)")
    return F.when(marked, strip_html(F.when(marked, text))).otherwise(text)


def extract_jsonld(html: Column) -> Column:
    return _arrow(postings_of, "array<string>")(html)


def jsonld_location(posting: Column) -> Column:
    return _arrow(place_of, "string")(posting)


#: Every country key holds these letters in this order with no letter between them.
COUNTRY_LETTERS = "(?i)" + "[^a-z]*".join("country")


def explicit_countries(raw: Column) -> Column:
    """Countries that a payload states; payloads without such a key are not parsed."""
    return F.coalesce(_arrow(countries_of, "array<string>")(F.when(raw.rlike(COUNTRY_LETTERS), raw)), F.array().cast("array<string>"))
