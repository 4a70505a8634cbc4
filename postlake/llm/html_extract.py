"""Main text of web pages by differencing each page against its nearest neighbours by URL.

Pages are put in order of (host, path), so that a page's nearest URLs within its host are those before and after it. The
text lines of a page and of each neighbour are aligned by longest common subsequence, and lines shared with neighbours are
deleted. What the mark-up says outranks that: lines of menus, adverts, forms and the like always go, and lines of an
explicit article stay, since neighbours also share whole articles.

The order is global, so results do not depend on how it is cut into tasks: the pages beside a cut go to both of its sides.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from .common import materialize, shuffle_width

# Fixed values of HTML: elements whose content is no mark-up, that hold no reading text, that break lines, that stand alone.
RAW = frozenset("script style noscript textarea title template iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select option svg math canvas audio video object dialog menu datalist".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what is not the article; those of the second list also name layouts around an article.
_WORDS_NOT = (
    "ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|promos?|promotions?|menus?|breadcrumbs?|widgets?|copyright|cookies?|consent|gdpr|popups?|modals?|overlays?|newsletters?"
    "|subscribe|subscription|signup|comments?|replies|reply|disqus|responses|share|sharing|social|related|recommended|toolbar|skip|pagination|pager|contentinfo"
)
_WORDS_LAYOUT = "banners?|nav|navbar|navigation|sidebars?|footers?|notices?|masthead|search|complementary|alert"
NOISE = re.compile(rf"(?:^|[\s_-])(?:{_WORDS_NOT}|{_WORDS_LAYOUT})(?:$|[\s_-])", re.I)
LAYOUT = re.compile(rf"(?:^|[\s_-])(?:{_WORDS_LAYOUT})(?:$|[\s_-])", re.I)
NOT_LAYOUT = re.compile(rf"(?:^|[\s_-])(?:{_WORDS_NOT})(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<marks>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<marks2>[^<>]*)>", re.S)
MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Neighbours on either side, and the share of a page's characters beyond which a neighbour that shares them is a copy, which tells nothing about templates.
NEAR, COPY = 2, 0.9
#: Open lines beside an article stay only if they read like text: so long, or a sentence of so many words.
LONG_LINE, SENTENCE_WORDS = 80, 8
#: Cuts of the global order per shuffle partition, and pages sampled per cut to place them.
CUTS, SAMPLE = 4, 30


class Line(NamedTuple):
    text: str
    zone: str  # "article", "noise", "open", or "held": an article's line inside a wrapper that is named like noise


class Tag(NamedTuple):
    name: str
    noise: int  # 0 none, 1 by a name that layouts have too, 2 by another name, 3 by the element
    article: bool
    outer: tuple[list[int], bool] | None  # noise outside an article, which is counted anew inside it


_SCOPES = frozenset("ul ol table div section tbody dl body".split())
_IMPLIED = frozenset("p li option tr td th dt dd".split())


def _noise_by_marks(attrs: str) -> int:
    level = 0
    for m in MARKS.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 3
        if name in ("class", "id", "role") and NOISE.search(value):
            level = max(level, 2 if NOT_LAYOUT.search(value) else 1)
    return level


class _Open:
    """The open elements; all work per tag is constant, but for elements that it closes."""

    def __init__(self) -> None:
        self.stack: list[Tag] = []
        self.names: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]  # names since the last element that implied ends do not cross
        self.noise = [0, 0, 0, 0]
        self.articles = 0
        self.held = False

    def push(self, name: str, noise: int, article: bool) -> None:
        outer = None
        if article and not noise and not self.articles and not self.noise[3] and (self.noise[1] or self.noise[2]):
            outer = self.noise, self.held
            self.noise, self.held = [0, 0, 0, 0], self.noise[2] > 0  # a layout's name says nothing about the article in it
        self.stack.append(Tag(name, noise, article, outer))
        self.names[name] += 1
        if noise or article or name in _SCOPES:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][name] += 1
        self.noise[noise] += 1
        self.articles += article

    def pop(self) -> None:
        tag = self.stack.pop()
        self.names[tag.name] -= 1
        if tag.noise or tag.article or tag.name in _SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][tag.name] -= 1
        self.noise[tag.noise] -= 1
        self.articles -= tag.article
        if tag.outer:
            self.noise, self.held = tag.outer

    def close(self, name: str) -> None:
        """An end tag closes what stands open inside its element; one without an element is skipped."""
        if self.names[name]:
            while self.stack[-1].name != name:
                self.pop()
            self.pop()

    def imply(self, name: str) -> None:
        """An unclosed <p>, <li> ... ends where its next sibling begins, within the element that holds both."""
        if self.scopes[-1][name]:
            self.close(name)

    def zone(self) -> str:
        if any(self.noise[1:]):
            return "noise"
        return "open" if not self.articles else "held" if self.held else "article"


def lines(html: str | None) -> list[Line]:
    """The text lines (blocks) of a page in order, with the zone that the mark-up puts them in.

    Broken mark-up is read leniently: an end tag closes what stands open inside it, one that closes nothing is skipped,
    a cut-off tag is text. Character references are decoded once, white space becomes one space. The work is linear in the
    page, however deep elements are nested.
    """
    out: list[Line] = []
    if not html:
        return out
    held, parts, at, n = _Open(), [], 0, len(html)

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Line(text, held.zone()))

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        marks = m["marks"] or m["marks2"] or ""
        if name in BLOCKS:
            flush()
        if m["end"] or m["end2"]:
            held.close(name)
            continue
        if name in RAW:
            end = RAW_END[name].search(html, at)
            at = n if end is None else (html.find(">", end.start()) + 1 or n)
            continue
        if name in VOID or marks.endswith("/") and name not in BLOCKS:
            continue
        if name in _IMPLIED:
            held.imply(name)
        article = name in ("article", "main") or 'role="main"' in marks
        noise = 3 if name in DROPPED or name == "header" and not held.articles else _noise_by_marks(marks) if marks and name not in ("html", "body", "article", "main") else 0
        held.push(name, noise, article)
    flush()
    return out


def _row(x: list[str], y: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of x and each beginning of y (from the empty one), bit-parallel."""
    places: dict[str, int] = {}
    for j, t in enumerate(y):
        places[t] = places.get(t, 0) | 1 << j
    full = (1 << len(y)) - 1
    v = full
    for t in x:
        m = v & places.get(t, 0)
        v = (v + m | v - m) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in a on a longest common subsequence of a and b, for any sizes in linear memory (halving a at each step)."""
    got: set[int] = set()
    in_b, in_a = set(b), set(a)
    todo = [([i for i, t in enumerate(a) if t in in_b], [j for j, t in enumerate(b) if t in in_a])]
    while todo:
        x, y = todo.pop()
        lo = 0
        while lo < min(len(x), len(y)) and a[x[lo]] == b[y[lo]]:
            lo += 1
        end = 0
        while end < min(len(x), len(y)) - lo and a[x[-1 - end]] == b[y[-1 - end]]:
            end += 1
        got.update(x[:lo], x[len(x) - end :])
        x, y = x[lo : len(x) - end], y[lo : len(y) - end]
        if not x or not y:
            continue
        if len(x) == 1:
            if any(a[x[0]] == b[j] for j in y):
                got.add(x[0])
            continue
        half = len(x) // 2
        tx, ty = [a[i] for i in x], [b[j] for j in y]
        k = int(np.argmax(_row(tx[:half], ty) + _row(tx[half:][::-1], ty[::-1])[::-1]))
        todo += [(x[:half], y[:k]), (x[half:], y[k:])]
    return got


def template(own: list[str], neighbours: list[list[str]]) -> set[int]:
    """Positions of own lines that are aligned with at least half of the neighbours, copies of the page aside."""
    size, votes, told = sum(map(len, own)), Counter(), 0
    for other in neighbours:
        common = shared(own, other)
        if sum(len(own[i]) for i in common) < COPY * size:
            votes.update(common)
            told += 1
    return {i for i, n in votes.items() if 2 * n >= told}


def _reads_like_text(line: str) -> bool:
    return len(line) >= LONG_LINE or line[-1:] in ".!?…" and line.count(" ") + 1 >= SENTENCE_WORDS


def main_text(page: list[Line], neighbours: list[list[Line]]) -> str:
    """Join what is left of a page when noise and lines shared with its neighbours are deleted.

    Open lines stay unless they are aligned with half of the neighbours; beside an article only those that read like text.
    Lines of an article inside a wrapper named like noise (an advert that is never closed) count if there is no other.
    """
    zones = {x.zone for x in page}
    article = "article" if "article" in zones else "held" if "held" in zones and "open" not in zones else None
    at = [i for i, x in enumerate(page) if x.zone == "open"]
    gone = template([page[i].text for i in at], [[x.text for x in other if x.zone == "open"] for other in neighbours]) if at and neighbours else set()
    stay = {i for k, i in enumerate(at) if k not in gone and (article is None or _reads_like_text(page[i].text))}
    return " ".join(x.text for i, x in enumerate(page) if x.zone == article or i in stay)


class _Page(NamedTuple):
    page_id: object
    url: object
    host: str
    own: bool
    lines: list[Line]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages come sorted by (part, key); those that are not a part's own only serve as neighbours. Holds 2 NEAR + 1 pages."""
    window: deque[_Page] = deque()
    at, part = 0, None  # of the first page in the window that has no row yet

    def row(k: int) -> tuple:
        me = window[k]
        near = [window[j].lines for j in range(max(0, k - NEAR), min(len(window), k + NEAR + 1)) if j != k and me.host and window[j].host == me.host]
        text = main_text(me.lines, near)
        return me.page_id, me.url, text, len(text), bool(near)

    def rest() -> list[tuple]:
        out = [row(k) for k in range(at, len(window)) if window[k].own]
        window.clear()
        return out

    for pdf in batches:
        out = []
        for page_id, url, host, html, own, p in zip(pdf["page_id"], pdf["url"], pdf["host"], pdf["html"], pdf["own"], pdf["part"], strict=True):
            if p != part:
                out += rest()
                at, part = 0, p
            window.append(_Page(page_id, url, host, own, lines(html)))
            if len(window) - 1 - at == NEAR:
                if window[at].own:
                    out.append(row(at))
                at += 1
                if at > NEAR:
                    window.popleft()
                    at -= 1
        yield _frame(out)
    yield _frame(rest())


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars", "paired"]).astype({"n_chars": "int64", "paired": "bool"})


def _layout(keys: DataFrame, parts: int) -> tuple[list[str], dict[str, list[int]]]:
    """Cuts of the order of keys, and for the keys beside a cut the other parts that need them. Both are bounded by parts."""
    n = keys.count()
    thin = max(1, n // max(1, parts * SAMPLE))
    sample = sorted(r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(thin)) == 0).limit(4 * parts * SAMPLE).collect())
    cuts = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    dealt = keys.withColumn("part", _part_of(cuts)("key"))
    first, last = Window.partitionBy("part").orderBy("key"), Window.partitionBy("part").orderBy(F.desc("key"))
    heads, tails = ([[] for _ in range(len(cuts) + 1)] for _ in range(2))
    for order, into in ((first, heads), (last, tails)):
        for r in dealt.withColumn("k", F.row_number().over(order)).where(F.col("k") <= NEAR).orderBy("part", "k").collect():
            into[r["part"]].append(r["key"])
    guests: dict[str, list[int]] = {}
    for p in range(len(cuts) + 1):
        for own, step in ((tails, -1), (heads, 1)):
            found, q = [], p + step
            while len(found) < NEAR and 0 <= q <= len(cuts):
                found += own[q]
                q += step
            for key in found[:NEAR]:
                if p not in guests.setdefault(key, []):
                    guests[key].append(p)
    return cuts, guests


def _part_of(cuts: list[str]):
    @F.pandas_udf(IntegerType())
    def part(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(cuts, k)).astype("int32")

    return part


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, paired) for every page row.

    paired: a page of the same host stands beside it in the order. Null or empty html: empty text. Null or unreadable URLs have no
    host and are not paired. Repeated rows give repeated results; an empty table gives no rows; other columns are not read. Pages of one URL are
    ordered by id, then by a hash of the page. The one shuffle of pages cuts the order of (host, path) at sampled places, so no host needs
    to fit into a task; the cuts and the keys beside them, bounded by their number, are all that the driver holds.
    """
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    key = F.concat_ws("\x01", "host", F.coalesce(path, F.lit("")), F.col(url_col), F.col(id_col).cast("string"), F.hex(F.xxhash64(html_col)))
    own = pages.select(id_col, url_col, html_col).withColumn("host", F.coalesce(host, F.lit("")))
    own = own.select(key.alias("key"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), "host", F.col(html_col).alias("html"))
    cuts, guests = _layout(materialize(own.select("key"), "page-keys"), CUTS * shuffle_width(spark))
    sent = spark.sparkContext.broadcast((cuts, guests))

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(keys: pd.Series) -> pd.Series:
        """A page's own part first, then those that need it as a neighbour."""
        cuts, guests = sent.value
        return keys.map(lambda k: [bisect_right(cuts, k), *guests.get(k, ())])

    dealt = own.withColumn("at", places("key")).select("*", F.posexplode("at").alias("nth", "part")).withColumn("own", F.col("nth") == 0)
    dealt = dealt.repartitionById(shuffle_width(spark), "part").sortWithinPartitions("part", "key")
    kind = pages.schema[id_col].dataType.simpleString()
    return dealt.select("page_id", "url", "host", "html", "own", "part").mapInPandas(_extract, f"page_id {kind}, url string, text string, n_chars long, paired boolean")
