"""Personal data by weak supervision: labelers vote on spans, EM rates the labelers, a classifier decides.

Base spans (exact patterns) always stand. They and further candidates, found by looser patterns, get votes from pattern,
gazetteer and context labelers and a few coarse features. Spans are summed to a table of (votes, features), which is
bounded by their possible values and not by the corpus; on it, expectation-maximisation estimates the labelers'
reliabilities, and a logistic span classifier over votes and features is trained on its posteriors. It alone decides on
candidates. Texts are read once and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from .common import fresh, materialize, spread

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Looser patterns for further candidates.
LOOSE = {
    "email": re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]|\{at\}|＠| at ) ?[A-Za-z0-9-]{2,64}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.| dot ) ?[A-Za-z0-9-]{2,24}){1,4}(?!\w)", re.I),
    "ip": re.compile(r"(?<![0-9.:A-Za-z])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)){1}[0-9]{1,3}(?:[\[(]?\.[\])]?[0-9]{1,3}){2}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9.:A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}(?:([./_ \x20-])[0-9]{4,6})(?:\1[0-9]{4,6})\1[0-9]{3,5})(?![0-9A-Za-z])"),
    "phone": re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9-])|(?<![0-9A-Za-z+.=@/_-])(?:00[1-9][0-9]{0,2}[\x20.-]?|0|\()[0-9(][0-9)\x20./-]{6,18}[0-9](?![0-9A-Za-z@])"),
}
#: A candidate can stand only where the text holds one of these (so that others are not searched).
_HINTS = {
    "email": re.compile(r"at[)\]}]|＠| at [A-Za-z0-9-]+(?: dot |\.[A-Za-z])", re.I),
    "ip": re.compile(r"\[\.\]|\(\.\)|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "card": re.compile(r"[0-9]{13}|[0-9]{4}[./_ \x20-][0-9]{4}"),
    "phone": re.compile(r"[0-9][0-9)\x20./-]{6,}[0-9]"),
}
# Gazetteers of mail words, top-level domains and context words in four languages.
TOP_LEVEL = frozenset("com org net edu gov io co de fr es uk eu info biz".split())
CONTEXT = {
    "email": frozenset("email mail contact write reach correo escribir kontakt schreiben contacter courriel adresse".split()),
    "ip": frozenset("ip host server address client login serveur servidor rechner".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte kreditkarte tarjeta carte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact telefon anruf handy teléfono llamar móvil téléphone appeler".split()),
}
AGAINST = frozenset("version release order invoice serial ref isbn page chapter figure ratio date".split())
LABELERS = ("pattern", "gazetteer", "context", "shape", "against")
WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(_octet(p) for p in found.split("."))
    digits = _NOT_DIGIT.sub("", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


# The base e-mail pattern in two halves around the @, so that long runs without one are not searched again and again.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """The leftmost non-overlapping matches of the base pattern, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


#: Dotted numbers of four parts or more, from the start of the first: each digit is read once.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")


def _ips(text: str) -> Iterator[tuple[str, int, int]]:
    """The leftmost non-overlapping matches of the base pattern that hold, in linear time: four parts of a dotted number after four."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield "ip", at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns in code points, by kind as listed, then start."""
    out = [*_emails(text), *_ips(text)]
    for kind in ("card", "phone"):
        if kind == "phone" and "+" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in BASE[kind].finditer(text) if _holds(kind, m[0])]
    return out


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 none."""
    found = text[start:end]
    near = [w.lower() for w in WORDS.findall(text[max(0, start - 40) : start])][-4:] + [w.lower() for w in WORDS.findall(text[end : end + 25])][:2]
    digits = _NOT_DIGIT.sub("", found)
    if kind == "email":
        marked = "@" in found or bool(re.search(r"[(\[{]\s*(?:at|dot)|＠", found, re.I))
        gazetteer = 1 if found.lower().rstrip(")]}").split(".")[-1].split()[-1] in TOP_LEVEL else -1
        shape = 1 if re.search(r"@| dot |\(dot\)|\[dot\]|\{dot\}", found, re.I) else 0
        pattern = 1 if marked else -1
    elif kind == "ip":
        parts = [p for p in _NOT_DIGIT.split(found) if p]
        v6 = ":" in found
        pattern = 1 if v6 or all(map(_octet, parts)) else -1
        gazetteer = 1 if v6 or parts[0] in ("10", "127", "172", "192") else 0
        shape = 1 if v6 or len(parts) == 4 else -1
    elif kind == "card":
        pattern = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = 1 if digits[:1] in "3456" else -1
        shape = 1 if len(set(_NOT_DIGIT.findall(found))) <= 1 else -1
    else:
        pattern = 1 if 9 <= len(digits) <= 15 and not re.search(r"[0-9]{10,}", found) else -1
        gazetteer = 1 if found.startswith(("+", "00", "(0")) else 0
        shape = 1 if re.search(r"[\x20./()-]", found) else -1
    context = 1 if not CONTEXT[kind].isdisjoint(near) else 0
    against = -1 if not AGAINST.isdisjoint(near) else 0
    return pattern, gazetteer, context, shape, against


def _beside(c: str) -> str:
    """What stands beside a span: nothing or white space (s), a letter or digit (w), another character (p)."""
    return "s" if not c or c.isspace() else "w" if c.isalnum() else "p"


def features(kind: str, text: str, start: int, end: int) -> tuple[str, ...]:
    """Coarse features of a span, each with few values: its size, how many kinds of separators it has, what stands beside it."""
    found = text[start:end]
    size = min((end - start) // 8, 8) if kind == "email" else min(len(_NOT_DIGIT.sub("", found)), 20)
    separators = len({c for c in found if not c.isalnum()})
    return f"n{size}", f"k{min(separators, 3)}", "b" + _beside(text[start - 1 : start]), "a" + _beside(text[end : end + 1])


def key(kind: str, text: str, start: int, end: int) -> str:
    """kind:votes:features of a span, e.g. phone:+0+-0:n11.k1.bs.ap."""
    return f"{kind}:{''.join('-0+'[v + 1] for v in votes(kind, text, start, end))}:{'.'.join(features(kind, text, start, end))}"


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser matches that touch no base span of any kind, nor one another."""
    out: list[tuple[str, int, int]] = []
    taken: bytearray | None = None
    for kind in KINDS:
        if not _HINTS[kind].search(text):
            continue
        for m in LOOSE[kind].finditer(text):
            if taken is None:  # a mark per character, so that many spans cost no more than few
                taken = bytearray(len(text))
                for _, s, e in base:
                    taken[s:e] = b"\1" * (e - s)
            if taken.find(1, m.start(), m.end()) < 0:
                out.append((kind, m.start(), m.end()))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return out


def spans_of(text: str | None) -> list[dict]:
    """All spans of a text, base ones first; base is true for these."""
    if not text:
        return []
    base = base_spans(text)
    more = candidates(text, base)
    return [dict(kind=k, start=s, end=e, base=n < len(base), key=key(k, text, s, e)) for n, (k, s, e) in enumerate([*base, *more])]


def em(patterns: dict[str, float], rounds: int = 100) -> dict[str, float]:
    """P(personal data) of each vote pattern (votes as -, 0, +), by EM with conditionally independent labelers.

    Two classes, three votes per labeler. It starts from the majority vote, with smoothing that keeps a labeler better than
    chance at the start, the pattern labeler (the first) more than the others; a pattern that occurs once counts as once.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["-0+".index(c) for c in k] for k in keys])
    score = (v - 1).sum(axis=1) + 2 * (v[:, 0] - 1)
    post = np.clip(0.5 + 0.2 * score, 0.05, 0.95)
    prior_votes = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # class 0: against, none, for; class 1 mirrored
    for _ in range(rounds):
        share = (n @ post + 1) / (n.sum() + 2)
        like = np.tile(np.log([[1 - share], [share]]), (1, len(keys)))
        for j in range(v.shape[1]):
            for c, w in ((0, n * (1 - post)), (1, n * post)):
                t = prior_votes[c] ** (1 if j else 3) + np.bincount(v[:, j], w, 3)
                like[c] += np.log(t / t.sum())[v[:, j]]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(keys, post.tolist(), strict=True))


def train(tally: dict[str, int]) -> dict[str, float]:
    """Key to probability by a logistic classifier over votes and features, trained on the EM posteriors of each kind."""
    out: dict[str, float] = {}
    for kind in KINDS:
        own = sorted(k for k in tally if k.startswith(f"{kind}:"))
        if not own:
            continue
        parts = [k.split(":") for k in own]
        n = np.array([tally[k] for k in own], float)
        by_votes: dict[str, float] = {}
        for (_, v, _), m in zip(parts, n.tolist(), strict=True):
            by_votes[v] = by_votes.get(v, 0) + m
        post = em(by_votes)
        y = np.array([post[v] for _, v, _ in parts])
        names = sorted({f for _, _, fs in parts for f in fs.split(".")})
        x = np.array([[1.0, *("-0+".index(c) - 1 for c in v), *(float(f in fs.split(".")) for f in names)] for _, v, fs in parts])
        w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = x.T @ (x * (n * (p * (1 - p) + 1e-9))[:, None]) + penalty
            w = w - np.linalg.solve(h, x.T @ (n * (p - y)) + penalty @ w)
        out |= dict(zip(own, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))
    return out


_SPANS = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("base", BooleanType()).add("key", StringType()))


@F.pandas_udf(_SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(spans_of)


def _accepted(spans: Column, yes: Column) -> Column:
    return F.filter(spans, lambda c: c["base"] | F.array_contains(yes, c["key"]))


def _classifier(scanned: DataFrame, col: str, threshold: float) -> Column:
    """The keys that a classifier trained on all rows' spans accepts at threshold, as an array."""
    tally = scanned.select(F.explode(F.col(f"{col}.key")).alias("key")).groupBy("key").count().collect()  # bounded by the keys' possible values
    yes = sorted(k for k, p in train({r["key"]: r["count"] for r in tally}).items() if p >= threshold)
    return F.array(*map(F.lit, yes)) if yes else F.array().cast("array<string>")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, end exclusive, by kind as in KINDS, then start.

    base holds the pattern matches that always stand, spans those and the candidates that the classifier accepts at
    threshold. Null and empty texts have no spans; texts of any length are read whole, in linear time; repeated rows give
    repeated results; null ids stay null; an empty table gives no rows; other columns are not read. Votes are counted over all rows.
    """
    scanned = materialize(spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("doc_id", _spans("text").alias("found")), "spans")
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    ordered = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda c: F.struct(rank[c["kind"]].alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
    )
    spans = _accepted(F.col("found"), _classifier(scanned, "found", threshold))
    return scanned.select("doc_id", ordered(F.filter("found", lambda c: c["base"])).alias("base"), ordered(spans).alias("spans"))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and text form of find()'s result."""
    text = lambda col: F.array_join(F.transform(col, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


@F.pandas_udf(StringType())
def _mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Spans come as start:end:kind, joined by commas."""
    split = lambda x: [(int(s), int(e), kind) for s, e, kind in (y.split(":") for y in x.split(","))]
    return pd.Series([masked(t, split(x)) for t, x in zip(texts, spans, strict=True)])


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with each span replaced by [EMAIL], [IP], [CARD] or [PHONE] in text_col; all other columns as they are.

    Rows are written once with their spans, so that no text is searched twice or shuffled; only rows that hold a span pass
    through Python again. A null text stays null and an empty one empty; repeated rows are redacted alike; an empty table
    stays empty. Where spans overlap, they become one mark, of the kind that starts first.
    """
    columns = docs.columns
    found, take = fresh(columns, "found"), fresh(columns, "take")
    scanned = materialize(spread(docs).withColumn(found, _spans(F.col(f"`{text_col}`").cast("string"))), "spans")
    yes = _classifier(scanned, found, threshold)
    marked = scanned.withColumn(take, _accepted(F.col(found), yes))
    clean = marked.where(F.size(take) == 0).select(*[F.col(f"`{c}`") for c in columns])
    spans = F.array_join(F.transform(F.col(take), lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"), c["kind"])), ",")
    held = marked.where(F.size(take) > 0).withColumn(text_col, _mask(F.col(f"`{text_col}`").cast("string"), spans))
    return clean.unionByName(held.select(*[F.col(f"`{c}`") for c in columns]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with (start, end, kind) spans replaced by marks."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def span_sha(spans: list[tuple[str, int, int]]) -> str:
    return sha256(span_text(spans).encode()).hexdigest()
