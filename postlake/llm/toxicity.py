"""Toxicity scores from a learned lexicon, matched by a Levenshtein automaton over a trie, with context windows.

fit() learns from a bounded sample of labelled rows: which word forms and stems mark toxic texts, which harmless words
lie within one edit of them, and a logistic model over what the matcher finds. score() reads every whole text once,
without a shuffle; all it sends to the executors is the lexicon.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, materialize, spread

#: Labelled rows per class that fit() reads at most (those with the smallest hash of their id).
SAMPLE_PER_CLASS = 4000
#: A term is kept if it is in so many toxic sample texts, and is this much rarer (as a share) in the others.
MIN_TEXTS, MIN_SHARE, PURITY = 5, 0.004, 0.02
#: ... and if so many toxic among its texts would be a chance less than one in this, by Chernoff's bound (some million forms are tried).
CHANCE = 1e8
STEM = range(4, 9)
#: A form within one edit of a term is harmless if its share of clean texts is more than this part of its share of toxic ones.
ALIKE = 0.2
#: Words of these lengths or longer may have one edit (insertion, deletion, substitution, swap of neighbours).
EDIT_LENGTH = 5
WINDOW = 60
#: What a match with an edit counts; one in quotation or under report or denial is counted apart, and the model learns what it tells.
EDITED = 0.7
# Words that report or deny, in the four languages of the tables.
REPORTS = frozenset("said says called quoted wrote reported not never no sagte nannte zitierte nicht kein nie dijo llamó citó escribió nunca dit appelé cité écrit pas jamais".split())
# Digits that are written for letters.
FIGURES = str.maketrans("01345789", "oieastbg")
WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile("[\"'«»“”„‚‘’‹›]|\n[ \t\r]*\n")


def words_of(text: str | None) -> list[str]:
    """The words of letters in a text, in lower case."""
    return LETTERS.findall(text.lower()) if text else []


def quoted(text: str) -> list[tuple[int, int]]:
    """What stands between quotation marks of one kind within a paragraph, as disjoint (start, end) in order; in one pass.

    Straight marks open and close in turn; „ “ and ‚ ‘ take what opened before into account; « » and ‹ › go either way. Apostrophes
    within words are none; a single mark opens before a word and closes after one.
    """
    out, opened = [], {}
    for m in _MARKS.finditer(text):
        c, at = m[0], m.start()
        if c[0] == "\n":
            opened.clear()
            continue
        before, after = text[at - 1 : at].isalnum(), text[at + 1 : at + 2].isalnum()
        if c in "'’" and before and after:
            continue
        kind = "single" if c in "'" else "low single" if c in "‚‘’" else "double" if c == '"' else "low" if c in "„“”" else "angle" if c in "«»" else "point"
        start = opened.get(kind)
        if start is None:
            if c not in "”’" and (kind != "single" or after and not before):
                opened[kind] = at, c
        elif c == "'" and after:
            opened[kind] = at, c
        elif kind in ("single", "double") or c != start[1]:
            out.append((start[0], at))
            del opened[kind]
        else:
            opened[kind] = at, c
    whole: list[tuple[int, int]] = []
    for start, end in sorted(out):  # those of different kinds may lie in one another
        if whole and start <= whole[-1][1]:
            whole[-1] = whole[-1][0], max(end, whole[-1][1])
        else:
            whole.append((start, end))
    return whole


@dataclass
class Model:
    """terms: (text, whole word?); lookalikes: harmless words within one edit; weights: of the logistic model; trust: of edits of a term, 1 if not named."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    lookalikes: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0, 0.0)
    trust: dict[str, float] = field(default_factory=dict)


class Matcher:
    """Finds lexicon terms in words: stems and whole words by walking a trie, edits by a Levenshtein automaton on it."""

    def __init__(self, terms: list[tuple[str, bool]], lookalikes: frozenset[str] = frozenset()):
        self.lookalikes = lookalikes
        self.root: dict = {}
        self.gates: set[tuple] = set()
        self.head_sizes: tuple[int, ...] = ()
        self.stem_gates: set[tuple[int, str]] = set()
        sizes, spans = set(), set()
        for term, whole in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node["whole" if whole else "stem"] = term
            if whole and len(term) >= EDIT_LENGTH:
                # One edit leaves this many characters at the head or at the tail as they are.
                h = max(2, (len(term) - 2) // 2)
                sizes.add(h)
                for n in range(len(term) - 1, len(term) + 2):
                    self.gates |= {(h, n, term[:h]), (-h, n, term[-h:])}
            elif not whole and len(term) >= EDIT_LENGTH:
                # The edit is after the first half, or swaps letters across its end, or leaves the rest as it is, a place moved at most.
                h = (len(term) + 1) // 2
                own = [(0, term[:h]), (0, term[: h - 1] + term[h] + term[h - 1]), *((k, term[h:]) for k in range(h - 1, h + 2))]
                self.stem_gates |= set(own)
                spans |= {(k, k + len(part)) for k, part in own}
        self.head_sizes, self.stem_spans = tuple(sorted(sizes)), tuple(sorted(spans))

    def exact(self, word: str) -> str | None:
        """The whole-word term that the word is, or the stem that it begins with (a stem needs an ending)."""
        node = self.root
        for c in word:
            if "stem" in node:
                return node["stem"]
            node = node.get(c)
            if node is None:
                return None
        return node.get("whole")

    def misspelt(self, word: str) -> str | None:
        """A whole-word term at one edit, or a stem at one edit of a beginning of the word; None for known look-alikes."""
        if word in self.lookalikes:
            return None
        n = len(word)
        whole = any((h, n, word[:h]) in self.gates or (-h, n, word[-h:]) in self.gates for h in self.head_sizes)
        if not whole and not any((i, word[i:j]) in self.stem_gates for i, j in self.stem_spans):
            return None

        def ends(node: dict, row: tuple[int, ...]) -> str | None:
            if row[n] <= 1 and len(node.get("whole", "")) >= EDIT_LENGTH:
                return node["whole"]
            if len(node.get("stem", "")) >= EDIT_LENGTH and min(row[:n]) <= 1:  # a stem needs an ending
                return node["stem"]
            return None

        return self._walk(word, ends)

    def _walk(self, word: str, ends: Callable[[dict, tuple[int, ...]], str | None]) -> str | None:
        """What ends() finds first at a node of the trie that the automaton reaches."""
        n = len(word)
        # States of the automaton are the rows of edit distances over prefixes of the word; rows above 1 everywhere die.
        stack = [(self.root, tuple(min(i, 2) for i in range(n + 1)), None, "", None)]
        while stack:
            node, row, before, last, _ = stack.pop()
            if found := ends(node, row):
                return found
            for c, child in node.items():
                if len(c) != 1:
                    continue
                new = [min(row[0] + 1, 2)]
                for i in range(1, n + 1):
                    v = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (word[i - 1] != c))
                    if before is not None and i > 1 and word[i - 1] == last and word[i - 2] == c:
                        v = min(v, before[i - 2] + 1)
                    new.append(min(v, 2))
                if min(new) <= 1:
                    stack.append((child, tuple(new), row, c, None))
        return None


class Scanner:
    """Per-worker state: words already looked up, so that each distinct word is matched once."""

    LIMIT = 150_000

    def __init__(self, model: Model):
        self.matcher, self.trust = Matcher(model.terms, model.lookalikes), model.trust
        self.seen: set[str] = set()
        self.hits: dict[str, float] = {}

    def _learn(self, own: set[str]) -> None:
        """Look up a text's words that are new; when too many are held, forget all but this text's."""
        if len(self.seen) > self.LIMIT:
            self.seen, self.hits = set(), {}
        words = own - self.seen
        self.seen |= words
        for w in words:
            hit = self._weigh(w) if w.isalpha() else self._weigh_figures(w)
            if hit:
                self.hits[w] = hit

    def _weigh(self, word: str) -> float:
        if self.matcher.exact(word):
            return 1.0
        term = self.matcher.misspelt(word)
        return EDITED * self.trust.get(term, 1.0) if term else 0.0

    def _weigh_figures(self, word: str) -> float:
        """A word with figures: its runs of letters as words, or the whole with figures read as letters, as an edit."""
        term = self.matcher.exact(word.translate(FIGURES))
        return max([EDITED * self.trust.get(term, 1.0) if term else 0.0, *map(self._weigh, LETTERS.findall(word))])

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Directed weight, quoted weight, directed weight per 100 words."""
        low = (text or "").lower()
        words = WORD.findall(low)
        own = set(words)
        if not own <= self.seen:
            self._learn(own)
        found = own & self.hits.keys()
        if not found:
            return 0.0, 0.0, 0.0
        directed = apart = 0.0
        spans = quoted(low)
        ends = [e for _, e in spans]
        for m in WORD.finditer(low):
            if m[0] not in found:
                continue
            weight, left = self.hits[m[0]], low[max(0, m.start() - WINDOW) : m.start()]
            k = bisect_right(ends, m.start())
            held = k < len(spans) and spans[k][0] < m.start()
            if held or not REPORTS.isdisjoint(WORD.findall(left)[-3:]):
                apart += weight
            else:
                directed += weight
        return directed, apart, 100 * directed / len(words)


def design(f: np.ndarray) -> np.ndarray:
    """Intercept; how much was found directed and quoted; how dense; whether anything was found at all."""
    found = np.minimum(f[:, 0] + f[:, 1], 1)
    return np.column_stack([np.ones(len(f)), np.log1p(f[:, 0]), np.log1p(f[:, 1]), np.log1p(f[:, 2]), found])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.002, steps: int = 40) -> np.ndarray:
    """Newton steps with a ridge; more of any kind of evidence never lowers the score."""
    w = np.zeros(x.shape[1])
    penalty = ridge * len(y) * np.diag([0.02] + [1.0] * (x.shape[1] - 1)) / 10
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + penalty
        w = w - np.linalg.solve(h, x.T @ (p - y) + penalty @ w)
    w[1:] = np.maximum(w[1:], 0)
    return w


def _signatures(words: list[str]) -> list[int]:
    """Three min-hashes over three-word shingles: near copies share one of them almost surely."""
    grams = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in (1, 2, 3)]


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(d, t, *_signatures(words_of(x))) for d, t, x in zip(pdf["doc_id"], pdf["toxic"], pdf["text"], strict=True)], columns=["doc_id", "toxic", "s1", "s2", "s3"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that hold a word with this stem and an ending, or (with a final $) this whole word; summed here before the shuffle."""
    for pdf in batches:
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
            own = set(words_of(text))
            n[int(toxic)].update({w[:k] for w in own for k in STEM if k < len(w)} | {w + "$" for w in own if len(w) >= 3})
        both = list(n[0].keys() | n[1].keys())
        yield pd.DataFrame({"form": both, "pos": [n[1][w] for w in both], "neg": [n[0][w] for w in both]})


def _is_chance(pos: int, neg: int, rate: float) -> bool:
    n, share = pos + neg, pos / (pos + neg)
    if share <= rate:
        return True
    far = share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0)
    return n * far < math.log(CHANCE)


def choose_terms(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> list[tuple[str, bool]]:
    """The shortest pure stems, each grown while it loses no texts; whole words where no stem is pure."""
    pos = {w: p for w, p, n in counts if p >= max(MIN_TEXTS, MIN_SHARE * n_pos) and n * max(n_pos, 1) <= PURITY * p * max(n_neg, 1) and not _is_chance(p, n, n_pos / max(n_pos + n_neg, 1))}
    ranked, names, taken, out = sorted(pos, key=lambda w: (len(w.rstrip("$")), w)), sorted(pos), set(), []
    for w in ranked:
        bare = w.rstrip("$")
        if any(bare[:k] in taken for k in STEM if k < len(bare) + (w == bare)) or w in taken:
            continue
        grown = w
        while not grown.endswith("$"):
            begin_so = names[bisect_left(names, grown) : bisect_left(names, grown + "\U0010ffff")]
            longer = [x for x in begin_so if x != grown and (x.endswith("$") or len(x) == len(grown) + 1) and pos[x] >= 0.98 * pos[w]]
            if not longer:
                break
            grown = max(longer, key=lambda x: (x.endswith("$"), pos[x], x))
        taken |= {w, grown}
        out.append((grown.rstrip("$"), grown.endswith("$"), pos[w]))
    out.sort(key=lambda x: (-x[2], x[0]))
    return [(t, whole) for t, whole, _ in out]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out_fold: int = 0) -> Model:
    """Learn from at most SAMPLE_PER_CLASS labelled rows of either class whose crc32(id) mod folds is not held_out_fold.

    Labels other than 0 and 1 and null ids are ignored; an id labelled twice counts as toxic if either label is 1. The
    corpus is read once, for the texts of the sample (its ids, a bounded list, are broadcast). All terms and look-alikes that
    the sample shows are kept. With one class only, or
    none, the model has no terms and scores every text as clean.
    """
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    y = y.where(crc_bucket("doc_id", folds) != held_out_fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = materialize(y.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))), "toxic-labels")
    size = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    # Thinned by the same hash first, so that the choice is among a few times what is taken, whatever the size of a class.
    near = {c: 4.0 * SAMPLE_PER_CLASS * (1 << 40) / max(size.get(c, 0), 1) for c in (0, 1)}
    ids = [y.where((F.col("toxic") == c) & (F.col("h") <= near[c])).orderBy("h", "doc_id").limit(SAMPLE_PER_CLASS).drop("h") for c in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    sample = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").dropDuplicates(["doc_id"])
    sample = materialize(sample, "toxic-sample").repartition(max(4, spark.sparkContext.defaultParallelism), "doc_id")

    # Near copies count once, or the chance words of a much-copied text would look like terms.
    seen: set[tuple[int, int]] = set()
    kept = []
    for r in sorted(sample.mapInPandas(_sign, "doc_id long, toxic int, s1 long, s2 long, s3 long").collect()):
        own = {(k, s) for k, s in enumerate(r[2:])}
        if own.isdisjoint(seen):
            kept.append((r["doc_id"], r["toxic"]))
        seen |= own
    n_pos = sum(t for _, t in kept)
    if not n_pos or n_pos == len(kept):
        return Model()
    once = sample.drop("toxic").join(F.broadcast(spark.createDataFrame(kept, "doc_id long, toxic int")), "doc_id")
    counts = once.select("toxic", "text").mapInPandas(_count, "form string, pos long, neg long").groupBy("form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    least = max(MIN_TEXTS, math.ceil(MIN_SHARE * n_pos))
    rows = counts.where((F.col("pos") >= least) & (F.col("neg") * n_pos <= PURITY * (len(kept) - n_pos) * F.col("pos"))).collect()  # bounded by the sample
    terms = choose_terms([tuple(r) for r in rows], n_pos, len(kept) - n_pos)

    bare = Matcher(terms)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, close = (Counter(), Counter()), {}
            for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
                for w in set(words_of(text)):
                    if w not in close:
                        close[w] = None if bare.exact(w) else bare.misspelt(w)
                    if close[w]:
                        n[int(toxic)][w] += 1
            rows = [(w, close[w], n[1][w], n[0][w]) for w in n[0].keys() | n[1].keys()]
            yield pd.DataFrame(rows, columns=["form", "term", "pos", "neg"]).astype({"form": str, "term": str, "pos": "int64", "neg": "int64"})

    # A form in few clean texts beside many toxic ones is quoted or mislabelled there, not harmless.
    n_neg = len(kept) - n_pos
    forms = once.select("toxic", "text").mapInPandas(near, "form string, term string, pos long, neg long").groupBy("form", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    forms = materialize(forms, "toxic-forms")
    alike = forms.where((F.col("neg") > 0) & (F.col("neg") * n_pos > ALIKE * n_neg * F.col("pos"))).collect()  # bounded by the sample
    # Where harmless words crowd around a term, one that the sample lacks is likely harmless too: its edits count by their toxic part.
    part = {r["term"]: ((r["pos"] + 1) / n_pos, r["neg"] / n_neg) for r in forms.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}
    model = Model(terms, frozenset(r["form"] for r in alike), trust={t: p / (p + n) for t, (p, n) in part.items()})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner(model)
        for pdf in batches:
            yield pd.DataFrame([(int(t), *scan.features(x)) for t, x in zip(pdf["toxic"], pdf["text"], strict=True)], columns=["toxic", "a", "b", "c"])

    got = np.array([tuple(r) for r in once.select("toxic", "text").mapInPandas(measure, "toxic int, a double, b double, c double").collect()], float)
    w = _logistic(design(got[:, 1:]), got[:, 0])
    return Model(terms, model.lookalikes, tuple(float(v) for v in w), model.trust)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted, n_directed, n_quoted) per row, and the columns named in keep.

    Null and empty texts, and texts without a term, have the model's base score (below one half). Repeated rows give
    repeated results; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    weights = np.array(model.weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner(model)
        for pdf in batches:
            f = np.array([scan.features(t) for t in pdf["_text"]], float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(design(f) @ weights, -30, 30)))
            out = pdf.drop(columns="_text")
            yield out.assign(score=p, predicted=(p >= 0.5).astype("int32"), n_directed=f[:, 0], n_quoted=f[:, 1])

    rest = [c for c in keep if c != id_col]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), *rest, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("_text").schema)
    return spread(own).mapInPandas(run, f"{kinds}, score double, predicted int, n_directed double, n_quoted double")
