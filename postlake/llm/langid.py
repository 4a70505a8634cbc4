"""Language identification with string kernels.

Texts are compared by a blended-spectrum presence kernel: the share of character n-grams (one to four) that both hold, normalised by
their numbers. N-grams are told apart by a hash of 18 bits, so a text's spectrum is a set of at most 2^18 slots. Nyström
landmarks (training texts, some of each language) span the feature space; one-versus-rest kernel ridge regression is
solved on them from sums that the executors make. A batch of texts is scored by two matrix products: presence by landmarks
(n-grams that no landmark holds add nothing to it, and count in the norm), then by the weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_bucket, materialize, spread

#: Training texts per language at most (those with the smallest hash of their id).
SAMPLE_PER_LANGUAGE = 400
#: Landmarks of a language: so many, or fewer (two at least) where languages are so many that all would be more than LANDMARKS.
LANDMARKS_PER_LANGUAGE, LANDMARKS = 24, 1200
#: Language tables are broadcast up to so many languages, and joined by shuffle beyond.
BROADCAST_LANGUAGES = 500
ORDERS = (1, 2, 3, 4)
_SLOTS = 1 << 18
RIDGE = 1e-2
_CHUNK, _BATCH = 1 << 20, 128
UNKNOWN = "und"


def slots(text: str) -> np.ndarray:
    """Sorted hash slots of the character n-grams of a whole text, in lower case, white space and digits folded."""
    low = text.lower()
    seen = np.zeros(_SLOTS, bool)
    for at in range(0, max(len(low), 1), _CHUNK):
        part = " " + low[max(0, at - max(ORDERS) + 1) if at else 0 : at + _CHUNK] + " "
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        c[(c >= 48) & (c <= 57)] = 48
        c[(c == 10) | (c == 9) | (c == 13)] = 32
        h = np.zeros(len(c), np.uint64)
        for n in ORDERS:
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
            seen[((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:256])) or any(map(str.isalpha, text[256:]))


@dataclass
class Model:
    """Languages; landmarks as slot arrays; weights: one row per landmark and one for the intercept, one column per language."""

    langs: list[str]
    landmarks: list[np.ndarray]
    weights: np.ndarray

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot to row (-1: in no landmark), rows of presence by landmark, square roots of the landmarks' sizes."""
        row = np.full(_SLOTS, -1, np.int32)
        held = np.unique(np.concatenate(self.landmarks)) if self.landmarks else np.empty(0, np.int64)
        row[held] = np.arange(len(held))
        presence = np.zeros((len(held) + 1, len(self.landmarks)), np.float32)
        for k, own in enumerate(self.landmarks):
            presence[row[own], k] = 1
        return row, presence, np.sqrt([max(len(own), 1) for own in self.landmarks])

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (slot arrays) with all landmarks, in batches of bounded size."""
        row, presence, other = self._table
        out = np.zeros((len(texts), len(self.landmarks)))
        x = np.zeros((min(len(texts), _BATCH), len(presence)), np.float32)
        for a in range(0, len(texts), _BATCH):
            batch = texts[a : a + _BATCH]
            x[:] = 0
            for k, own in enumerate(batch):
                x[k, row[own]] = 1  # row -1, the last, is no landmark's: its presence is zero
            size = np.sqrt([max(len(own), 1) for own in batch])
            out[a : a + len(batch)] = (x[: len(batch)] @ presence) / size[:, None] / other[None, :]
        return out

    def features(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([self.kernel(texts), np.ones(len(texts))])

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and a score from 0 to 1 (softmax of the regressions, sharpened)."""
        f = self.features([slots(t) for t in texts]) @ self.weights
        e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
        p = e / e.sum(axis=1, keepdims=True)
        best = f.argmax(axis=1)
        return best, p[np.arange(len(best)), best]

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_table"}  # made anew where it is used


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "size": [len(slots(t)) for t in pdf["text"]]})


def _slot_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "slots": [slots(t).astype("<u4").tobytes() for t in pdf["text"]]})


def choose_landmarks(rows: list[tuple[str, int, int]]) -> list[tuple[str, int]]:
    """(lang, doc_id) of the landmarks among (lang, doc_id, size): of each language some of all sizes, by even steps."""
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for lang, doc_id, size in rows:
        by_lang.setdefault(lang, []).append((-size, doc_id))
    each = max(2, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // max(len(by_lang), 1)))
    out = []
    for lang, own in sorted(by_lang.items()):
        own.sort()
        out += [(lang, own[k][1]) for k in np.unique(np.linspace(0, len(own) - 1, min(len(own), each)).astype(int))]
    return out


def solve(langs: list[str], landmarks: list[np.ndarray], gram: np.ndarray, target: np.ndarray) -> Model:
    """Ridge weights from the sums of weighted K'K and K'Y over the training texts; the penalty is the landmarks' own kernel."""
    model = Model(langs, landmarks, np.zeros((len(landmarks) + 1, len(langs))))
    m = model.kernel(landmarks)
    penalty = np.zeros_like(gram)
    penalty[:-1, :-1] = m + 1e-6 * np.eye(len(landmarks))
    model.weights = np.linalg.solve(gram + RIDGE * penalty + 1e-8 * np.eye(len(gram)), target)
    return model


def sums(model: Model, at: list[int], texts: list[np.ndarray], weight: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted K'K and K'Y of texts whose languages are at these places."""
    k, w = model.features(texts), np.array(weight)[:, None]
    y = 2.0 * (np.array(at)[:, None] == np.arange(len(model.langs))[None, :]) - 1
    return k.T @ (k * w), k.T @ (y * w)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out_fold: int = 1) -> Model | None:
    """Learn from at most SAMPLE_PER_LANGUAGE rows of each non-null language whose crc32(id) mod folds is not held_out_fold.

    None if no such row has a text. Every language that occurs is learned. Rows are chosen by id and language alone, then their texts are read; the
    driver gets their sizes, the n-gram slots of the landmarks, and one pair of summed matrices per task.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ok = base.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", folds) != held_out_fold))
    known = materialize(ok.groupBy("lang").count(), "languages")
    few = known.count() <= BROADCAST_LANGUAGES
    send = F.broadcast if few else lambda df: df
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    # A language's rows are thinned by the same hash before they meet in one task, to a few times what is taken.
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = F.col("h") <= F.lit(4.0 * SAMPLE_PER_LANGUAGE * (1 << 40)) / F.col("count")
    ids = ok.select("doc_id", "lang", h.alias("h")).join(send(known), "lang").where(near).withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_PER_LANGUAGE)
    ids = materialize(ids.select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct(), "lang-sample")
    sample = ok.join(send(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l"))).where("length(text) > 0")
    sample = materialize(sample.dropDuplicates(["doc_id", "lang"]).select("doc_id", "lang", "text"), "lang-texts").repartition(max(2, spark.sparkContext.defaultParallelism), "doc_id")
    rows = [(r["lang"], r["doc_id"], r["size"]) for r in sample.mapInPandas(_sizes, "doc_id long, lang string, size long").collect()]
    if not rows:
        return None
    marks = choose_landmarks(rows)
    wanted = spark.createDataFrame([(d, x) for x, d in marks], "doc_id long, lang string")
    got = {(r["lang"], r["doc_id"]): np.frombuffer(r["slots"], "<u4") for r in sample.join(F.broadcast(wanted), ["doc_id", "lang"]).mapInPandas(_slot_rows, "doc_id long, lang string, slots binary").collect()}
    n = Counter(lang for lang, _, _ in rows)
    langs, landmarks = sorted(n), [got[m] for m in marks]
    bare = spark.sparkContext.broadcast((Model(langs, landmarks, np.empty(0)), {lang: (k, 1 / n[lang]) for k, lang in enumerate(langs)}))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, place = bare.value
        size = len(model.landmarks) + 1
        gram, target = np.zeros((size, size)), np.zeros((size, len(model.langs)))
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                g, t = sums(model, [place[x][0] for x in part["lang"]], [slots(t) for t in part["text"]], [place[x][1] for x in part["lang"]])
                gram, target = gram + g, target + t
        yield pd.DataFrame({"gram": [gram.tobytes()], "target": [target.tobytes()]})

    size = len(landmarks) + 1
    gram, target = np.zeros((size, size)), np.zeros((size, len(langs)))
    for r in sample.mapInPandas(add, "gram binary, target binary").toLocalIterator():
        gram += np.frombuffer(r["gram"]).reshape(gram.shape)
        target += np.frombuffer(r["target"]).reshape(target.shape)
    return solve(langs, landmarks, gram, target)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row, from the whole text alone.

    Null texts, texts without a letter, and all texts without a model: und with score 0. Repeated rows give repeated results;
    null ids stay null; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                pdf = whole.iloc[at : at + 512]
                lang, score = np.full(len(pdf), UNKNOWN, object), np.zeros(len(pdf))
                at_text = [k for k, t in enumerate(pdf["text"]) if model is not None and t and has_letter(t)]
                if at_text:
                    best, p = model.predict([pdf["text"].iloc[k] for k in at_text])
                    lang[at_text], score[at_text] = np.array(model.langs, object)[best], p
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "lang_pred": lang, "score": score.astype(float)})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(own).mapInPandas(run, "doc_id long, lang_pred string, score double")
