"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most two bits have a segment in
which they differ in at most one, so it is enough to index, for each segment, its exact value and its 32 variants with
one bit taken out, and to join equal keys. On a variant key only rows whose taken-out bit is 0 meet those with 1, so
each pair with a differing segment bit meets once, and pairs with an equal segment meet on the exact key only.

Work is on distinct fingerprints. A key with many of them is not paired at all: its rows are cut again by
variants of the other segment (one bit taken out on variant keys, two on exact keys). Rows that agree on both cuts differ
in at most two bits by construction and are at most four, so the expansion stays linear in the rows.

A key has 31 or 32 bits, so from about 2^31 distinct fingerprints on most keys are shared by chance and most rows are kept for
the second cut; that stays exact and linear, with up to 496 variants of a row's other segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, spread
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
#: Keys with more distinct fingerprints than this are cut again instead of paired (an exact way, not a cap).
PAIR_LIMIT = 48
#: Shared keys are sent to all tasks up to so many (16 bytes each), and joined by shuffle beyond.
BROADCAST_KEYS = 500_000
#: A fingerprint is hot if it holds more than this part of all rows (so there are fewer hot ones than its inverse).
HOT = 1 / 2000
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of whole UTF-8 text; 0 for null or a text without words."""
    words = text.lower().split() if text else []  # bytes.lower() and bytes.split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < n:
        spans_from, spans_to = [0], [len(joined)]
    else:
        spans_from, spans_to = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    hash64, total = xxhash.xxh64_intdigest, len(spans_from)
    ones = np.zeros(64, np.int64)
    for k in range(0, total, _CHUNK):
        h = [hash64(joined[i:j], SEED) for i, j in zip(spans_from[k : k + _CHUNK], spans_to[k : k + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = np.array([fingerprint(t) for t in pdf["_text"]], np.uint64).astype(np.int64)
        yield pdf.drop(columns="_text").assign(fp=fp)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed 64-bit number; and rank, a long, if order_col is named."""
    rank = [F.col(order_col).cast("long").alias("rank")] if order_col else []
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), *rank, F.col(text_col).cast("binary").alias("_text"))
    return spread(own).mapInPandas(_fingerprints, f"doc_id long, {'rank long, ' if rank else ''}fp long")


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _segment(fp: Column, s: int) -> Column:
    return _low(fp) if s == 0 else F.shiftrightunsigned(fp, 32)


def _segment_keys(s: int) -> Column:
    """Array of (key, s, i, bit) of one segment: the exact key (i = 32, bit = 2) and its one-bit variants."""
    seg = _segment(F.col("fp"), s)

    def entry(value: Column, i: int, bit: Column) -> Column:
        return F.struct((value + F.lit((i * 2 + s) << 32)).alias("key"), F.lit(s).alias("s"), F.lit(i).alias("i"), bit.alias("bit"))

    cut = [entry(seg.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))), i, F.shiftright(seg, i).bitwiseAND(F.lit(1)).cast("int")) for i in range(32)]
    return F.array(entry(seg, 32, F.lit(2)), *cut)


def _keys(nodes: DataFrame) -> DataFrame:
    """(node, fp, key, s, i, bit) of both segments."""
    v = nodes.select("node", "fp", F.explode(F.concat(_segment_keys(0), _segment_keys(1))).alias("k"))
    return v.select("node", "fp", "k.key", "k.s", "k.i", "k.bit")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints (node, fp) that join all that differ in at most two bits.

    Small keys give every such pair; large keys give a star for each set that agrees on all but two bits, which joins
    the same components.
    """
    # Keys are counted with sums made before the shuffle, so that no key needs to meet in one task; few are shared.
    nodes = nodes.repartition(shuffle_width(nodes.sparkSession))
    counts = materialize(_keys(nodes).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    send = F.broadcast(counts) if counts.count() <= BROADCAST_KEYS else counts
    sized = materialize(_keys(nodes).join(send, "key"), "sharing-rows")
    small = sized.where(F.col("n") <= PAIR_LIMIT)
    x, y = small.alias("x"), small.alias("y")  # one narrow table, joined with itself on the key
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & F.when(F.col("x.i") == 32, F.col("x.fp") < F.col("y.fp")).otherwise((F.col("x.bit") == 0) & (F.col("y.bit") == 1))
        & (F.bit_count(differ) <= 2),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    # Large keys: cut the other segment too.
    other = F.when(F.col("s") == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    full = 0xFFFFFFFF
    one = [full] + [full ^ (1 << j) for j in range(32)]
    two = [full ^ (1 << j) ^ (1 << k) for j, k in combinations(range(32), 2)]
    masks = F.when(F.col("i") == 32, F.array(*map(F.lit, two))).otherwise(F.array(*map(F.lit, one)))
    cut = sized.where(F.col("n") > PAIR_LIMIT).withColumn("mask", F.explode(masks)).select("node", "key", "mask", other.bitwiseAND(F.col("mask")).alias("rest"))
    stars = cut.groupBy("key", "mask", "rest").agg(F.collect_list("node").alias("g")).where(F.size("g") > 1)
    stars = stars.select(F.array_min("g").alias("a"), F.explode("g").alias("b")).where("a != b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies) for every row; and rank, the column named by order_col, if one is.

    doc_id: the id as long. fingerprint: 16 hex digits. component_id: the smallest doc_id reachable over links of at most
    two differing bits. n_copies: rows with the same fingerprint. Null and empty texts have fingerprint zero and are
    linked like any other; rows with a null id take part and keep their null id; repeated rows are kept; an empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, order_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_copies"))
    classes = materialize(classes, "classes")
    comp = connected_components(links(classes.select(F.col("fp").alias("node"), "fp"))).withColumnRenamed("node", "fp")
    # Components are made of fingerprints, so that a text whose rows have no id links others too; then they are named by their smallest id.
    linked = materialize(classes.join(comp, "fp"), "linked")
    named = linked.groupBy("component").agg(F.min("node").alias("name"))
    alone = classes.join(comp, "fp", "left_anti").select("fp", "n_copies", F.col("node").alias("component_id"))
    whole = materialize(alone.unionByName(linked.join(named, "component").select("fp", "n_copies", F.col("name").alias("component_id"))), "components")
    # Rows of hot fingerprints meet their class in place, all others by shuffle.
    least = HOT * (whole.agg(F.sum("n_copies")).first()[0] or 0)
    hot = F.broadcast(whole.where(F.col("n_copies") > least))
    rest = fps.join(hot, "fp", "left_anti").join(whole.where(F.col("n_copies") <= least), "fp")
    return fps.join(hot, "fp").unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies", *(["rank"] if order_col else []))
