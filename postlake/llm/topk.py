"""Exact top-k inner products with norm-bucketed retrieval.

Vectors are grouped into buckets of similar length, longest first. A query that already has k results of score t or more
needs from a bucket of length up to l only vectors whose cosine with it reaches t / (|q| l): if that exceeds 1 the
bucket is skipped whole, if it is high, coordinates prune (a candidate must have a like value in the query's largest
coordinates), else length alone prunes. What is left is verified with exact integer products.

Queries are a stated set; they meet the candidates in blocks of bounded size, so no task and no broadcast grows with
either side. A first pass over the block of the longest vectors gives each query its starting t. Then queries are put in
order of how far down the buckets they can still reach, so a block of queries is sent only to the blocks of candidates
that one of them can reach, and a block of candidates only to the queries that can reach it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K = 20
SCALE = 64
#: Rows of a candidate block and of a query block at most; smaller blocks are made to give all cores work, but not below SMALL.
BLOCK, QUERY_BLOCK, SMALL = 8192, 2048, 512
#: Neighbouring length buckets differ by this factor.
RATIO = 1.05
#: Coordinates that prune, and the local threshold from which they do.
FOCUS, COORDINATES_FROM = 4, 0.6
#: Products of integers stay exact in a double up to here.
EXACT = 2.0**53


def quantised(x: Column) -> Column:
    """floor(64 * x) of each component as doubles; null for a null vector or one with a null or non-finite component."""
    wide = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(x.isNotNull() & fine, wide)


def top_of_block(q: np.ndarray, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, q_rows: np.ndarray, least: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of up to k best candidates per query scoring at least its threshold.

    ids break ties; rows and q_rows tell which candidate is the query itself.
    """
    qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    order = np.argsort(-vn, kind="stable")
    v, ids, rows, vn = v[order], ids[order], rows[order], vn[order]
    cuts = [0]
    while cuts[-1] < len(v):
        floor_norm = vn[cuts[-1]] / RATIO
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(-vn, -floor_norm, side="right"))))
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1) >= EXACT:
        return _wide(q, v, ids, rows, q_rows, least, order, k)
    least = least.copy()
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in q]
    for a, b in zip(cuts, cuts[1:], strict=False):
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(qn * vn[a] > 0, least / (qn * vn[a]), np.where(least > 0, np.inf, -np.inf))
        live = np.flatnonzero(local <= 1 + 1e-9)
        sharp = live[local[live] >= COORDINATES_FROM] if b - a > 64 else live[:0]
        for i in sharp.tolist():
            # |qf.vf| <= |rest of q| |rest of v| + ..., so a candidate must reach t on the focus coordinates alone up to that rest.
            f = np.argpartition(-np.abs(q[i]), min(FOCUS, q.shape[1]) - 1)[:FOCUS]
            part = v[a:b][:, f]
            rest = np.sqrt(np.maximum(qn[i] ** 2 - (q[i, f] ** 2).sum(), 0) * np.maximum(vn[a:b] ** 2 - (part * part).sum(axis=1), 0))
            may = np.flatnonzero(part @ q[i, f] + rest * (1 + 1e-9) + 1e-6 >= least[i])
            _take(parts, least, i, a + may, v[a + may] @ q[i], ids, rows, q_rows, k)
        plain = np.setdiff1d(live, sharp, assume_unique=True)
        if len(plain):
            s = q[plain] @ v[a:b].T
            for r, i in enumerate(plain.tolist()):
                _take(parts, least, i, np.arange(a, b), s[r], ids, rows, q_rows, k)
    qi, vi, sc = [], [], []
    for i, own in enumerate(parts):
        if not own:
            continue
        at, s = np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
        best = np.lexsort((ids[at], -s))[:k]
        qi.append(np.full(len(best), i))
        vi.append(order[at[best]])
        sc.append(s[best])
    if not qi:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(qi), np.concatenate(vi), np.concatenate(sc)


def _take(parts, least, i, at, s, ids, rows, q_rows, k) -> None:
    keep = (s >= least[i]) & (rows[at] != q_rows[i])
    if not keep.any():
        return
    at, s = at[keep], s[keep]
    if len(s) > k:  # only k of a bucket can count
        cut = np.partition(s, len(s) - k)[len(s) - k]
        at, s = at[s >= cut], s[s >= cut]
        best = np.lexsort((ids[at], -s))[:k]
        at, s = at[best], s[best]
    parts[i].append((at, s))
    have = np.concatenate([x for _, x in parts[i]])
    if len(have) >= k:
        least[i] = max(least[i], np.partition(have, len(have) - k)[len(have) - k])


def _wide(q, v, ids, rows, q_rows, least, order, k):
    """The same without pruning, in Python integers, where products exceed what a double holds exactly."""
    qi, vi, sc = [], [], []
    whole = [[int(x) for x in row] for row in v]
    for i, row in enumerate(q):
        own = [int(x) for x in row]
        s = [(-sum(map(int.__mul__, own, w)), int(ids[j]), j) for j, w in enumerate(whole) if rows[j] != q_rows[i]]
        for neg, _, j in sorted(s)[:k]:
            if -neg >= least[i]:
                qi.append(i)
                vi.append(int(order[j]))
                sc.append(min(max(-neg, -(2**63)), 2**63 - 1))
    return np.array(qi, int), np.array(vi, int), np.array(sc, object)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column]) if len(column) else np.empty((0, 0))


_RESULT = ["query_row", "query_id", "vec_id", "score"]


def _cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({n: pd.Series(dtype="int64") for n in _RESULT})
    out = []
    sizes_q, sizes_v = left["v"].map(len), right["v"].map(len)
    for size in sorted(set(sizes_q) & set(sizes_v)):  # vectors of different length have no product
        a, b = left[sizes_q == size], right[sizes_v == size]
        qi, vi, s = top_of_block(_matrix(a["v"]), _matrix(b["v"]), b["vec_id"].to_numpy(), b["row"].to_numpy(), a["row"].to_numpy(), a["least"].to_numpy(float))
        out.append(pd.DataFrame({"query_row": a["row"].to_numpy()[qi], "query_id": a["vec_id"].to_numpy()[qi], "vec_id": b["vec_id"].to_numpy()[vi], "score": [int(x) for x in s]}, columns=_RESULT))
    return pd.concat(out).astype("int64") if out else pd.DataFrame({n: pd.Series(dtype="int64") for n in _RESULT})


def _reach(table: list[tuple[int, int, int, float]]) -> Column:
    """How many buckets, longest first, can hold a result of a query with this norm and least score."""
    return F.size(F.filter(F.array(*[F.lit(float(t[3])) for t in table]), lambda longest: F.col("norm") * longest * (1 + 1e-9) >= F.col("least")))


def _query_blocks(counts: list[tuple[int, int]], ends: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """From (reach, queries), widest first: (reach, first block, blocks, end of its candidate blocks), and by reach how many blocks hold a query that reaches so far.

    Small neighbouring reaches share a block, so blocks are at most twice as many as full ones would be.
    """
    laid, first, upto, room = [], 0, [0] * len(ends), 0
    for reach, n in counts:
        if n > room:  # a new block, or blocks of its own
            parts, room = math.ceil(n / QUERY_BLOCK), max(0, QUERY_BLOCK - n)
            laid.append((reach, first, parts, ends[reach]))
            first += parts
            for k in range(reach + 1):
                upto[k] = first
        else:
            room -= n
            laid.append((reach, first - 1, 1, ends[reach]))
    return laid, upto


def _meet(queries: DataFrame, blocks: DataFrame, lo: int, table: list[tuple[int, int, int, float]], hi: int | None = None) -> DataFrame:
    """Results of all cells of a query block and a candidate block from lo (to before hi, if given); queries carry least.

    Query blocks are made of queries of like reach, those of the widest reach first; so the query blocks that a candidate
    block can matter to are the first ones up to some block, and the other way round.
    """
    spark = queries.sparkSession
    ends = [0, *(t[1] + t[2] for t in table)]
    if hi is not None:
        ends = [min(e, hi) for e in ends]
    reached = queries.withColumn("reach", _reach(table))
    counts = reached.groupBy("reach").count().orderBy(F.desc("reach")).collect()  # at most one row per length bucket
    laid, upto = _query_blocks([(r["reach"], r["count"]) for r in counts if ends[r["reach"]] > lo], ends)
    lay = F.broadcast(spark.createDataFrame(laid, "reach int, q_first int, q_parts int, last int"))
    left = reached.join(lay, "reach").withColumn("qb", F.col("q_first") + F.pmod(F.xxhash64("row", F.lit(1)), F.col("q_parts")).cast("int"))
    left = left.withColumn("cb", F.explode(F.sequence(F.lit(lo), F.col("last") - 1)))
    left = left.select(*[F.col(c).alias(c) for c in ("qb", "cb", "row", "vec_id", "v", "least")])  # both sides come from one table
    n_qb = F.element_at(F.array(*map(F.lit, [*upto, 0])), F.col("nth") + 2)  # a candidate in the nth bucket needs a reach of nth + 1
    right = blocks.where(F.col("cb").between(lo, ends[-1] - 1)).withColumn("n_qb", n_qb).where("n_qb > 0").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1)))
    right = right.select(*[F.col(c).alias(c) for c in ("qb", "cb", "row", "vec_id", "v")])
    made = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))
    return made.applyInPandas(_cell, "query_row long, query_id long, vec_id long, score long")


def _best(results: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all other rows, ties to the smaller vec_id.

    is_query is over vec_id. Vectors that are null, or hold null or non-finite components, and rows with a null id take no part; vectors
    of different length do not meet; zero vectors take part and score 0. Rows that repeat an id are rows of their own, as candidates
    and as queries (which then have a list each). Fewer than k other rows: all of them. An empty table gives no
    rows; other columns are not read. Scores past 64 bits are held at the limit.
    """
    if k != K:
        raise ValueError(f"blocks are built for k = {K}")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
    # Length buckets; large ones are split by hash. Counts by bucket are few: lengths span some powers of RATIO.
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(RATIO))).otherwise(F.lit(-1)).cast("int")
    own = own.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).withColumn("bucket", bucket)
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "quantised")
    sizes = own.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("longest")).collect()
    n_query = own.where(is_query).count()
    if not sizes or not n_query:
        return own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spark, first, table = own.sparkSession, 0, []
    cores = spark.sparkContext.defaultParallelism
    block = min(BLOCK, max(SMALL, math.ceil(sum(r["n"] for r in sizes) / cores)))
    for r in sizes:
        parts = math.ceil(r["n"] / block)
        table.append((r["bucket"], first, parts, r["longest"]))
        first += parts
    lay = F.broadcast(spark.createDataFrame([(nth, *t[:3]) for nth, t in enumerate(table)], "nth int, bucket int, first int, parts int"))
    blocks = own.join(lay, "bucket").withColumn("cb", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    queries = own.where(is_query)

    head = 1
    start = materialize(_best(_meet(queries.withColumn("least", F.lit(float("-inf"))), blocks, 0, table, head), k), "head")
    if first <= head:
        return start.select("query_id", "rank", "vec_id", "score")
    known = start.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("least"))
    ready = materialize(queries.join(known, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "ready")
    rest = _meet(ready, blocks, head, table)
    return _best(start.select(*_RESULT).unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


#: sum in the order of the components, so that both engines agree; all terms are integers far below 2 ** 53 here.
ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
