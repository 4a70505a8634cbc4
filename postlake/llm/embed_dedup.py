"""Near-duplicate embeddings with a navigable small-world graph per shard.

Equal vectors are one class; the classes are dealt out to shards of bounded size by hash, and each shard gets a hierarchical small-world
graph, stored in the shared folder. Every class queries its own shard and every later one, so each pair of shards is searched
once and what is found counts for both sides. A query's beam is widened while it is full of links, and for a whole cell (a
block of queries and a shard) while an audit against brute force finds too few links of any class of queries. Found pairs are
verified by cosine in double precision. A cell returns, per class that has a link in it, the number of linked rows and one link
to the root of what it is joined to there, not the pairs; components are joined from these.
"""

from __future__ import annotations

import math
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

COSINE = 0.95
#: Classes in a shard at most; below that, shards of at least SMALL are made to give all cores work. Queries in a cell at most.
SHARD, SMALL, QUERIES = 16384, 1024, 8192
#: Links per node, beam while building, first and widest beam while searching, nodes expanded per step.
M, BUILD_BEAM, BEAM, WIDEST, STEP = 12, 48, 32, 128, 2
#: Audit of a cell: queries with links to find per class of their number, queries tried at most, and the recall that each class must reach.
AUDIT, AUDIT_TRIED, RECALL = 48, 2048, 0.98
#: Classes of queries by how many links they have: up to so many.
LINK_CLASSES = (1, 7, 31)
_BATCH = 256


class Graph:
    """A hierarchical navigable small-world graph over unit rows x; searched for many queries in lockstep."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        self.levels: list[np.ndarray] = []  # neighbours by level, -1 padded; row = node
        self.entry = 0

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        g = cls(x)
        n = len(x)
        if not n:
            return g
        rng = np.random.default_rng(7)
        level = np.minimum(np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / math.log(M)).astype(int), 6)
        top = int(level.max())
        g.levels = [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(top + 1)]
        order = np.argsort(-level, kind="stable")  # upper levels first: they route the rest
        g.entry = int(order[0])
        at, size = 1, 16
        while at < n:
            new = order[at : at + size]
            g._insert(new, order[:at], level)
            at += len(new)
            size = min(_BATCH, size * 2)
        return g

    def _insert(self, new: np.ndarray, old: np.ndarray, level: np.ndarray) -> None:
        start = np.full((len(new), 1), self.entry)
        among = self.x[new] @ self.x[new].T
        np.fill_diagonal(among, -2)
        for k in range(len(self.levels) - 1, -1, -1):
            ids, sims = self._beam(self.x[new], start, k, BUILD_BEAM if k == 0 else 8)[:2]
            start = np.where(ids[:, :1] >= 0, ids[:, :1], self.entry)
            mine = np.flatnonzero(level[new] >= k)
            if not len(mine):
                continue
            peers = among[np.ix_(mine, mine)]
            width = min(M, peers.shape[1])
            near = np.argpartition(-peers, width - 1, axis=1)[:, :width]
            all_ids = np.hstack([ids[mine], new[mine][near]])
            all_sims = np.hstack([sims[mine], np.take_along_axis(peers, near, axis=1)])
            ok = (all_ids >= 0) & (all_sims > -1.5)
            for r, i in enumerate(new[mine].tolist()):
                c, s = all_ids[r][ok[r]], all_sims[r][ok[r]]
                up = level[c] >= k
                chosen = self._diverse(c[up], s[up], M)
                self.levels[k][i, : len(chosen)] = chosen
                for j in chosen.tolist():
                    self._link(k, j, i)

    def _link(self, k: int, j: int, i: int) -> None:
        row = self.levels[k][j]
        if (row == i).any():
            return
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        c = np.append(row, i)
        chosen = self._diverse(c, self.x[c] @ self.x[j], len(row))
        row[:] = -1
        row[: len(chosen)] = chosen

    def _diverse(self, c: np.ndarray, s: np.ndarray, most: int) -> np.ndarray:
        """Nearest first, those not nearer to one already chosen than to the node; then the nearest of the rest."""
        order = np.argsort(-s, kind="stable")
        c, s = c[order], s[order]
        c, first = np.unique(c, return_index=True)
        back = np.argsort(first)
        c, s = c[back], s[first[back]]
        if len(c) <= most:
            return c
        near = self.x[c] @ self.x[c].T
        chosen: list[int] = []
        for t in range(len(c)):
            if not chosen or s[t] >= near[t, chosen].max():
                chosen.append(t)
                if len(chosen) == most:
                    break
        rest = [t for t in range(len(c)) if t not in chosen]
        return c[chosen + rest[: most - len(chosen)]]

    def _beam(self, q: np.ndarray, start: np.ndarray, k: int, width: int, hits_from: float | None = None) -> tuple:
        """Best width nodes of level k per query (ids, sims), and, with hits_from, all visited ones at or above it."""
        n, rows, links = len(self.x), np.arange(len(q))[:, None], self.levels[k]
        visited = np.zeros((len(q), n), bool)
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -3, np.float32)
        todo = np.zeros((len(q), width), bool)
        found_q, found_v = [], []

        def add(live: np.ndarray, new: np.ndarray) -> None:
            r = live[:, None]
            fresh = (new >= 0) & ~visited[r, new]
            new = np.where(fresh, new, -1)
            # the same node may come twice in a row: keep its first place
            order = np.argsort(new, axis=1, kind="stable")
            ranked = np.take_along_axis(new, order, axis=1)
            twice = np.zeros_like(fresh)
            twice[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
            new = np.where(twice, -1, ranked)
            good = new >= 0
            at_q, at_c = np.nonzero(good)
            node = new[at_q, at_c]
            visited[live[at_q], node] = True
            s = np.full(new.shape, -3, np.float32)
            s[at_q, at_c] = np.einsum("ij,ij->i", q[live[at_q]], self.x[node])
            if hits_from is not None:
                h = np.flatnonzero(s[at_q, at_c] >= hits_from)
                found_q.append(live[at_q[h]])
                found_v.append(node[h])
            all_ids, all_sims = np.hstack([ids[live], new]), np.hstack([sims[live], s])
            all_todo = np.hstack([todo[live], good])
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live], sims[live], todo[live] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_sims, all_todo))

        live = np.arange(len(q))
        add(live, start.astype(np.int64))
        while True:
            live = live[todo[live].any(axis=1)]
            if not len(live):
                break
            score = np.where(todo[live], sims[live], -4)
            pick = np.argsort(-score, axis=1, kind="stable")[:, :STEP]
            real = np.take_along_axis(score, pick, axis=1) > -3
            nodes = np.where(real, np.take_along_axis(ids[live], pick, axis=1), -1)
            flags = todo[live]
            np.put_along_axis(flags, pick, False, axis=1)
            todo[live] = flags
            nb = links[np.maximum(nodes, 0)].astype(np.int64)
            nb[nodes < 0] = -1
            add(live, nb.reshape(len(live), -1))
        del rows
        if hits_from is None:
            return ids, sims
        return ids, sims, np.concatenate(found_q), np.concatenate(found_v)

    def near(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs at or above least, and whether a query was scanned. Beams that end full of such pairs are widened; past WIDEST, the shard is scanned for these queries."""
        n, scanned = len(self.x), np.zeros(len(q), bool)
        if not n or not len(q):
            return np.empty(0, np.int64), np.empty(0, np.int64), scanned
        out_q, out_v = [], []
        start = np.full((len(q), 1), self.entry)
        for k in range(len(self.levels) - 1, 0, -1):
            ids, _ = self._beam(q, start, k, 4)
            start = np.where(ids[:, :1] >= 0, ids, np.full_like(ids, self.entry))
        left = np.arange(len(q))
        while len(left):
            if width > min(WIDEST, n):
                hq, hv = np.nonzero(q[left] @ self.x.T >= least)
                out_q.append(left[hq])
                out_v.append(hv)
                scanned[left] = True
                break
            _, sims, hq, hv = self._beam(q[left], start[left], 0, width, least)
            full = sims[:, -1] >= least
            done = ~full[hq]
            out_q.append(left[hq[done]])
            out_v.append(hv[done])
            left, width = left[full], width * 4
        return np.concatenate(out_q), np.concatenate(out_v), scanned

    def dump(self) -> bytes:
        f = BytesIO()
        np.savez(f, entry=self.entry, **{f"l{k}": a for k, a in enumerate(self.levels)})
        return f.getvalue()

    @classmethod
    def load(cls, raw: bytes, x: np.ndarray) -> Graph:
        z = np.load(BytesIO(raw))
        g = cls(x)
        g.levels, g.entry = [z[f"l{k}"] for k in range(len(z.files) - 1)], int(z["entry"])
        return g


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision; rows whose squares leave the range of doubles are scaled first."""
    dot, qq, vv = np.einsum("ij,ij->i", q, v), np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", v, v)
    with np.errstate(all="ignore"):
        out = dot / np.sqrt(qq * vv)
    size = np.minimum(qq, vv), np.maximum(qq, vv)
    odd = np.flatnonzero(~((size[0] > 1e-140) & (size[1] < 1e140)))
    if len(odd):
        a, b = _scaled(q[odd]), _scaled(v[odd])
        out[odd] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / np.abs(v).max(axis=1, keepdims=True)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = _scaled(v)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _stack(column: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.stack([np.asarray(x, kind) for x in column])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")  # the same graph whenever a task is repeated
    raw = _stack(pdf["v"])
    narrow = raw.astype(np.float32)
    raw = narrow if (narrow == raw).all() else raw
    g = Graph.build(_unit(raw.astype(float)))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "dim": [int(pdf["dim"].iloc[0])], "graph": [g.dump()], "ids": [pdf["node"].to_numpy(np.int64).tobytes()], "sizes": [pdf["n"].to_numpy(np.int64).tobytes()], "raw": [raw.tobytes()], "wide": [raw.dtype == np.float64]})


def _flat(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of pairs in a forest whose roots are the smallest positions."""
    while len(a):
        parent = _flat(parent)
        x, y = parent[a], parent[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    return _flat(parent)


_EMPTY = {"node": "int64", "n_links": "int64", "other": "int64"}


def _recall(hits: np.ndarray, due: np.ndarray) -> float:
    """The least share of links found among classes of queries by their number of links, as far as there are such queries."""
    group = np.searchsorted(LINK_CLASSES, due, side="left")
    return min((hits[group == k].sum() / due[group == k].sum() for k in np.unique(group)), default=1.0)


def _audit(g: Graph, q: np.ndarray, self_at: np.ndarray, scanned: np.ndarray, hit_q: np.ndarray, hit_v: np.ndarray, least: float) -> float:
    """Recall by brute force over queries that were not scanned and have a link besides themselves, up to AUDIT of each class."""
    order = np.random.default_rng(11).permutation(np.flatnonzero(~scanned))[:AUDIT_TRIED]
    found = np.bincount(hit_q[hit_v != self_at[hit_q]], minlength=len(q))
    hits, dues, seen = [], [], np.zeros(len(LINK_CLASSES) + 1, int)
    for a in range(0, len(order), 64):
        test = order[a : a + 64]
        sims = q[test] @ g.x.T >= least + 1e-6
        own = np.flatnonzero(self_at[test] >= 0)
        sims[own, self_at[test][own]] = False
        due = sims.sum(axis=1)
        some = due > 0
        hits.append(np.minimum(found[test[some]], due[some]))
        dues.append(due[some])
        seen += np.bincount(np.searchsorted(LINK_CLASSES, due[some], side="left"), minlength=len(seen))
        if (seen >= AUDIT).all():
            break
    return _recall(np.concatenate(hits), np.concatenate(dues)) if hits else 1.0


def _cell(queries: pd.DataFrame, shard: pd.DataFrame, least: float) -> pd.DataFrame:
    """Per class with a link here: linked rows, and the smallest class that it is joined to here.

    A query of another shard counts for both ends of a link; within a shard all members query, so each end counts its own.
    """
    if not len(queries) or not len(shard):
        return pd.DataFrame({k: pd.Series(dtype=t) for k, t in _EMPTY.items()})
    s = shard.iloc[0]
    ids, sizes = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["sizes"], np.int64)
    raw = np.frombuffer(s["raw"], np.float64 if s["wide"] else np.float32).reshape(len(ids), -1).astype(float)
    g = Graph.load(s["graph"], _unit(raw))
    queries = queries.sort_values("node")
    v, own, own_sizes = _stack(queries["v"]), queries["node"].to_numpy(np.int64), queries["n"].to_numpy(np.int64)
    inside = int(queries["home"].iloc[0]) == int(s["shard"])
    q = _unit(v)
    self_at = np.searchsorted(ids, own) if inside else np.full(len(own), -1)
    nodes = np.union1d(own, ids)  # sorted, so that the smallest position is the smallest class
    at_own, at_ids = np.searchsorted(nodes, own), np.searchsorted(nodes, ids)
    width = BEAM
    while True:
        links, parent = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        scanned, all_q, all_v = np.zeros(len(q), bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        audit = width <= WIDEST  # beyond, all is scanned
        for a in range(0, len(q), _BATCH):
            hq, hv, full = g.near(q[a : a + _BATCH], least - 1e-4, width)
            hq, scanned[a : a + _BATCH] = hq + a, full
            keep = np.concatenate([exact(v[hq[c : c + 65536]], raw[hv[c : c + 65536]]) >= least for c in range(0, len(hq), 65536)]) if len(hq) else np.empty(0, bool)
            keep &= hv != self_at[hq]  # a class's own rows are counted outside
            hq, hv = hq[keep], hv[keep]
            np.add.at(links, at_own[hq], sizes[hv])
            if not inside:
                np.add.at(links, at_ids[hv], own_sizes[hq])
            parent = _join(parent, at_own[hq], at_ids[hv])
            if audit:
                beam = ~scanned[hq]
                all_q.append(hq[beam])
                all_v.append(hv[beam])
        if not audit or _audit(g, q, self_at, scanned, np.concatenate(all_q), np.concatenate(all_v), least) >= RECALL:
            break
        width *= 4
    both = np.flatnonzero((links > 0) | (parent != np.arange(len(nodes))))
    return pd.DataFrame({"node": nodes[both], "n_links": links[both], "other": nodes[parent[both]]})


def near_duplicates(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    length do not either. Equal vectors link with each other. A repeated vec_id is a row of its own, with all the rows of its id's class among its links; rows with a
    null id take part (a component without an id has none) and have kept false. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = materialize(own.withColumn("key", F.when(fine, F.xxhash64("v"))).withColumn("v", F.when(fine, F.col("v"))), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.min("key").alias("key")).withColumn("dim", F.size("v"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    cores, table, first = spark.sparkContext.defaultParallelism, [], 0
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # one row per length of vectors
        parts = max(math.ceil(r["n"] / SHARD), min(cores, math.ceil(r["n"] / SMALL)))
        blocks = math.ceil(r["n"] / parts / QUERIES)  # of queries per shard
        table.append((r["dim"], first, parts, blocks))
        first += parts
    if not table:
        none = F.lit(0).cast("long")
        return rows.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    lay = F.broadcast(spark.createDataFrame(table, "dim int, first int, parts int, blocks int"))
    laid = classes.join(lay, "dim").withColumn("home", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A number of partitions of its own: shards and cells are few bytes and much work, so they must not be put together by size.
    wide = max(4 * cores, 2 * first)
    shards = laid.select(F.col("home").alias("shard"), "dim", "node", "v", "n").repartition(wide, "shard")
    graphs = materialize(shards.groupBy("shard").applyInPandas(_build, "shard int, dim int, graph binary, ids binary, sizes binary, raw binary, wide boolean"), "graphs")
    block = F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col("blocks")).cast("int")
    later = F.explode(F.sequence(F.col("home"), F.col("first") + F.col("parts") - 1))
    queries = laid.withColumn("block", block).withColumn("shard", later).select("shard", "home", "block", "node", "v", "n")
    earlier = F.explode(F.sequence(F.col("first"), F.col("shard")))
    graphs = graphs.join(lay, "dim").withColumn("home", earlier).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("dim", "first", "parts", "blocks")
    cell = ["shard", "home", "block"]
    many = max(wide, min(2 * first * (first + 1), 20_000))
    made = queries.repartition(many, *cell).groupBy(*cell).cogroup(graphs.repartition(many, *cell).groupBy(*cell))
    cells = materialize(made.applyInPandas(lambda a, b: _cell(a, b, least), "node long, n_links long, other long"), "cells")
    n = cells.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    comp = connected_components(cells.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = materialize(classes.join(n, "node", "left").join(comp, "node", "left").select("node", "key", F.col("v").alias("_v"), F.col("vec_id").alias("least_id"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "linked")
    # Components are made of classes, so that vectors without an id link others too; then they are named by their smallest id.
    named = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    whole = linked.join(named, "component").select("key", "_v", "n_links", "component_id")
    # A row's class is found by hash, then by value.
    out = rows.join(whole, (rows["key"] == whole["key"]) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
