import random
from math import inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import spark_rows, sql_rows
from postlake.llm import embed_dedup, topk

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)


def brute_topk(rows, is_query, k=20):
    quant = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows}
    out = []
    for q in sorted(filter(is_query, quant)):
        s = sorted((-sum(a * b for a, b in zip(quant[q], v, strict=True)), i) for i, v in quant.items() if i != q)
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


def clustered(n, dim, seed, lengths=(0.1, 5.0)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))
    x *= rng.uniform(*lengths, (n, 1))
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_topk_equals_its_sql(spark):
    from postlake.llm.queries import op8_exact_topk

    assert spark_rows(op8_exact_topk(spark, SF)) == sql_rows(topk.ORACLE, SF)


@pytest.mark.parametrize("block", [64, 8192])
def test_topk_with_many_blocks_lengths_and_ties(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rows = clustered(700, 12, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties: the smaller ids win
    got = found(topk.search(vectors(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == brute_topk(rows, lambda i: i % 20 == 0)


def test_query_blocks_meet_only_what_they_reach():
    ends = [0, 3, 5, 9]
    laid, upto = topk._query_blocks([(3, 10), (2, topk.QUERY_BLOCK * 2 + 5), (1, 4)], ends)
    assert laid == [(3, 0, 1, 9), (2, 1, 3, 5), (1, 4, 1, 3)] and upto == [5, 5, 4, 1]
    laid, upto = topk._query_blocks([(3, 10), (2, 10), (1, 10)], ends)
    assert laid == [(3, 0, 1, 9), (2, 0, 1, 5), (1, 0, 1, 3)] and upto == [1, 1, 1, 1]


def test_coordinate_pruning_is_used_and_exact(monkeypatch):
    rows = clustered(900, 16, 4, (1.0, 1.02))
    v = np.floor(64 * np.array([r[1] for r in rows]))
    seen = []
    take = topk._take
    monkeypatch.setattr(topk, "_take", lambda *a: (seen.append(len(a[3])), take(*a))[1])
    least = np.sort(v[:30] @ v.T, axis=1)[:, -40].astype(float)
    qi, vi, s = topk.top_of_block(v[:30], v, np.arange(900), np.arange(900), np.arange(30), least)
    for q in range(30):
        want = sorted((-float(v[q] @ v[j]), j) for j in range(900) if j != q)[:20]
        assert [(-float(x), int(j)) for x, j in zip(s[qi == q], vi[qi == q], strict=True)] == want
    assert min(seen) < 300


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 0.0]), (80, [None, 1.0]), (None, [1.0, 1.0]), (1, [0.0, 0.0]), (2, [-1.0, -2.0]), (3, [3.0]), (0, [1.0, 2.0]), (100, [1e30, 1e30])]
    df = vectors(spark, rows).withColumn("norm", F.lit("x")).withColumn("v", F.lit(1))
    got = found(topk.search(df, F.col("vec_id") % 20 == 0))
    # Rows that repeat an id are candidates and queries of their own.
    assert [(q, r, i) for q, r, i, _ in got] == sorted([(0, 1, 100), (0, 2, 0), (0, 3, 1), (0, 4, 2)] * 2 + [(100, 1, 0), (100, 2, 0), (100, 3, 1), (100, 4, 2)])
    assert got[0][3] == 2**63 - 1 and topk.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def brute_links(rows, least=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    comp = {i: i for i, _ in rows}
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[ok[a][0]] += 1
                links[ok[b][0]] += 1
                old, new = sorted((comp[ok[a][0]], comp[ok[b][0]]), reverse=True)
                comp = {k: new if v == old else v for k, v in comp.items()}
    return links, comp


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SHARD", 120)
    monkeypatch.setattr(embed_dedup, "QUERIES", 100)
    rng = random.Random(6)
    rows = clustered(260, 16, 2)
    for i in range(300, 420):
        base = rows[rng.randrange(12)][1]
        rows.append((i, [float(np.float32(x * 1.5 + rng.gauss(0, 0.05))) for x in base]))
    rows += [(500 + i, rows[0][1]) for i in range(30)]
    links, comp = brute_links(rows)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert sum(links.values()) > 1000
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(links.values())
    assert all(got[i]["n_links"] <= links[i] for i in links)
    assert np.mean([got[i]["component_id"] == comp[i] for i in comp]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_graph_recall_and_widening():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    x[:700] = x[0] + 0.01 * rng.normal(size=(700, 24))  # one dense group, larger than any first beam
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = embed_dedup.Graph.build(unit)
    q, v, _ = g.near(unit, 0.95, embed_dedup.BEAM)
    truth = (unit @ unit.T >= 0.95).sum()
    assert len(q) >= 0.99 * truth and len(set(zip(q.tolist(), v.tolist(), strict=True))) == len(q)
    assert embed_dedup.Graph.load(g.dump(), unit).near(unit[:50], 0.95, 32)[0].shape == g.near(unit[:50], 0.95, 32)[0].shape


def test_cosines_of_extreme_vectors():
    a = np.array([[1e200, 1e200], [1e-200, 0.0], [3e-310, 4e-310], [1.0, 2.0], [1e308, 1e308]])
    b = np.array([[1e200, 0.9e200], [1e-200, 1e-201], [3e-310, 4e-310], [2.0, 4.0], [1e-308, 1e-308]])
    want = [float(np.dot(x, y)) for x, y in zip(embed_dedup._unit(a).astype(float), embed_dedup._unit(b).astype(float), strict=True)]
    assert np.allclose(embed_dedup.exact(a, b), want, atol=1e-6)


def test_the_audit_sees_the_worst_class_of_queries():
    due = np.array([5000] * 16 + [1] * 32)
    hits = np.array([5000] * 16 + [1] * 31 + [0])
    assert hits.sum() / due.sum() > 0.999 and embed_dedup._recall(hits, due) < embed_dedup.RECALL
    assert embed_dedup._recall(np.empty(0), np.empty(0)) == 1


def test_small_groups_are_found_beside_a_dense_one(spark, monkeypatch):
    """Thousands of links of a dense group must not hide the single links of others from the audit."""
    monkeypatch.setattr(embed_dedup, "SHARD", 700)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1400, 24))
    x[:500] = x[0] + 0.01 * rng.normal(size=(500, 24))
    x[500:950] = x[950:] + 0.02 * rng.normal(size=(450, 24))  # pairs
    rows = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(x)]
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect()}
    pairs = [i for i in range(500, 1400) if want[i]]
    assert len(pairs) > 800 and sum(got[i]["n_links"] for i in pairs) >= 0.98 * want[pairs].sum()
    assert sum(got[i]["n_links"] for i in range(500)) >= 0.99 * want[:500].sum()


def test_near_duplicates_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0]), (9, [1.0]), (10, [1.0, 0.0])]
    df = vectors(spark, rows).withColumns({c: F.lit("x") for c in ("n", "key", "dim", "shard", "node")})
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (0, 3, 1, False), (9, 1, 9, True), (9, 1, 9, True), (10, 3, 1, False)], key=str)
    assert embed_dedup.near_duplicates(vectors(spark, [])).count() == 0
    assert embed_dedup.near_duplicates(vectors(spark, [(1, None)])).count() == 1
