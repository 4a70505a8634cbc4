import random

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlake.llm import simhash

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    """By the definition, bit by bit."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(max_size=120))
def test_fingerprint_is_the_definition(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_of_long_texts_and_spark_hash(spark):
    words = [f"w{i % 977}" for i in range(70_000)]
    assert simhash.fingerprint(" ".join(words).encode()) == plain_fingerprint(" ".join(words))
    assert spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def brute(fps):
    """Component minimum of each (id, fp) by comparing all pairs."""
    parent = {i: i for i, _ in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 2:
                x, y = root(fps[a][0]), root(fps[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in fps}


def test_links_find_all_pairs_within_two_bits(spark, monkeypatch):
    rng, rows = random.Random(3), []
    for c in range(12):
        base = rng.getrandbits(64)
        for _ in range(9):
            x = base
            for _ in range(rng.randrange(0, 4)):
                x ^= 1 << rng.randrange(64)
            rows.append(x)
    rows = [(i, x) for i, x in enumerate(dict.fromkeys(rows))]
    signed = [(i, x - 2**64 if x >= 2**63 else x) for i, x in rows]
    df = spark.createDataFrame(signed, "node long, fp long")
    want = {(min(a, b), max(a, b)) for a, x in rows for b, y in rows if a < b and bin(x ^ y).count("1") <= 2}
    got = simhash.links(df).select(F.least("a", "b"), F.greatest("a", "b")).collect()
    assert {tuple(r) for r in got} == want and len(got) <= 2 * len(want)
    monkeypatch.setattr(simhash, "PAIR_LIMIT", 1)  # every key is cut again
    from postlake.llm.components import connected_components

    comp = {r["node"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    assert {i: comp.get(i, i) for i, _ in rows} == brute(rows)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = [(i, plain_fingerprint(t)) for i, t in texts.items()]
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == dict(fps)
    assert {i: r["component_id"] for i, r in got.items()} == brute(fps)


def test_odd_rows(odd, clashing, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[4]["n_copies"] == 3
    assert simhash.near_duplicates(clashing).count() == 10
    assert simhash.near_duplicates(empty).count() == 0
    assert np.uint64 is not None


def test_components_on_a_path_and_a_star(spark):
    from postlake.llm.components import connected_components

    path = [(i, i + 1) for i in range(100, 140)]
    star = [(0, i) for i in range(1, 30)]
    rows = connected_components(spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {**{i: 100 for i in range(100, 141)}, **{i: 0 for i in range(30)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_text_without_an_id_links_others(spark, monkeypatch):
    a = 0x0123456789ABCDEF
    fps = [(7, a), (None, a ^ 0b11), (5, a ^ 0b1111), (None, 1 << 40)]
    df = spark.createDataFrame(fps, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *args: df)
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == {(7, a): 5, (None, a ^ 0b11): 5, (5, a ^ 0b1111): 5, (None, 1 << 40): None}


def test_hot_and_shared_keys_take_the_shuffle_too(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda: sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    want = rows()
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(simhash, "HOT", 2.0)
    assert rows() == want
