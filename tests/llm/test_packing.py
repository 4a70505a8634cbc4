import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.llm import packing

SF = "/root/testdata/sf0.01"


def check_plan(counts, capacity):
    plan = packing.plan(counts, capacity)
    used = Counter()
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= capacity
        for s in pattern:
            used[s] += n
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(n for _, n in plan)


@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=15))
@settings(max_examples=300, deadline=None)
def test_plans_hold_every_piece_once(counts):
    n = check_plan(counts, 40)
    assert n >= -(-sum(k * v for k, v in counts.items()) // 40)


def best(sizes, capacity):
    """Fewest sequences by branch and bound."""
    sizes = sorted(sizes, reverse=True)
    low = len(sizes)

    def go(k, rooms):
        nonlocal low
        if len(rooms) >= low:
            return
        if k == len(sizes):
            low = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= sizes[k]:
                left = list(rooms)
                left.remove(room)
                go(k + 1, [*left, room - sizes[k]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return low


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=150, deadline=None)
def test_fixed_sets_lose_nothing(sizes):
    """What dominance fixes leaves an optimum reachable."""
    fixed, left = packing.fix_dominating(Counter(sizes), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + best(rest, 20) == best(sizes, 20)


def test_dominance_and_best_fit_examples():
    assert packing.fix_dominating({2048: 3}, 2048) == ([((2048,), 3)], {})
    assert packing.fix_dominating({2000: 2, 48: 2}, 2048) == ([((2000, 48), 2)], {})
    rng = random.Random(1)
    counts = Counter(rng.randrange(1, 2049) for _ in range(5000))
    n = check_plan(counts, 2048)
    assert n <= 1.02 * -(-sum(k * v for k, v in counts.items()) // 2048) + 1


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


@cache
def reference_reader():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.token_path(packing.TOKENIZER))


@cache
def encoder():
    return packing.Encoder(packing.token_path(packing.TOKENIZER), packing.token_path(packing.RANKS))


def reference_ids(texts):
    t = reference_reader()
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]


def verify(rows, docs):
    """Pieces tile each document's ids, sequences have no gaps and hold at most the capacity."""
    ids = dict(zip([d for d, _ in docs], reference_ids([t for _, t in docs]), strict=True))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    for d, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids[d]) and all(r["length"] == 2048 for r in own[1:])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return len(by_seq)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs).collect()
    n = verify(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 2048) + 1


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_both_readers_give_the_same_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    e = encoder()
    assert e.ids(text).tolist() == reference_ids([text])[0][:-1].tolist()


@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
@settings(max_examples=600, deadline=None)
def test_the_fast_reader_agrees_in_its_characters(text):
    assert not packing._COMMON.search(text)
    e = encoder()
    assert e.ids(text).tolist() == e.slow.encode(text, add_special_tokens=False).ids


def test_odd_rows(odd, clashing, empty):
    rows = packing.pack(odd).collect()
    assert sum(r["piece"] == 0 for r in rows) == 10
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2)) == [1, 1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) == len(reference_ids(["word " * 60_000])[0])
    places = Counter((r["sequence_id"], r["offset"]) for r in rows)
    assert max(places.values()) == 1
    assert packing.pack(clashing).count() == len(rows) and packing.pack(empty).count() == 0


def test_strings_of_added_tokens_are_those_tokens():
    e = packing.Encoder(packing.token_path(packing.TOKENIZER), packing.token_path(packing.RANKS))
    assert e.ids("a<|endoftext|> b").tolist() == [64, 50256, 275]
    for text in ("<|endoftext|>", "x <|endoftext|><|endoftext|>y", "<|endoftext", "<|ENDOFTEXT|>", "é <|endoftext|> \U0001f600"):
        assert e.ids(text).tolist() == reference_ids([text])[0][:-1].tolist()
    with pytest.raises(FileNotFoundError):
        packing.Encoder(packing.token_path(packing.TOKENIZER), "/nowhere")


def test_packed_documents_with_added_tokens(spark):
    docs = [(1, "a<|endoftext|> b"), (2, "<|endoftext|>" * 3000), (3, "plain")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    verify(rows, docs)
    assert {r["doc_id"]: r["length"] for r in rows if r["doc_id"] != 2} == {1: 4, 3: 2}
