from collections import Counter

import corpus_pipeline as cp
from postlake.llm import mixing, packing, pii, simhash
from postlake.llm.queries import op1_toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in op1_toxicity(spark, SF).where("predicted = 1").collect()}
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "simhash_dedup", "pii", "mixing", "packing"]
    kept = cp.drop_toxic(spark, docs, SF)
    assert kept.columns == COLUMNS
    rows = {r["doc_id"]: r for r in docs.collect()}
    want = {i for i in rows if i not in toxic}
    assert {r["doc_id"] for r in kept.collect()} == want and len(want) < len(rows)

    fps = sorted((i, simhash.fingerprint(rows[i]["text"].encode())) for i in want)
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
    one = cp.drop_near_duplicates(spark, kept, SF)
    want = {i for i, _ in fps if root(i) == i}
    assert one.columns == COLUMNS and sorted(r["doc_id"] for r in one.collect()) == sorted(want) and len(want) < len(fps)

    clean = cp.redact_pii(spark, one, SF)
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == COLUMNS
    spans = {i: pii.spans_of(rows[i]["text"]) for i in texts}
    accepted = {k for k, p in pii.train(Counter(x["key"] for own in spans.values() for x in own)).items() if p >= 0.5}
    for i, r in texts.items():
        take = [(x["start"], x["end"], x["kind"]) for x in spans[i] if x["base"] or x["key"] in accepted]
        assert r["text"] == pii.masked(rows[i]["text"], take) and r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])

    mixed = cp.mix_sources(spark, clean, SF)
    n = Counter(r["source"] for r in texts.values())
    weight = {s: c**0.5 for s, c in n.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(n.values()) / c for s, c in n.items()}
    import hashlib

    u = lambda i: int(hashlib.md5(f"17|{i}".encode()).hexdigest()[:13], 16) / 16**13
    want = Counter({i: sum(c <= u(i) for c in mixing.cumulative(rate[r["source"]])) for i, r in texts.items()})
    assert mixed.columns == COLUMNS and Counter(r["doc_id"] for r in mixed.collect()) == +want

    packed = cp.pack_sequences(spark, mixed, SF).collect()
    enc = packing.Encoder(packing.token_path(packing.TOKENIZER), None)
    lengths = {i: len(enc.ids(texts[i]["text"])) + 1 for i in want if want[i]}
    total = Counter()
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert total == Counter({i: lengths[i] * want[i] for i in lengths})

    whole = cp.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_stages_on_odd_rows(spark, odd, clashing, empty):
    for docs, n in ((odd, 10), (clashing, 10), (empty, 0)):
        kept = cp.drop_toxic(spark, docs, SF)
        assert kept.count() == n
        for stage in (cp.drop_near_duplicates, cp.redact_pii, cp.mix_sources):
            kept = stage(spark, kept, SF)
            assert kept.columns == COLUMNS
        cp.pack_sequences(spark, kept, SF).count()


def test_near_duplicates_are_dropped_by_row(spark, odd):
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is None, i))
    assert ids(cp.drop_near_duplicates(spark, odd, SF)) == [1, 4, 6, 7, 8, None]
    long = " ".join(f"w{i * i % 97}" for i in range(400))
    rows = [(9, long), (9, long), (9, "another text under the same id"), (3, long), (None, long), (None, "unique one"), (None, "unique one"), (None, "a second unique text")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], odd.schema)
    got = [(r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(3, long), (9, "another text under the same id"), (None, "unique one"), (None, "a second unique text")], key=str)
