import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import spark_rows, sql_rows
from postlake.llm import langid, licenses, mixing
from postlake.llm import queries as q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(q.queries()[name](spark, SF)) == sql_rows(q.oracle_sql()[name], SF)


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in q.queries()] == [f"op{k}" for k in range(1, 11)]


def test_poisson_inversion():
    for rate in (0.0, 0.2, 1.0, 7.5, 40.0, 900.0):
        c = mixing.cumulative(rate)
        assert all(a <= b for a, b in zip(c, c[1:], strict=False)) and abs(c[-1] - 1) < 1e-9
        mean = sum(k * (c[k] - (c[k - 1] if k else 0)) for k in range(len(c)))
        assert math.isclose(mean, rate, rel_tol=1e-6, abs_tol=1e-9)


def test_mix_meets_its_targets(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "mid").otherwise("off").alias("source"))
    out = mixing.mix(docs, {"big": 1.0, "mid": 1.0}, size=0.5)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"big", "mid"} and all(abs(v - 10_000) < 500 for v in n.values())
    copies = {r["c"]: r["count"] for r in out.where("source = 'mid'").groupBy("doc_id").agg(F.count("*").alias("c")).groupBy("c").count().collect()}
    p = lambda k: 4000 * math.exp(-2.5) * 2.5**k / math.factorial(k)
    assert all(abs(copies[k] - p(k)) < 5 * math.sqrt(p(k)) for k in range(1, 6))
    u = int(hashlib.md5(b"17|8").hexdigest()[:13], 16) / 16**13
    assert out.where("doc_id = 8").count() == sum(x <= u for x in mixing.cumulative(2.5))


def test_many_sources_take_the_shuffle(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("source"))
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix(docs).collect()) == want


def test_mix_is_shuffled_and_repeats(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    a, b = ([(r["doc_id"], r["copy"]) for r in mixing.mix(docs).collect()] for _ in range(2))
    assert sorted(a) == sorted(b)
    ids = [x for x, _ in a]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.1


def test_rows_without_an_id_are_spread(spark):
    docs = spark.range(8000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"))
    out = mixing.mix(docs, size=3.0)
    n = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(n) == 4 and max(n) < 1.2 * min(n) and out.select("shuffle_key").distinct().count() == sum(n)


def test_mix_odd_rows(odd, clashing, empty):
    out = mixing.mix(odd, {"a": 1.0}, size=20.0)
    assert {r["doc_id"] for r in out.collect()} == {2, 3, 5} and out.columns[:5] == odd.columns
    assert mixing.mix(odd).columns[-2:] == ["copy", "shuffle_key"]
    mixed = mixing.mix(clashing)
    assert sorted(mixed.columns) == sorted(clashing.columns) and mixed.where("drawn <> 'own'").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd, {}).count() == 0


def test_language_held_out_accuracy(spark):
    got = q.op6_language_id(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    rows = got.where("held_out and lang is not null").select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def learned(texts, langs):
    """The model by plain sets and one dense solution, from all texts as landmarks."""
    names = sorted(set(langs))
    bare = langid.Model(names, [langid.slots(t) for t in texts], np.empty(0))
    gram, target = langid.sums(bare, [names.index(x) for x in langs], bare.landmarks, [1 / langs.count(x) for x in langs])
    return langid.solve(names, bare.landmarks, gram, target)


def test_kernel_is_presence_of_shared_ngrams():
    a, b = langid.slots("Abc abc"), langid.slots("abc")
    assert set(b) <= set(a) and len(langid.slots("x" * 3_000_000)) == len(langid.slots("x" * 50))
    texts = ["the cat and the dog", "the house of the hen", "der hund und die katze", "das haus und der hof"]
    m = learned(texts, ["en", "en", "de", "de"])
    assert [m.langs[k] for k in m.predict(["the dog of the house", "der hof und die katze"])[0]] == ["en", "de"]
    sets = [set(langid.slots(t).tolist()) for t in texts]
    own = [set(langid.slots(t).tolist()) for t in ("the dog", "zzz qqq", "der")]
    want = [[len(x & y) / (len(x) * len(y)) ** 0.5 for y in sets] for x in own]
    assert np.allclose(m.kernel([np.array(sorted(x)) for x in own]), want, atol=1e-6)


def test_language_results_are_the_plain_ones(spark, monkeypatch):
    """Fit and prediction over a whole table against sets and one dense solution."""
    monkeypatch.setattr(langid, "SAMPLE_PER_LANGUAGE", 1000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = docs.collect()
    train = {(r["doc_id"], r["lang"]): r["text"] for r in rows if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    n = Counter(lang for _, lang in train)
    assert set(model.langs) == set(n) and max(n.values()) <= langid.SAMPLE_PER_LANGUAGE  # so all of them are learned from
    marks = [set(x.tolist()) for x in model.landmarks]
    spectrum = lambda t: set(langid.slots(t).tolist())
    feature = lambda s: [*(len(s & m) / (len(s) * len(m)) ** 0.5 for m in marks), 1.0]
    k = np.array([feature(spectrum(t)) for t in train.values()])
    y = np.array([[1.0 if lang == x else -1.0 for x in model.langs] for _, lang in train])
    w = np.array([1 / n[lang] for _, lang in train])
    penalty = np.zeros((len(marks) + 1, len(marks) + 1))
    penalty[:-1, :-1] = [feature(m)[:-1] for m in marks]
    penalty[:-1, :-1] += 1e-6 * np.eye(len(marks))
    weights = np.linalg.solve(k.T @ (k * w[:, None]) + langid.RIDGE * penalty + 1e-8 * np.eye(len(penalty)), k.T @ (y * w[:, None]))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        f = np.array(feature(spectrum(r["text"]))) @ weights
        e = np.exp(4 * (f - f.max()))
        assert abs(got[r["doc_id"]]["score"] - e.max() / e.sum()) < 1e-3 and (got[r["doc_id"]]["lang_pred"] == model.langs[int(f.argmax())] or np.sort(f)[-1] - np.sort(f)[-2] < 1e-3)


def test_many_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "BROADCAST_LANGUAGES", 5)
    monkeypatch.setattr(langid, "LANDMARKS", 60)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(260)]
    rows = [(i, f"{words[i % 260]}{words[(i * 7) % 260]} {words[i % 260] * 3} {words[i % 260]}{i}", f"l{i % 260}") for i in range(2600)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 260 and len(model.landmarks) == 520


def test_language_odd_rows(odd, clashing, empty):
    model = langid.fit(odd)
    by = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert len(by) == 9 and [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[1]["score"] == 0
    assert by[6]["lang_pred"] == "en" and langid.predict(clashing, langid.fit(clashing)).count() == 10
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


def test_license_rules(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nother words\n* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    cases = [
        (1, "Text.\nReleased under the MIT License.\nMore", "MIT"),
        (2, "  RELEASED under  the mit LICENSE!", "MIT"),
        (3, "not Released under the MIT License.", ""),
        (4, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
        (5, bsd, "BSD-2-Clause"),
        (6, "\n".join(reversed(bsd.split("\n"))), ""),
        (7, "Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3.", "GPL-3.0,CC-BY-NC-4.0"),
        (8, "GNU GENERAL PUBLIC LICENSE", ""),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()}
    assert got == {c[0]: c[2] for c in cases}


def test_license_notices_may_be_wrapped(spark):
    import textwrap

    by = {i: s for s, i in (licenses.SENTENCES | licenses.FULL_TEXTS).items()}
    wrap = lambda text, prefix="": "\n".join(prefix + x for x in textwrap.wrap(text, 75))
    name = "3. Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    two = f"{by['BSD-Head']}\n\n1. {by['BSD-Source']}\n\n2. {by['BSD-Binary']}"
    bsd2 = "\n\n".join(wrap(x) for x in two.split("\n\n"))
    cases = [
        (wrap(by["GPL3-Later"]), "GPL-3.0-or-later", 2),
        ("/*\n" + wrap(by["GPL3-Later"] + " " + by["GPL-Warranty"], " * ") + "\n */\nint x;", "GPL-3.0-or-later", 4),
        ("x = 1\n" + wrap(by["GPL2-Later"], "# ") + "\n#\n# more", "GPL-2.0-or-later", 3),
        (wrap(by["GPL2-Later"], "dnl "), "GPL-2.0-or-later", 3),
        ('// Licensed under the Apache License, Version 2.0 (the "License");\r\n// you may not use this file except in compliance\r\n// with the License.\r\n', "Apache-2.0", 2),
        (wrap(by["MIT-Permission"]), "MIT", 1),
        (wrap(by["MIT-Notice"], ";; "), "MIT", 1),
        (bsd2, "BSD-2-Clause", 3),
        (bsd2 + "\n\n" + wrap(name), "BSD-3-Clause", 4),
        (two + "\n" + name, "BSD-3-Clause", 4),
        (bsd2 + "\n\n" + wrap(name) + "\n\n" + bsd2, "BSD-3-Clause,BSD-2-Clause", 7),
        (wrap(by["MIT-Permission"]) + "\n\n" + wrap(by["MIT-Notice"]) + "\n\n" + wrap(by["MIT-Warranty"] + " " + by["MIT-Liability"]), "MIT", 4),
        (wrap(by["ISC-Permission"], "// "), "ISC", 1),
        (wrap(by["Zlib-Warranty"]) + "\n\n" + wrap(by["Zlib-Permission"]), "Zlib", 2),
        (wrap(by["BSL-Permission"]), "BSL-1.0", 1),
        (wrap(by["LGPL21-Later"], " * "), "LGPL-2.1-or-later", 3),
        (wrap(by["AGPL3-Later"], "# "), "AGPL-3.0-or-later", 2),
        ("Released under the\n\nMIT License.", "", 0),
        ("Text\nReleased under the MIT License\nmore", "MIT", 1),
        ("not Released under\nthe MIT License.", "", 0),
        ("Released under | the / MIT License.", "MIT", 1),
    ]
    rows = licenses.scan(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["licenses"], r["n_sentences"]) for r in rows} == {k: c[1:] for k, c in enumerate(cases)}


def test_license_plan_is_native(spark):
    plan = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange"))


def test_license_odd_rows(odd, clashing, empty):
    rows = licenses.scan(odd).collect()
    assert len(rows) == 10 and all(r["n_sentences"] == 0 and r["licenses"] == "" and r["first_license"] is None for r in rows)
    assert licenses.scan(clashing).count() == 10 and licenses.scan(empty).count() == 0
