import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from postlake.llm import toxicity
from postlake.llm.queries import op1_toxicity

SF = "/root/testdata/sf0.1"


def distance(a, b):
    """Edits with swaps of neighbours, by the full table."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_on_the_trie_equals_edit_distance():
    terms = ["idiot", "moron", "pathetic", "disgusting", "scum", "troll"]
    m = toxicity.Matcher([(t, True) for t in terms])
    rng = random.Random(2)
    for _ in range(6000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(word))
            move = rng.randrange(4)
            if move == 0:
                word[k] = rng.choice("abcdiost")
            elif move == 1:
                del word[k]
            elif move == 2:
                word.insert(k, rng.choice("abcdiost"))
            elif k:
                word[k - 1], word[k] = word[k], word[k - 1]
        word = "".join(word)
        if not word:
            continue
        want = any(len(t) >= toxicity.EDIT_LENGTH and distance(word, t) <= 1 for t in terms)
        assert (m.misspelt(word) is not None) == want, word
        assert (m.exact(word) is not None) == (word in terms)


def test_stems_need_an_ending():
    m = toxicity.Matcher([("lowei", False), ("scum", True)])
    assert m.exact("loweiung") == "lowei" and m.exact("lowei") is None and m.exact("scums") is None and m.exact("scum") == "scum"


def test_quotation_counts_less_than_abuse():
    s = toxicity.Scanner(toxicity.Model([("idiot", True)]))
    direct, quoted, _ = s.features("you are an idiot and you know it")
    assert direct == 1 and quoted == 0
    direct, quoted, _ = s.features('the word "idiot" is rude')
    assert direct == 0 and quoted == 1
    assert s.features("he never said idiot")[1] == 1
    assert s.features("what an idoit")[0] == toxicity.EDITED
    assert s.features(None) == s.features("") == (0, 0, 0)


def test_quotation_marks_are_paired_over_the_whole_text():
    s = toxicity.Scanner(toxicity.Model([("idiot", True)]))
    far = "and so on " * 20
    for text in (f'"{far} idiot {far}" is rude', f"« {far} idiot {far} » dit", f"»{far} idiot {far}« steht da", f"„{far} idiot {far}“ steht da", f"“{far} idiot {far}” it was", f"‘{far} idiot {far}’ it was", f"'{far}idiot {far}.' it was", f'« x "y" idiot {far} "z" "z" "z" "z" "z" »'):
        assert s.features(text)[:2] == (0, 1), text
    for text in ("don't be an idiot, it's what you are", "l'homme est un idiot, d'accord, l'an", "the students' idiot isn't", 'a "word" and an idiot and a "word"', 'one " mark, idiot', 'an inch 5" long\n\nidiot "yes"', "idiot"):
        assert s.features(text)[:2] == (1, 0), text
    began = time.process_time()
    s.features('" idiot ' * 100_000)
    assert time.process_time() - began < 5


def test_figures_for_letters():
    s = toxicity.Scanner(toxicity.Model([("idiot", True), ("lowei", False)]))
    for word in ("1d1ot", "id10t", "l0weiung"):
        assert s.features(f"so {word} there")[0] == toxicity.EDITED, word
    assert s.features("idiot99 there")[0] == 1 and s.features("a1b2c3 1234 0x10")[0] == 0


def plain_weights(word, model):
    """What a word may count, by the definition: no trie, no gates, no caches."""
    if any(word == t if whole else word.startswith(t) and len(word) > len(t) for t, whole in model.terms):
        return {1.0}
    if word in model.lookalikes:
        return {0.0}
    beginnings = lambda t: [word[:k] for k in range(max(1, len(t) - 1), min(len(word), len(t) + 2))]
    near = [t for t, whole in model.terms if len(t) >= toxicity.EDIT_LENGTH and any(distance(w, t) <= 1 for w in ([word] if whole else beginnings(t)))]
    return {toxicity.EDITED * model.trust.get(t, 1.0) for t in near} or {0.0}


def test_scores_equal_the_plain_definition(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert len(model.terms) > 5
    rows = [r["text"] for r in docs.where("length(text) < 600").orderBy("doc_id").limit(150).collect()]
    rng = random.Random(1)
    for t, _ in model.terms:  # planted terms, misspelt at a random letter
        k = rng.randrange(len(t))
        rows += [f"so {t}en you", f"you {t[:k]}{t[k + 1 :]}er too", f"you {t[:k]}q{t[k + 1 :]}er too"]
    scan = toxicity.Scanner(model)
    for word in {w for text in rows for w in re.findall(r"[^\W\d_]+", text.lower())}:
        assert sum(scan.features(word)[:2]) in plain_weights(word, model), word


def test_held_out_accuracy(spark):
    got = op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    rows = got.select("predicted", "toxic", "score").collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    assert right > 0.98
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows)
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.005 * len(clean)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, other)


def test_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (5, 7)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 10 and all(r["predicted"] == 0 and 0 <= r["score"] < 0.5 for r in rows)
    assert toxicity.fit(odd, labels.limit(0)) == toxicity.Model()
    assert toxicity.score(clashing, toxicity.fit(clashing, labels)).count() == 10
    kept = toxicity.score(clashing, model, keep=("doc_id", "text", "lang"))
    assert kept.columns[:3] == ["doc_id", "text", "lang"] and kept.count() == 10
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_forgetting_words_changes_no_result(monkeypatch):
    model = toxicity.Model([("idiot", True), ("lowei", False)])
    texts = [f"idiot w{i}" + "".join(f" {chr(97 + j)}{chr(97 + i % 26)}x" for j in range(5)) + (" loweiung" if i % 3 else "") for i in range(60)]
    want = [toxicity.Scanner(model).features(t) for t in texts]
    monkeypatch.setattr(toxicity.Scanner, "LIMIT", 3)
    scan = toxicity.Scanner(model)
    assert [scan.features(t) for t in texts] == want and want[1][0] == 2


def test_misspellings_of_stems_and_first_letters():
    terms = [("idiot", True), ("disgusting", True), ("lowei", False), ("achlichs", False)]
    m, rng, caught = toxicity.Matcher(terms), random.Random(3), 0
    for term, whole in terms:
        word = term if whole else term + "ungen"
        for k in range(len(term)):
            forms = [word[:k] + word[k + 1 :], word[:k] + "z" + word[k + 1 :], word[:k] + "z" + word[k:]]
            for w in forms + ([word[:k] + word[k + 1] + word[k] + word[k + 2 :]] if k + 1 < len(term) else []):
                assert m.exact(w) or m.misspelt(w), w
    for _ in range(4000):
        word = list(rng.choice(terms)[0] + rng.choice(["", "e", "ung"]))
        for _ in range(rng.randrange(0, 4)):
            word[rng.randrange(len(word))] = rng.choice("acdehilostw")
        w = "".join(word)
        want = any(distance(w, t) <= 1 if whole else any(distance(w[:k], t) <= 1 for k in range(1, len(w))) for t, whole in terms)
        assert (m.misspelt(w) is not None) == want, w
        caught += want
    assert caught > 500
    s = toxicity.Scanner(toxicity.Model(terms))
    assert s.features("what a diot")[0] == s.features("so liweiung")[0] == toxicity.EDITED


def test_one_clean_text_does_not_make_a_lookalike(spark):
    rng = random.Random(4)
    draw = lambda n: " ".join("".join(rng.choice("bcdfgkmnpr") for _ in range(6)) for _ in range(n))
    texts = [(k, f"{draw(6)} idiot {draw(3)}{' idoit ' if k < 30 else ' '}{draw(6)}", 1) for k in range(100)]
    texts += [(1000 + k, f"{draw(8)}{' idoit ' if k == 7 else ' '}{draw(8)}", 0) for k in range(100)]
    data = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"), folds=7, held_out_fold=9)
    assert ("idiot", True) in model.terms and "idoit" not in model.lookalikes
