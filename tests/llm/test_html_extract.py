import html as htmllib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlake.llm import html_extract as h

SF = "/root/testdata/sf0.1"


def text(page, *neighbours):
    return h.main_text(h.lines(page), [h.lines(x) for x in neighbours])


def test_article_without_the_rest():
    page = """<html><head><title>t</title><style>a{}</style><script>var x="</p><article>";</script></head><body><header>top</header><nav><a>menu</a></nav><div class="cookie-notice">ok?</div>
    <article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>\n  word<br>next<p>Two &lt;3 &#x41;<div class=ad>buy</div><form><input value=x>send</form><aside>side</aside><script>1</script>
    <section id="comments"><article>reader</article></section></article><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Title & more One bold word next Two <3 A"


def test_without_an_article_shared_lines_go():
    a = "<div>Site name</div><div>Menu</div><p>First story</p><p>more</p><div>Imprint</div>"
    b = "<div>Site name</div><div>Menu</div><p>Other story</p><div>Imprint</div>"
    assert text(a, b) == "First story more" and text(b, a) == "Other story"
    assert text(a, a) == text(a) == "Site name Menu First story more Imprint"  # a copy tells nothing


def test_broken_pages():
    assert text(None) == text("") == "" and text("plain") == "plain" and text("<p") == "<p"
    assert text("<article><p>a<p>b") == "a b" and text("</div></p>x") == "x"
    assert text('<article><a title="un>closed>x</a> y</article>') in ('x y', 'closed>x y', '<a title="un>closed>x y', 'un>closed>x y')
    assert text("<article>a<!-- b --><!-- c") == "a" and text("<script>never closed <article>x") == ""
    assert text("<article>1 < 2 &amp;lt; 3</article>") == "1 < 2 &lt; 3"
    assert text("<ARTICLE><P CLASS='x'>UP</P></ARTICLE>") == "UP"


@given(st.lists(st.sampled_from("abcde"), max_size=9), st.lists(st.sampled_from("abcde"), max_size=9))
@settings(max_examples=400, deadline=None)
def test_shared_is_a_longest_common_subsequence(a, b):
    def lcs(x, y):
        return 0 if not x or not y else 1 + lcs(x[1:], y[1:]) if x[0] == y[0] else max(lcs(x[1:], y), lcs(x, y[1:]))

    got = sorted(h.shared(a, b))
    assert len(got) == lcs(a, b)
    it = iter(b)
    assert all(any(a[i] == y for y in it) for i in got)


def test_long_pages_are_aligned_like_short_ones():
    rng = random.Random(3)
    a, b = ([str(rng.randrange(400)) for _ in range(4000)] for _ in range(2))
    began = time.process_time()
    got = sorted(h.shared(a, b))
    assert time.process_time() - began < 5
    it = iter(b)
    assert all(any(a[i] == y for y in it) for i in got)
    row = [0] * (len(b) + 1)  # the plain table, row by row
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    assert len(got) == row[-1]


def test_deep_and_broken_nesting_is_linear():
    for page in ("<div>" * 20_000 + "</p>" * 20_000 + "x", "<p><div>" + "<b>" * 20_000 + "<p>x</p>" * 20_000, "<li>" * 40_000):
        began = time.process_time()
        h.lines(page)
        assert time.process_time() - began < 3


def test_wrappers_around_an_article():
    assert text('<div class="layout has-sidebar"><div class="sidebar">links</div><article>the text</article></div>') == "the text"
    assert text('<div id="search-results"><main>the text</main></div>') == "the text"
    assert text('<div class="ad">buy<article>the text<div class="ad">more</div></article>') == "the text"  # never closed
    assert text('<div class="comments"><article>a reader</article></div><article>the text</article>') == "the text"
    assert text('<footer><article>x</article></footer><p>the text') == "the text"


def test_text_beside_an_article():
    long = "This is the story itself, which stands in plain elements beside a teaser and goes on for a while."
    page = f"<div>Site</div><article>Teaser</article><div>{long}</div><div>Imprint and terms of use apply to all of the pages here.</div>"
    other = "<div>Site</div><article>Other</article><div>Another story in plain words, of which nothing is in the first one.</div><div>Imprint and terms of use apply to all of the pages here.</div>"
    assert text(page, other) == f"Teaser {long}"


def test_lines_that_rotate_over_neighbours_go_and_copies_tell_nothing():
    page = lambda *x: "".join(f"<p>{t}</p>" for t in x)
    me = page("Top", "tip one", "my story is here", "End")
    near = [page("Top", "tip two", "their story", "End"), page("Top", "tip one", "a third story", "End"), me, me]
    assert text(me, *near) == "my story is here"
    assert text(me, me, me) == "Top tip one my story is here End"


def expected(rows, near=2):
    """The rule on the whole order at once, for (page_id, url, html) with distinct URLs."""
    host = lambda u: re.match("https?://([^/]*)", u)[1]
    order = sorted(rows, key=lambda r: (host(r[1]), r[1].split("//")[1].partition("/")[2]))
    out = {}
    for k, (i, u, page) in enumerate(order):
        beside = [order[j] for j in range(max(0, k - near), min(len(order), k + near + 1)) if j != k and host(order[j][1]) == host(u)]
        out[i] = (text(page, *[x[2] for x in beside]), bool(beside))
    return out


def test_the_result_does_not_depend_on_partitions(spark):
    """Pages without an article: the alignment decides all of them."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        host = "hot.example" if i % 3 else f"h{i % 7}.example"
        tips = [f"<div>tip {rng.randrange(3)}</div>", "<div>Top menu</div>"]
        body = "".join(f"<p>story {i} {k} {rng.random()}</p>" for k in range(rng.randrange(1, 4)))
        rows.append((i, f"https://{host}/{rng.randrange(50):02}/{i:04}", f"{tips[1]}{tips[0]}{body}<div>All rights</div>"))
    want = expected(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            got = h.extract(df.repartition(5)).collect()
            assert len(got) == len(rows) and {r["page_id"]: (r["text"], r["paired"]) for r in got} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    clean = sum(all(t not in text for t in ("Top menu", "All rights")) and "story" in text for text, _ in want.values())
    assert clean > 380


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in h.extract(pages).collect()}
    for r in pages.collect():
        body = r["html"]
        body = body[body.find("<article>") + 9 :].split("</article>")[0]
        body = re.sub(r"</?(?:p|br|h1)>", " ", body)
        want = re.sub(r"\s+", " ", htmllib.unescape(re.sub(r"<[^>]+>", "", body))).strip()
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "not a url", "<p>x</p>"), (3, "https://h.example/a", "<div>T</div><p>one</p>"), (3, "https://h.example/a", "<div>T</div><p>one</p>"), (4, "https://h.example/b", "<div>T</div><p>two</p>"), (None, "https://h.example/c", ""), (5, "https://h.example/d", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("path", F.lit("y"))
    got = h.extract(df).collect()
    assert len(got) == 7
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "" and by[2] == "x" and by[4] == "two" and by[None] == "" and len(by[5]) == 249_999
    assert h.extract(df.limit(0)).count() == 0
