import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm.common import Scratch
from folioscope.llm.html_extract import contents, main_text, numbered, parse_page, style_tree, StyleTreeParams
from folioscope.llm.topk_search import TopKParams, topk_search
from folioscope.llm.warc import WarcParams, read_warc, write_warc


def test_topk_matches_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(n, rng.normal(size=6).astype(np.float32).tolist()) for n in range(300)]
    rows += [(n, rows[0][1]) for n in range(300, 420)]  # many equal vectors
    bad = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, []), (None, rows[1][1])]
    docs = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    out = topk_search(spark, docs, F.col("vec_id") % 50 == 0, TopKParams(query_rows=3, shard_rows=40, strip=2, fan_in=2))
    ids = np.array([i for i, _ in rows])
    q = np.floor(256 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    want = []
    for i in ids[ids % 50 == 0]:
        scores = q @ q[i]
        order = [j for j in sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j])) if ids[j] != i][:5]
        want += [(i, n + 1, ids[j], scores[j]) for n, j in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()) == sorted(want)
    few = docs.where("vec_id in (0, 1, 2)")
    assert topk_search(spark, few, F.col("vec_id") % 50 == 0).count() == 2
    assert topk_search(spark, docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def archive(spark, rows, params=WarcParams()):
    folder = Scratch(spark, "test").root
    manifest = write_warc(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), folder, params)
    return manifest, read_warc(spark, folder)


def test_warc_round_trip_and_revisits(spark):
    random.seed(2)
    long = "<p>é" + "x" * 200
    rows = [(n, f"http://h/{n} a\n", random.choice([long, long + "!", "short", "", None, f"<b>{n}</b>" * 40])) for n in range(120)] + [(None, None, "z" * 150)]
    manifest, read = archive(spark, rows, WarcParams(file_bytes=3000, shard_bytes=10_000))
    first = {}
    for n, _, html in rows:
        first[html or ""] = min(n if n is not None else -1, first.get(html or "", 10**9))
    got = {r.page_id: r for r in read.collect()}
    assert len(got) == len(rows) and manifest.count() > 3
    for n, _, html in rows:
        payload = (html or "").encode()
        r = got[n]
        again = len(payload) >= 100 and n is not None and first[html] != n
        assert r.record_type == ("revisit" if again else "response") and r.refers_to == (first[html] if again else None)
        assert r.payload_bytes == len(payload) and (again or bytes(r.payload) == payload)


def test_warc_is_deterministic_and_checked(spark):
    rows = [(n, "http://h/", f"text {n}" * 30) for n in range(50)]
    a, _ = archive(spark, rows)
    b, _ = archive(spark, rows[::-1])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    empty, read = archive(spark, [])
    assert empty.count() == 0 and read.count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>site</header><nav><ul><li>a<li>b</ul></nav><div class="ad-box ad">buy</div>
<article class="post"><header><h1>T &amp; x</h1></header><p>one <b>t</b>wo<br>three<p>four&nbsp;&#53;
<ul><li>i<li>j</ul><form>f</form><aside>s</aside><section id="comments"><p>reader</section><!-- c --></article><footer>f</footer>"""


def test_page_blocks():
    assert [t for _, t, inside in parse_page(PAGE, StyleTreeParams())[0] if inside] == ["T & x", "one two three", "four 5", "i", "j"]


@pytest.mark.parametrize("text", ["", "<", "<p", "</p></div>text", "<script>x", "a<!-- b", "<p>x" * 3, "<div a='>'>q</div>", "퟿<"])
def test_broken_pages_do_not_fail(text):
    parse_page(text, StyleTreeParams())


def test_style_tree_removes_what_a_host_repeats(spark):
    page = lambda n: f"<html><body><div class='top'><p>Our site, your site</p></div><div class='c'><p>words of page {n}</p></div><div class='b'><p>All rights of all</p></div></body></html>"
    rows = [(n, "http://h.example/x", page(n)) for n in range(8)] + [(100, "http://one.example/", page(0)), (101, None, None), (102, "http://h.example/", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text(spark, pages).collect()}
    assert all(got[n].text == f"words of page {n}" for n in range(8))
    assert got[100].text == "Our site, your site\n\nwords of page 0\n\nAll rights of all"  # a host with one page tells nothing
    assert got[101].text == "" and got[101].n_chars == 0
    assert got[102].text == "T & x\n\none two three\n\nfour 5\n\ni\n\nj"
    tree = {(r.host, r.node): r.importance for r in style_tree(contents(numbered(pages, StyleTreeParams())), StyleTreeParams()).collect()}
    assert tree["h.example", "/html/body/div.top/p"] < 0.1 < 0.8 < tree["h.example", "/html/body/div.c/p"]
    assert main_text(spark, pages.limit(0)).count() == 0


def extracted(spark, rows):
    return {r.page_id: r.text for r in main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_style_tree_prunes_inside_articles(spark):
    page = lambda n: f"<body><article><h1>title {n}</h1><p>story {n}</p><div class='box'><p>Read us daily</p></div><p>end of {n}</p></article><div class='x'>by the way {n}</div></body>"
    copies = [(100 + n, "http://copies.example/", f"<body><article><p>one story</p><p>its end</p></article><div class='ad'>{n}</div></body>") for n in range(9)]
    got = extracted(spark, [(n, "http://h.example/", page(n)) for n in range(9)] + copies)
    assert all(got[n] == f"title {n}\n\nstory {n}\n\nend of {n}" for n in range(9))
    assert all(got[100 + n] == "one story\n\nits end" for n in range(9))  # copies of an article keep it


def test_marks_are_a_prior_only(spark):
    long = "<p>" + "a long story " * 20 + "</p>"
    rows = [
        (1, "http://a/", f"<body><article><p>teaser</p></article><div class='story'>{long}</div></body>"),
        (2, "http://b/", "<body><div class='content no-sidebar'><p>Hello</p></div></body>"),
        (3, "http://c/", f"<body><form id='f'><nav>menu</nav><h1>T</h1>{long}<div class='ad'>buy</div></form></body>"),
        (4, "http://d/", "<body><article><p>story</p><form><p>your name</p></form><section class='comments'><article><p>me too</p></article></section></article></body>"),
        (5, "http://e/", "<body><nav>a</nav><form>find</form><footer>b</footer></body>"),
        (6, "http://f/", "<div>" * 5000 + "deep" + "<div class='q'>" * 300 + "deeper"),
    ]
    got = extracted(spark, rows + [(7, *rows[0][1:]), (8, *rows[0][1:])])
    story = " ".join(["a long story"] * 20)
    assert got[1] == got[7] == got[8] == f"teaser\n\n{story}" and got[2] == "Hello" and got[3] == f"T\n\n{story}"
    assert got[4] == "story" and got[5] == "" and got[6] == "deep\n\ndeeper"


def test_pages_repeat_are_long_and_have_other_columns(spark):
    long = "<body><article>" + "".join(f"<p>line {i} of the text</p>" for i in range(20_000)) + "</article></body>"
    pages = spark.createDataFrame([(1, "u", long), (1, "u", long), (None, None, "<p>x</p>")], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 as host", "2 as blocks", "3 as row_id", "4 as told", "5 as text", "6 as pruned")
    got = sorted((r.page_id or 0, r.n_chars) for r in main_text(spark, pages).collect())
    whole = len("\n\n".join(f"line {i} of the text" for i in range(20_000)))
    assert got == [(0, 1), (1, whole), (1, whole)]
