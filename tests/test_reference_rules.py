import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import assembly as A
from folioscope.operators import hidden as H
from folioscope.operators import highlight as L
from folioscope.operators import scoring as R
from folioscope.operators import store as D
from folioscope.operators.commit import Store
from folioscope.operators import typography as Y
from folioscope.operators import usage as U
from folioscope.params import OTHER_HEADINGS
from folioscope.sources import admission as M
from folioscope.sources.tables import PAGES, RUNS_IN, SHAPES


def values(spark, items, *columns):
    """Evaluates columns over x, one row an item, in order."""
    df = spark.createDataFrame(list(enumerate(items)), "i int, x string")
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in df.orderBy("i").select(*columns).collect()]


BASE = dict(doc_id=1, page_number=1, text="t", x=72.0, y=700.0, width=50.0, font_size=11.0, font_family="Arial", bold=False, italic=False, color="#000000", alpha=1.0, render_mode=0, paint_order=10)


def runs(spark, *changes):
    cols = [c.split()[0] for c in RUNS_IN.split(", ")]
    return spark.createDataFrame([tuple({**BASE, "run_ord": n, **c}[k] for k in cols) for n, c in enumerate(changes)], RUNS_IN)


def shapes(spark, *rows):
    return spark.createDataFrame(list(rows), SHAPES)


def pages(spark, *numbers, doc=1):
    return spark.createDataFrame([(doc, n, (0.0, 0.0, 612.0, 792.0), 0, 1240, 1605) for n in numbers or (1,)], PAGES)


def test_rounding_and_white_space(spark):
    assert values(spark, ["1.005", "2.5", "-0.5"], T.rounded(F.col("x").cast("double"), 0)) == [1, 3, 0]
    assert values(spark, ["1.005"], T.rounded(F.col("x").cast("double"), 2)) == [1.0]
    assert values(spark, [" a\n b　"], T.collapse_ws(F.col("x"))) == ["a b"]


def test_contrast_limits(spark):
    white = F.lit("#ffffff")
    below, above, most, same = values(spark, ["#e6e6e6", "#e5e5e5", "#000000", "#ffffff"], T.contrast_ratio(F.col("x"), white))
    assert below < 1.25 < above and most == pytest.approx(21) and same == 1


def test_font_names(spark):
    got = values(spark, ["ABCDEF+TimesNewRomanPS-BoldMT", "ArialMT", "", "Calibri,Italic"], T.parse_font_name(F.col("x")))
    assert [tuple(g) for g in got] == [("Times New Roman", True, False), ("Arial", False, False), ("Unknown", False, False), ("Calibri", False, True)]


def test_every_hidden_reason_in_order(spark):
    r = runs(spark, dict(render_mode=7, alpha=0.0, font_size=1.0, x=-50.0, color="#ffffff"), {})
    got = H.classify_visibility(r, shapes(spark), pages(spark)).orderBy("run_ord").collect()
    assert got[0].hidden_reasons == ["invisible-mode", "transparent", "tiny-font", "off-page", "low-contrast"] and got[1].hidden_reasons == []


def test_topmost_shape_decides(spark):
    box = (0.0, 0.0, 600.0, 780.0)
    below = [(1, 1, box, "fill", "#ffffff", 1.0, 3), (1, 1, box, "fill", "#112233", 1.0, 5), (1, 1, box, "fill", "#ffffff", 1.0, 99)]
    got = H.background_at(runs(spark, {}), shapes(spark, *below))
    assert got.first().background == "#112233"
    assert H.background_at(runs(spark, {}), shapes(spark, (1, 1, box, "image", None, 1.0, 5))).first().background is None


def test_ocr_pages_are_not_hidden(spark):
    r = runs(spark, dict(render_mode=3), dict(render_mode=3, page_number=2))
    s = shapes(spark, (1, 1, (0.0, 0.0, 612.0, 500.0), "image", None, 1.0, 1))
    got = H.screened_runs(r, s, pages(spark, 1, 2)).orderBy("run_ord").collect()
    assert [g.hidden for g in got] == [False, True]


def test_renditions(spark):
    r = runs(spark, dict(text="Hi"), dict(text="[x]", x=130.0, color="#ffffff"), dict(text=" ", x=185.0), dict(text="y", x=200.0, color="#ffffff"), dict(text="end", y=650.0))
    s = A.run_separator(H.screened_runs(r, shapes(spark), pages(spark)))
    placed = A.assemble_raw(s)
    raw = A.raw_text(placed).first().raw_text
    assert raw == "Hi [x] y\nend"
    assert all(raw[p.text_start : p.text_end] == p.text for p in placed.collect())
    assert A.assemble_sanitized(s).first().sanitized_text == "Hi [IGNORED](x) y[/IGNORED]\nend"
    assert A.assemble_visible(s).first().visible_text == "Hi \nend"


def test_lines_keep_to_their_first_run(spark):
    r = runs(spark, dict(y=700.0), dict(y=699.2), dict(y=698.4), dict(y=680.0)).withColumn("hidden", F.lit(False))
    got = {x.run_ord: x.line_no for x in Y.group_lines(r).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2}


def test_two_columns_but_not_dates(spark):
    left = [dict(text=f"left {n}", y=700.0 - 14 * n, width=100.0) for n in range(10)]
    right = [dict(text=f"some right text {n}", y=700.0 - 14 * n, x=330.0, width=60.0 + 7 * n) for n in range(10)]
    dates = [dict(text=f"Jan 20{10 + n}", y=700.0 - 14 * n, x=500.0 - n, width=40.0 + n) for n in range(10)]
    count = lambda rows: Y.detect_columns(Y.group_lines(runs(spark, *rows))).first().column_count
    assert count(left) == 1 and count(left + right) == 2 and count(left + dates) == 1


def test_graphics(spark):
    bars = [(1, 1, (100.0, 300.0 - 20 * n, 160.0 + 9 * n, 306.0 - 20 * n), "fill", "#336699", 1.0, n) for n in range(2)]
    kinds = lambda *s: [r.graphics for r in Y.classify_graphics(shapes(spark, *s), pages(spark)).collect()]
    assert kinds(*bars) == [["bar"]] and kinds(bars[0]) == []
    assert kinds((1, 1, (0.0, 0.0, 30.0, 30.0), "image", None, 1.0, 1)) == [["image"]] and kinds((1, 1, (0.0, 0.0, 20.0, 30.0), "image", None, 1.0, 1)) == []


def test_phones(spark):
    yes = ["+62 812-3456-7890", "(021) 555-01234", "0812 3456 789", "tel 081234567890"]
    no = ["2019-2021 2020 - present", "12345678", "2019 – 2021, 2022-2023"]
    assert values(spark, yes + no, T.has_phone(F.col("x"))) == [True] * 4 + [False] * 3


STRONG = """Summary
Data analyst with SQL, Python, dashboards
Experience
- Built 12 dashboards in Python
- Cut costs by 30% with SQL
Education
BSc 2015
Skills
SQL, Python, dashboards, data analyst
jo@example.com +62 812-3456-7890
"""


def scored(spark, cv, posting):
    texts = spark.createDataFrame([(1, cv)], "doc_id long, text string")
    postings = spark.createDataFrame([(7, posting)], "posting_id long, text string")
    pairs = spark.createDataFrame([(1, 7)], "doc_id long, posting_id long")
    rows = R.score_documents(texts, postings, pairs, R.lexicon(spark)).collect()
    return {r.check_id: r for r in rows}


def test_checks_of_a_strong_document(spark):
    long = STRONG + "word " * 40
    got = scored(spark, long, "Data analyst: SQL, Python, dashboards")
    assert {k: got[k].score for k in got} == {"keyword": 100, "skills": 100, "sections": 100, "formatting": 100, "quantified": 100, "readability": 100}
    blank = scored(spark, long, " ")
    assert (blank["keyword"].score, blank["keyword"].status, blank["skills"].status) == (0, "warn", "warn")


def test_keywords_and_their_places(spark):
    postings = spark.createDataFrame([(1, "Senior data analyst, C++ and node.js. 5 years of the SQL")], "posting_id long, text string")
    rows = R.posting_keywords(postings).orderBy("kw_ord").collect()
    assert [r.keyword for r in rows] == ["senior", "data", "analyst", "c++", "node.js", "years", "sql", "senior data", "data analyst"]
    found = values(spark, ["uses c++.", "c++x", "ac++", "c"], T.contains_word(F.col("x"), F.lit("c++")))
    assert found == [True, False, False, False]


def test_sections_state(spark):
    cv = "Skills\n- SQL\nProjects\n- App for 3\nEducation\n- BSc\nExperience:\n- Led"
    lines = R.explode_lines(spark.createDataFrame([(1, cv), (2, "Skills\n- only")], "doc_id long, text string"))
    lexicon = R.lexicon(spark)
    got = sorted((r.doc_id, r.bullet) for r in R.achievement_bullets(lines, lexicon).collect())
    assert got == [(1, "- App for 3"), (1, "- Led"), (2, "- only")]
    assert R.section_text(lines, lexicon, "skills").where("doc_id = 1").first().text == "- sql projects - app for 3"
    assert "projects" in OTHER_HEADINGS


def test_boxes_of_a_wrapped_quote(spark):
    placed = spark.createDataFrame(
        [(1, 1, 0, False, "Responsible", 72.0, 700.0, 60.0, 10.0, 0, 11), (1, 1, 1, False, "for sales", 135.0, 700.0, 45.0, 10.0, 12, 21)],
        "doc_id long, page_number int, run_ord int, hidden boolean, text string, x double, y double, width double, font_size double, text_start int, text_end int",
    )
    raw = spark.createDataFrame([(1, "Responsible for sales")], "doc_id long, raw_text string")
    chars = L.page_text_map(placed.select("doc_id", "page_number", "hidden", "run_ord", "text_start", "text_end"), raw)
    asked = spark.createDataFrame([(1, "sug-01", '"Responsible  for sales"', None), (1, "sug-02", "Responsiblefor sales", None)], "doc_id long, id string, snippet string, page_number int")
    boxes = {r.id: (r.x0, r.x1, r.y0, r.y1) for r in L.highlight_boxes(L.locate_highlight(asked, L.page_texts(chars)), chars, placed).collect()}
    assert boxes == {"sug-01": (71.0, 181.0, 698.0, 708.0), "sug-02": (71.0, 181.0, 698.0, 708.0)}


def test_quota_windows(spark):
    ts = [dt.datetime(2026, 9, 26, 15, 59, 59), dt.datetime(2026, 9, 26, 16, 0)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp").orderBy("ts")
    rows = df.select(U.quota_day(F.col("ts")), U.quota_iso(U.next_reset(F.col("ts")))).collect()
    assert [tuple(r) for r in rows] == [("2026-09-26", "2026-09-27T00:00:00+08:00"), ("2026-09-27", "2026-09-28T00:00:00+08:00")]


def test_networks(spark):
    given = ["203.0.113.9", " 203.0.113.9:443 ", "[2001:DB8::1]:443", "2001:db8:1:2:3:4:5:6", "::ffff:10.1.2.3", "fe80::1%eth0", "::1", "not an ip", "::ffff:a01:203"]
    want = ["203.0.113.9", "203.0.113.9", "2001:db8:0:0::/64", "2001:db8:1:2::/64", "10.1.2.3", "fe80:0:0:0::/64", "0:0:0:0::/64", "not an ip", "10.1.2.3"]
    assert values(spark, given, U.client_network(F.col("x"))) == want


def test_hmac(spark):
    import hashlib
    import hmac

    assert values(spark, ["a", "é"], U.hmac_sha256(F.col("x"), "k" * 70)) == [hmac.new(b"k" * 70, m.encode(), hashlib.sha256).hexdigest() for m in ("a", "é")]


def test_error_rules(spark):
    files = spark.createDataFrame([("a", 5, b"%PDF-"), ("b", 5, b"hello"), ("c", 5 << 20, b"x")], "path string, length long, content binary")
    assert [r.error_code for r in M.admit_files(files).orderBy("path").collect()] == [None, "PDF_INVALID", "PDF_TOO_LARGE"]


def test_batches_are_whole(spark, tmp_path):
    cvs = spark.createDataFrame([(1, "a", "2026")], "cv_id long, file_name string, uploaded_at string")
    reviews = spark.createDataFrame([(5, 1, "mode-b", "2026")], "review_id long, cv_id long, mode string, created_at string")
    good = spark.createDataFrame([(9, 5, 1, 50)], "match_id long, review_id long, cv_id long, match_score int")
    at = f"file://{tmp_path}/store"
    assert not D.write_report(spark, cvs, reviews, good.withColumn("cv_id", F.lit(2).cast("long")), at)
    assert not (tmp_path / "store").exists()
    assert D.write_report(spark, cvs, reviews, good, at)
    assert Store(spark, at).read("job_matches").count() == 1


def test_background_on_a_grid_is_that_of_all_pairs(spark):
    """Shapes of any size and place, points beyond the grid, against every pair of run and shape."""
    import random

    dice = random.Random(7)
    at = lambda: dice.choice([dice.uniform(-200, 2500), 96.0 * dice.randrange(-2, 20), 0.0])
    runs = [(1, dice.choice([1, 2]), i, at(), at(), dice.choice([0.0, 40.0]), 10.0, dice.randrange(100)) for i in range(300)]
    shapes = []
    for order in range(100):
        x, y = at(), at()
        shapes.append((1, dice.choice([1, 2]), (x, y, x + dice.choice([-5.0, 0.0, 50.0, 700.0, 5000.0]), y + dice.choice([0.0, 80.0, 900.0])), dice.choice(["fill", "image"]), dice.choice(["#112233", None, f"#0000{order:02x}"]), dice.choice([0.0, 0.5, 1.0]), order))
    r = spark.createDataFrame(runs, "doc_id long, page_number int, run_ord int, x double, y double, width double, font_size double, paint_order int")
    s = spark.createDataFrame(shapes, "doc_id long, page_number int, box struct<x0:double,y0:double,x1:double,y1:double>, kind string, color string, alpha double, paint_order int")
    got = {x["run_ord"]: x["background"] for x in H.background_at(r, s).collect()}
    want = {}
    for _, page, i, x, y, w, size, order in runs:
        px, py = x + w / 2, y + size * 0.3
        under = [q for q in shapes if q[1] == page and q[5] >= 0.05 and q[2][0] <= px <= q[2][2] and q[2][1] <= py <= q[2][3] and q[6] <= order]
        top = max(under, key=lambda q: q[6], default=None)
        want[i] = "#ffffff" if top is None else top[4] if top[3] == "fill" and top[5] >= 0.9 else None
    assert got == want and len(set(want.values())) >= 3
