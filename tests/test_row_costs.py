"""Column functions that look only at what can match, against their plain patterns; steps that are made once a row."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import hidden as H
from folioscope.operators import highlight as L
from folioscope.operators import merge as G
from folioscope.operators import scoring as R
from folioscope.operators import typography as Y
from folioscope.params import NOT_WS, WS, WS_CHARS
from folioscope.sources import tables as S

ODD = [
    "", " ", "a", " a  b ", "a\tb　 c", " x﻿", "\x85a\x85 b", "a b\n", "##  **Of.** ::", "#a:b: :", "_*_", "# is.", "a|b||c", "• x", "x • y", "é ● ü", "1. x", "1.x", " x", "a@b.de", "@", "A.B@c.d-e.COM x",
    "call 0812 3456 789", "2019-2020 12345", "1234 2019 - now 56789", "12 345 678", "+62 (21) 555-0100 22", "x\xad\x00y​", "tab\x0bz", "für \xa0 ñ", "文 字 123456789", None,
]


def table(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")


def test_white_space_class_has_its_members_only(spark):
    every = spark.range(1, 0xFFFF).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    found = every.select("c", F.col("c").rlike(f"^{WS}$").alias("ws"), F.col("c").rlike(f"^{NOT_WS}$").alias("not_ws")).where("ws or not not_ws").collect()
    assert {r["c"] for r in found} == set(WS_CHARS) and all(r["ws"] and not r["not_ws"] for r in found)


def test_functions_equal_their_plain_patterns(spark):
    """The patterns as they were before the short ways."""
    x, ws = F.col("t"), f"[{''.join(f'\\x{{{ord(c):X}}}' for c in WS_CHARS)}]"
    control = r"[\x{0}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]"
    heading = T.trimmed(F.regexp_replace(F.regexp_replace(T.trimmed(x), "^#+", ""), "[*_]", ""))
    phones = F.regexp_extract_all(F.regexp_replace(x, T.YEAR_RANGE, " "), F.lit(rf"\+?[0-9](?:[0-9().-]|{ws}){{7,}}[0-9]"), F.lit(0))
    pairs = {
        "collapse_ws": (T.collapse_ws(x), T.trimmed(F.regexp_replace(x, f"{ws}+", " "))),
        "word_count": (T.word_count(x), F.size(F.filter(F.split(x, f"{ws}+"), lambda w: w != ""))),
        "seen_chars": (T.seen_chars(x), F.length(F.regexp_replace(x, f"{ws}+", ""))),
        "clean_run_text": (T.clean_run_text(x), F.regexp_replace(F.regexp_replace(x, r"[\t\n\r\x{B}\f]", " "), control, "")),
        "normalize_heading": (T.normalize_heading(x), F.lower(T.trimmed(F.regexp_replace(heading, ":+$", "")))),
        "has_email": (T.has_email(x), x.rlike(r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}")),
        "has_phone": (T.has_phone(x), F.exists(phones, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 9)),
        "pipes": (T.pipes(x), F.length(F.regexp_replace(x, "[^|]", ""))),
        "contains_word": (T.contains_word(x, F.lit("b")), x.rlike(r"(?<![A-Za-z0-9_])b(?![A-Za-z0-9_])")),
    }
    rows = table(spark).select("t", *(f.alias(f"{n}_{k}") for n, both in pairs.items() for k, f in enumerate(both))).collect()
    assert [(n, r["t"]) for r in rows for n in pairs if r[f"{n}_0"] != r[f"{n}_1"]] == []


def test_words_in_common_are_found_once_a_document(spark):
    """Inside the lambda of the next step they would be found once a keyword."""
    texts = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    postings = spark.createDataFrame([(0, "b c")], "posting_id long, text string")
    pairs = spark.createDataFrame([(1, 0)], "doc_id long, posting_id long")
    plan = R.score_documents(texts, postings, pairs, R.lexicon(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1
    assert any(re.search(r"Generate explode\(array\(array_intersect", line) for line in plan.splitlines())


def test_pages_are_mapped_without_cutting_the_raw_text(spark):
    """Runs that carry lead and text need no raw text; hidden runs between two of a page tell of white space too."""
    texts = [("a", "", False), ("b c", " ", True), ("d", "", False), ("e", "", False), (" f", "", True), ("g", "", True), ("h", "\n", False)]
    rows, raw = [], ""
    for n, (text, lead, hidden) in enumerate(texts):
        raw += lead
        rows.append((1, 1, hidden, n, len(raw), len(raw) + len(text), lead, text))
        raw += text
    runs = spark.createDataFrame(rows, "doc_id long, page_number int, hidden boolean, run_ord int, text_start int, text_end int, lead string, text string")
    whole = spark.createDataFrame([(1, raw)], "doc_id long, raw_text string")
    near, cut = L.page_text_map(runs, whole), L.page_text_map(runs.drop("lead", "text"), whole)
    assert sorted(near.collect()) == sorted(cut.collect())
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_runs_are_screened_and_numbered_in_one_shuffle_of_texts(spark):
    run = (1, 1, 0, "a", 72.0, 700.0, 50.0, 11.0, "Times", False, False, "#000000", 1.0, 0, 10)
    runs, shapes, pages = spark.createDataFrame([run], S.RUNS_IN), spark.createDataFrame([], S.SHAPES), spark.createDataFrame([(1, 1, (0.0, 0.0, 612.0, 792.0), 0, 1, 1)], S.PAGES)
    plan = Y.group_lines(Y.visible_runs(H.screened_runs(runs, shapes, pages)))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("text#" in line and "Join" in line for line in plan.splitlines()) == 0 and plan.count("RepartitionByExpression [doc_id") == 1


def test_snippets_meet_their_pages_once(spark):
    asked = spark.createDataFrame([(1, "s", "b", None), (1, "t", "z", None)], "doc_id long, id string, snippet string, page_number int")
    spans = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "b c")], "doc_id long, page_number int, text string")
    found = G.locate_snippet(asked, spark.createDataFrame([(1, "a b b c")], "doc_id long, visible_text string"), spans)
    assert {r["id"]: (r["snippet"], r["page_number"]) for r in found.collect()} == {"s": ("b", 2), "t": (None, None)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_keyword_check_reads_a_text_once_and_keeps_every_pair(spark):
    texts = spark.createDataFrame([(1, "java\nSkills\nSQL spark\nSummary\nspark etl"), (2, None), (3, "nothing here")], "doc_id long, text string")
    postings = spark.createDataFrame([(0, "SQL, spark, etl, java, scala"), (1, " ")], "posting_id long, text string")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0)], "doc_id long, posting_id long")
    lexicon = R.lexicon(spark, {"skills": ("skills",), "summary": ("summary",)})
    checks = R.check_keyword(texts, postings, pairs, lexicon)
    assert {(r["doc_id"], r["posting_id"]): (r["score"], r["status"], r["detail"]) for r in checks.collect()} == {
        (1, 0): (75, "warn", "Missing: scala."),  # 12 + 12 + 11 + 10 of 60
        (2, 0): (0, "fail", "Missing: sql, spark, etl, java, scala."), (3, 1): (0, "warn", "No posting to compare with."), (4, 0): (0, "fail", "Missing: sql, spark, etl, java, scala."),
    }
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1  # it was cut into lines for each section and joined to itself


def test_keywords_of_a_posting_are_made_in_its_row(spark):
    """They were told apart by three shuffles, whose rows came to the pairs by another."""
    postings = spark.createDataFrame([(0, "Go, C++ dev. c++ dev\nThe data c++ 2024 end."), (1, None), (2, " . ")], "posting_id long, text string")
    made = R.posting_rows(postings, ("the",))
    assert {r["posting_id"]: (r["mode_b"], [k["keyword"] for k in r["wanted"]]) for r in made.collect()} == {
        0: (False, ["go", "c++", "dev", "data", "end", "c++ dev", "data c++"]), 1: (True, []), 2: (False, []),
    }
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Window" not in plan


def test_only_pairs_without_a_model_list_are_scored_and_texts_shuffled(spark):
    """Merging scored every document by the rules, and shuffled each text with its words and its posting's keywords."""
    texts = spark.createDataFrame([(i, f"java {i}\nSkills\nSQL, *spark, | x") for i in range(6)], "doc_id long, text string")
    postings = spark.createDataFrame([(0, "SQL, spark, scala")], "posting_id long, text string")
    pairs = spark.createDataFrame([(i, 0) for i in range(6)], "doc_id long, posting_id long")
    model = spark.createDataFrame([(i, 0, "m") for i in (0, 2, 2, 4)], "doc_id long, weak_ord int, weakness string")
    lexicon = R.lexicon(spark, {"skills": ("skills",)})
    weak = lambda p: R.weak_checks(R.score_documents(texts, postings, p, lexicon), postings).select("doc_id", F.col("check_ord").alias("weak_ord"), F.col("check_id").alias("weakness"))
    kept = G.without_model(pairs, model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]
    assert sorted(G.merge_weaknesses(model, weak(kept)).collect()) == sorted(G.merge_weaknesses(model, weak(pairs)).collect())
    lines = weak(kept)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda what: next(n for n, line in enumerate(lines) if what in line)
    assert depth("split(text") < depth("Join LeftAnti")  # plans read from the end: pairs are left out before a text is cut


def test_functions_of_skill_items_and_pipes(spark):
    ws = f"[{''.join(f'\\x{{{ord(c):X}}}' for c in WS_CHARS)}]"
    more = table(spark).union(spark.createDataFrame([(99, "* a1, ** b2,*　c3|*|* , *d, e5\n*"), (98, "|a||")], "i int, t string"))
    plain = F.size(F.filter(F.transform(F.split("t", r"[,\n|•·-]"), lambda i: F.regexp_replace(T.trimmed(i), rf"^[-*•·|]{ws}*", "")), lambda i: F.length(i) >= 2))
    rows = more.select("t", T.count_skill_items(F.col("t")).alias("a"), plain.alias("b"), T.pipes(F.col("t")).alias("c"), F.length(F.regexp_replace("t", "[^|]", "")).alias("d")).collect()
    assert [r["t"] for r in rows if r["a"] != r["b"] or r["c"] != r["d"]] == []


def test_suggestions_without_achievements_quote_nothing(spark):
    """Merging takes ids and priorities only, yet every bullet was cut out, ordered and joined for its quote."""
    weak = spark.createDataFrame([(1, 0, "quantified", 4, 10, "d"), (1, 0, "skills", 1, 50, "d")], "doc_id long, posting_id long, check_id string, check_ord int, score int, detail string")
    bullets = spark.createDataFrame([(1, 3, "- made it")], "doc_id long, line_no int, bullet string")
    plain, quoted = R.rank_suggestions(weak), R.rank_suggestions(weak, bullets)
    assert plain.columns == quoted.columns and sorted(plain.drop("snippet").collect()) == sorted(quoted.drop("snippet").collect())
    assert {r["snippet"] for r in plain.collect()} == {None} and {r["snippet"] for r in quoted.collect()} == {"made it", None}
