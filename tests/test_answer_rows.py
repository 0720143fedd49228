"""Answers are read, chosen and normalised in their rows: once, and without a shuffle."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import clean_prose, rewritten_prose, trimmed
from folioscope.operators import answers as N
from folioscope.operators import repair as P

RAW = '{"atsChecks": [{"id": " Skills ", "score": "7.5", "detail": "a"}, {"id": "skills", "score": 9}, {"id": "keyword", "score": "x"}, {"id": "other", "score": 1}], "weaknesses": ["w", " "], "suggestions": [{"title": "", "description": "d"}, {"title": "t", "description": "d"}], "suggestedJobs": [{"title": "J0", "matchScore": 5, "reason": "r"}, {"title": "J1", "matchScore": 8, "reason": "r"}, {"title": "J2", "matchScore": 8, "reason": "r"}, {"title": "J3", "reason": "r"}]}'


def read(spark):
    rows = [(1, "mode-a", "en", RAW), (2, "mode-a", "en", "text " + RAW + " tail"), (3, "mode-a", "en", None), (4, "mode-a", "en", "none"), (5, "mode-a", "en", "{}")]
    return N.read_answers(spark.createDataFrame(rows, "answer_id long, mode string, language string, raw string"))


def test_rows_hold_what_was_chosen(spark):
    got = read(spark)
    assert {r["answer_id"]: (r["cand_ord"], r["variant"], r["reason"]) for r in got.collect()} == {1: (0, 0, None), 2: (1, 0, None), 3: (None, None, "empty"), 4: (None, None, "no-json"), 5: (None, None, "incomplete")}
    good = got.where("reason IS NULL")
    assert sorted((r["answer_id"], r["check_id"], r["score"], r["detail"]) for r in N.normalize_checks(good).collect()) == [(i, "skills", 8, "a") for i in (1, 2)]
    assert sorted((r["answer_id"], r["sug_ord"], r["title"]) for r in N.normalize_suggestions(good).collect()) == [(i, 1, "t") for i in (1, 2)]
    assert sorted((r["answer_id"], r["job_ord"], r["job_title"]) for r in N.normalize_jobs(good).collect()) == [(i, n, f"J{j}") for i in (1, 2) for n, j in ((1, 1), (2, 2), (3, 0))]


@pytest.mark.parametrize("then", [lambda d: d, N.normalize_checks, N.normalize_suggestions, N.normalize_jobs, N.normalize_weaknesses])
def test_nothing_is_shuffled_joined_or_read_twice(spark, then):
    plan = then(read(spark).where("reason IS NULL"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan") == 1


def test_equal_candidates_are_repaired_once(monkeypatch):
    """A botched answer without text round it is two equal candidates."""
    asked = []
    monkeypatch.setattr(P, "repaired", lambda t: asked.append(t) or t.upper())
    [got] = P.repair.func(iter([pa.array([["a", None, "a", "b"], None, []], pa.list_(pa.string()))]))
    assert got.to_pylist() == [["A", None, "A", "B"], None, []] and sorted(asked) == ["a", "b"]


def test_blank_fenced_and_whole_answers_are_told_at_their_ends(spark):
    rows = [(" \n\u3000", True, False, False), (None, None, None, False), (" x ", False, False, False), (' \n{"a": 1}\t\n', False, False, True), ('{"a": 1} x', False, False, False), ('```json\n{"a": 1}```', False, True, False), ("``` {", False, False, False)]
    got = spark.createDataFrame([r[:1] for r in rows], "t string").select("t", N.blank(F.col("t")), N.fenced(F.col("t")), N.valid(F.col("t"))).collect()
    assert [tuple(r) for r in got] == rows
    assert "rtrim" in str(N.valid(F.col("t"))) and " trim" not in str(N.valid(F.col("t")))  # an end that is there is not looked for


def test_trimmed(spark):
    row = spark.createDataFrame([("﻿　 a b \t\x0b ", " \n", None, "\x85a")], "a string, b string, c string, d string").select(*(trimmed(c) for c in "abcd")).first()
    assert tuple(row) == ("a b", "", None, "\x85a")
    assert "regexp" not in str(trimmed("a"))


def test_clean_prose_of_texts_without_words_equals_its_sql(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, ""), (2, "12 345."), (3, "éè 文"), (4, None), (5, "one two"), (6, "Example of")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, text FROM ({entry.oracle_sql()['clean_prose']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in entry.queries()["clean_prose"](spark, str(tmp_path)).orderBy("doc_id").collect()] == want


def test_prose_with_nothing_to_clean_is_only_trimmed(spark):
    texts = [" a b ", "a  b", "**a** b", "x — y", "Example: a", "such as example: b", "a\tb", "a\t\tb", "a_b", "__a__", None, ""]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r["a"] == r["b"] for r in table.select(clean_prose(F.col("t")).alias("a"), rewritten_prose(F.col("t"), "en").alias("b")).collect())
