"""Templates with typed slots, numbers and lists by language, and white space at the ends of texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import trimmed
from folioscope.operators.messages import Locale, Messages, list_text, message, number_text


def test_numbers_by_language(spark):
    given = [0.0, 7.0, 1234.5, 1234567.0, 0.125, 2.005, -1234.25, 999.999, None]
    df = spark.createDataFrame([(x,) for x in given], "x double").coalesce(1)
    got = [tuple(r) for r in df.select(number_text(F.col("x")), number_text(F.col("x"), Locale(".", ",")), number_text(F.col("x"), digits=0)).collect()]
    assert [g[0] for g in got] == ["0", "7", "1,234.5", "1,234,567", "0.13", "2.01", "-1,234.25", "1,000", None]
    assert [g[1] for g in got] == ["0", "7", "1.234,5", "1.234.567", "0,13", "2,01", "-1.234,25", "1.000", None]
    assert [g[2] for g in got] == ["0", "7", "1,235", "1,234,567", "0", "2", "-1,234", "1,000", None]


def test_lists_are_cut(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],), (["a", "b", "c", "d", "e"],)], "x array<string>").coalesce(1)
    assert [r[0] for r in df.select(list_text(F.col("x"), limit=3)).collect()] == ["", "a", "a, b, c", "a, b, c, and 2 more"]


def test_messages_keep_slots_without_a_value(spark):
    told = Messages({"en": {"k": "{a} has {n:number} of {items:list}. {b}", "z": "plain"}, "id": {"k": "{n:number} dari {items:list}"}}, limit=2)
    df = spark.createDataFrame([("k", "en", {"a": "A"}, {"n": 1500.0}, {"items": ["x", "y", "z"]}), ("k", "id", {}, {"n": 1500.5}, {"items": ["x", "y", "z"]}), ("z", "en", None, None, None), ("z", "id", {}, {}, {}), ("k", "en", None, {}, {})], "k string, l string, t map<string,string>, n map<string,double>, i map<string,array<string>>").coalesce(1)
    got = [r[0] for r in df.select(message(told, F.col("k"), F.col("l"), F.col("t"), F.col("n"), F.col("i"))).collect()]
    assert got == ["A has 1,500 of x, y, and 1 more. {b}", "1.500,5 dari x, y, dan 1 lainnya", "plain", None, "{a} has {n:number} of {items:list}. {b}"]
    with pytest.raises(ValueError, match="unknown kind"):
        message(Messages({"en": {"k": "{a:date}"}}), F.col("k"), F.col("l"), F.col("t"), F.col("n"), F.col("i"))


def test_texts_are_trimmed_in_proportion_to_their_length(spark):
    texts = ["", " ", " a ", " a b\n\t", "a", "\n\na\n\nb\n", " " * 300_000, " " * 100_000 + "x" + " " * 100_000, "x " * 100_000, None]
    df = spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1)
    assert [r[0] for r in df.select(trimmed(F.col("x"))).collect()] == [t and t.strip() for t in texts]
