"""Merging the rules' report with a model's: checks, snippets, suggestions, weaknesses, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import collapse_ws, status_band, trimmed
from folioscope.operators.scoring import weighted_score

QUOTES = "\"'\\x{201C}\\x{201D}\\x{2018}\\x{2019}\\x{AB}\\x{BB}"


def needle(snippet):
    return collapse_ws(F.regexp_replace(trimmed(snippet), f"^[{QUOTES}]+|[{QUOTES}]+$", ""))


def merge_checks(rules: DataFrame, model: DataFrame) -> DataFrame:
    """The model's score and detail, except for formatting and where the detail is empty; no detail where the rules come without.

    The model's side has rows for each document, so it is merged and never broadcast.
    """
    key = ["doc_id", "posting_id", "check_id"]
    given = model.where("detail <> '' and check_id <> 'formatting'").select(*key, F.col("score").alias("m_score"), F.col("detail").alias("m_detail"))
    both = rules.join(given.hint("merge"), key, "left")
    known = F.col("m_score").isNotNull()
    score = F.coalesce("m_score", "score")
    detail = [F.coalesce("m_detail", "detail").alias("detail")] if "detail" in rules.columns else []
    return both.select(*key, "check_ord", score.alias("score"), F.when(known, status_band(score)).otherwise(F.col("status")).alias("status"), *detail)


def locate_snippet(suggestions: DataFrame, visible: DataFrame, spans: DataFrame) -> DataFrame:
    """Snippets that the visible text has, without white-space differences, and their first page; else null.

    ``visible``: doc_id, visible_text; ``spans``: doc_id, page_number, text (collapsed).
    """
    rows = suggestions.withColumn("needle", needle(F.coalesce("snippet", F.lit("")))).drop("snippet", "page_number")
    # a document's pages, bounded by admission, come to its snippets in one row, so nothing is looked up again
    pages = spans.groupBy("doc_id").agg(F.collect_list(F.struct("page_number", "text")).alias("pages"))
    body = visible.select("doc_id", collapse_ws(F.col("visible_text")).alias("visible_text")).join(pages, "doc_id", "left")
    seen = rows.join(body, "doc_id", "left")
    seen = seen.withColumn("found", (F.col("needle") != "") & F.coalesce(F.contains("visible_text", F.col("needle")), F.lit(False)))
    first = F.array_min(F.transform(F.filter("pages", lambda p: F.contains(p["text"], F.col("needle"))), lambda p: p["page_number"]))
    out = seen.withColumn("page_number", F.when(F.col("found"), first)).withColumn("snippet", F.when(F.col("found"), F.col("needle")))
    return out.drop("needle", "found", "visible_text", "pages")


def without_model(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """The pairs of documents that the model has no rows for: only they need the rules' lists. Both have doc_id."""
    return pairs.join(model.select("doc_id").distinct(), "doc_id", "left_anti")


def merge_suggestions(hidden: DataFrame, model: DataFrame, rules: DataFrame, typography: DataFrame) -> DataFrame:
    """Hidden-text rows, then the model's (renumbered) or else the rules' suggestions, then typography.

    Each input has doc_id, sug_ord, id, priority; the order becomes ``rank`` within a document.
    """
    cols = ["doc_id", "part", "sug_ord", "id", "priority"]
    order = Window.partitionBy("doc_id").orderBy("sug_ord")
    numbered = model.withColumn("sug_ord", F.row_number().over(order)).withColumn("id", F.concat(F.lit("sug-"), F.lpad(F.col("sug_ord").cast("string"), 2, "0")))
    fallback = without_model(rules, model)
    parts = ((hidden, 0), (numbered, 1), (fallback, 1), (typography, 2))
    out = None
    for df, part in parts:
        rows = df.withColumn("part", F.lit(part)).select(*cols)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "sug_ord"))).drop("part", "sug_ord")


def merge_weaknesses(model: DataFrame, rules: DataFrame) -> DataFrame:
    """The model's list where it has one, else the rules'. Both: doc_id, weak_ord, weakness."""
    rest = without_model(rules, model)
    return model.select("doc_id", "weak_ord", "weakness").unionByName(rest.select("doc_id", "weak_ord", "weakness"))


def merge_score(checks: DataFrame, jobs: DataFrame, modes: DataFrame) -> DataFrame:
    """Overall score and number of jobs per pair; jobs count in mode-b only. ``modes``: doc_id, mode.

    Modes and jobs have rows for each document, so they are merged and never broadcast.
    """
    n = jobs.groupBy("doc_id").agg(F.count("*").alias("n_jobs"))
    out = weighted_score(checks).join(modes.hint("merge"), "doc_id").join(n.hint("merge"), "doc_id", "left")
    return out.select("doc_id", "posting_id", "overall_score", F.when(F.col("mode") == "mode-b", F.coalesce("n_jobs", F.lit(0))).otherwise(0).alias("n_jobs"))
