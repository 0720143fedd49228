"""Text assembly: separators, the raw, marked and visible renditions, and page spans.

Every rendition is windows over one document's runs, which admission bounds, and one ordered join.
Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import collapse_ws, neutralize_markers, trimmed
from folioscope.operators.hidden import joined
from folioscope.params import WS, Layout


def by_doc():
    return Window.partitionBy("doc_id").orderBy("run_ord")


def so_far():
    return by_doc().rowsBetween(Window.unboundedPreceding, 0)


def before():
    return by_doc().rowsBetween(Window.unboundedPreceding, -1)


def run_separator(runs: DataFrame, params: Layout = Layout()) -> DataFrame:
    """Adds ``sep``: what stands between a run and the one before it."""
    lag = lambda c: F.lag(c).over(by_doc())
    em = F.greatest(lag("font_size"), F.col("font_size"), F.lit(1.0))
    gap = F.col("x") - (lag("x") + lag("width"))
    newline = (lag("page_number") != F.col("page_number")) | (F.abs(F.col("y") - lag("y")) > em * params.line_shift)
    sep = F.when(lag("run_ord").isNull(), "").when(newline, "\n").when((gap > em * params.space_gap) | (gap < -em * params.line_shift), " ").otherwise("")
    return runs.withColumn("sep", sep)


def joint(left_ends, sep, right):
    """The separator, but no space beside white space that is already there."""
    return F.when((sep == " ") & (left_ends | right.rlike(f"^{WS}")), "").otherwise(sep)


def ends_blank(x):
    return F.coalesce(x.rlike(f"{WS}$"), F.lit(False))


def assemble_raw(runs: DataFrame) -> DataFrame:
    """Runs with ``piece`` (separator and text) and their [text_start, text_end) in the raw text."""
    left = F.last(F.when(F.col("text") != "", F.col("text")), ignorenulls=True).over(before())
    pieces = runs.withColumn("lead", joint(ends_blank(left), F.col("sep"), F.col("text")))
    size = F.length("lead") + F.length("text")
    end = F.sum(size).over(so_far())
    return pieces.withColumn("text_end", end.cast("int")).withColumn("text_start", (F.col("text_end") - F.length("text")).cast("int"))


def raw_text(placed: DataFrame) -> DataFrame:
    return placed.groupBy("doc_id").agg(joined(F.concat("lead", "text"), "").alias("raw_text"))


def assemble_sanitized(runs: DataFrame) -> DataFrame:
    """(doc_id, sanitized_text): hidden text in [IGNORED] blocks, brackets of the text itself turned round."""
    has_text = trimmed(F.col("text")) != ""
    # a run without text keeps the state of the runs before it
    state = F.coalesce(F.last(F.when(has_text, F.col("hidden")), ignorenulls=True).over(so_far()), F.lit(False))
    held = runs.withColumn("safe", neutralize_markers(F.col("text"))).withColumn("inside", state)
    was = F.coalesce(F.lag("inside").over(by_doc()), F.lit(False))
    opens, closes = F.col("inside") & ~was, ~F.col("inside") & was
    # what the text before ends with: a mark, or the last run with characters
    left = F.last(F.when(F.col("safe") != "", F.col("safe")), ignorenulls=True).over(before())
    blank_left = F.when(closes, F.lit(False)).otherwise(ends_blank(left))
    shown = F.when(opens, F.concat(F.lit("[IGNORED]"), F.col("safe"))).otherwise(F.col("safe"))
    piece = F.concat(F.when(closes, "[/IGNORED]").otherwise(""), joint(blank_left, F.col("sep"), shown), shown)
    last = F.max_by(F.col("inside"), F.col("run_ord"))
    marked = held.withColumn("piece", piece)
    return marked.groupBy("doc_id").agg(joined(F.col("piece"), "").alias("t"), last.alias("open")).select("doc_id", F.concat("t", F.when(F.col("open"), "[/IGNORED]").otherwise("")).alias("sanitized_text"))


def assemble_visible(runs: DataFrame) -> DataFrame:
    """(doc_id, visible_text): hidden runs left out, with the strongest separator since the last visible one."""
    strength = F.when(F.col("sep") == "\n", 2).when(F.col("sep") == " ", 1).otherwise(0)
    shown = F.sum((~F.col("hidden")).cast("int"))
    grouped = runs.withColumn("strength", strength).withColumn("since", F.coalesce(shown.over(before()), F.lit(0)))
    in_group = Window.partitionBy("doc_id", "since").orderBy("run_ord").rowsBetween(Window.unboundedPreceding, 0)
    seen = grouped.withColumn("pending", F.max("strength").over(in_group))
    left = F.last(F.when(~F.col("hidden") & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(before())
    sep = F.when(F.col("pending") == 2, "\n").when(F.col("pending") == 1, " ").otherwise("")
    pieces = seen.withColumn("left", left).withColumn("piece", F.concat(F.when(F.col("left").isNull(), "").otherwise(joint(ends_blank(F.col("left")), sep, F.col("text"))), F.col("text")))
    return pieces.groupBy("doc_id").agg(joined(F.when(~F.col("hidden"), F.col("piece")), "").alias("visible_text"))  # null pieces are not joined


def page_spans(placed: DataFrame, raw: DataFrame) -> DataFrame:
    """Each page's span of the raw text and its collapsed text."""
    spans = placed.groupBy("doc_id", "page_number").agg(F.min("text_start").alias("start"), F.max("text_end").alias("end"))
    return spans.join(raw, "doc_id").select("doc_id", "page_number", "start", "end", collapse_ws(F.substring("raw_text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("text"))
