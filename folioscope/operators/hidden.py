"""Text a reader cannot see: background, visibility reasons, OCR layers, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import clean_run_text, contrast_ratio, once, seen_chars, trimmed
from folioscope.params import HiddenText

RUN = ["doc_id", "page_number", "run_ord"]


def joined(text, separator: str = " ", order: str = "run_ord"):
    """The texts of a group joined in run order; groups are runs of one document."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda r: r["t"]), separator)


def cleaned_runs(runs: DataFrame) -> DataFrame:
    clean = runs.select(*(once(clean_run_text(F.col(c)), c) if c == "text" else c for c in runs.columns))
    return clean.where("text <> ''")


def background_at(runs: DataFrame, shapes: DataFrame, params: HiddenText = HiddenText()) -> DataFrame:
    """Adds ``background``: the topmost painted shape under each run's sample point; null if unknown."""
    top = top_shapes(runs, shapes, params)
    return runs.join(top, RUN, "left").withColumn("background", F.when(F.col("top").isNull(), "#ffffff").otherwise(F.col("top.color"))).drop("top")


def top_shapes(runs: DataFrame, shapes: DataFrame, params: HiddenText) -> DataFrame:
    """(doc_id, page_number, run_ord, top) of runs with a painted shape under them; ``top`` has its color, null if unknown.

    Pages are cut into a grid; a shape is dealt to the cells it covers, a run to the one of its point,
    and they meet by document, page and cell with the box as residual. Cells at the rim of the grid
    hold all that lies beyond, so a shape has at most ``params.grid`` squared cells.
    """
    cell = lambda v: F.least(F.lit(params.grid - 1), F.greatest(F.lit(0), F.floor(v / params.cell))).cast("int")
    covered = lambda low, high: F.explode(F.sequence(cell(F.col(f"box.{low}")), cell(F.col(f"box.{high}"))))
    px, py = F.col("x") + F.col("width") / 2, F.col("y") + F.col("font_size") * params.baseline
    s = shapes.where(F.col("alpha") >= params.painted).select("doc_id", "page_number", "box", F.col("kind").alias("s_kind"), F.col("color").alias("s_color"), F.col("alpha").alias("s_alpha"), F.col("paint_order").alias("s_order"))
    s = s.where("box.x0 <= box.x1 AND box.y0 <= box.y1").withColumn("cx", covered("x0", "x1")).withColumn("cy", covered("y0", "y1"))
    points = runs.select(*RUN, px.alias("px"), py.alias("py"), "paint_order", cell(px).alias("cx"), cell(py).alias("cy"))
    inside = (F.col("px") >= F.col("box.x0")) & (F.col("px") <= F.col("box.x1")) & (F.col("py") >= F.col("box.y0")) & (F.col("py") <= F.col("box.y1"))
    under = points.join(s, ["doc_id", "page_number", "cx", "cy"]).where(inside & (F.col("s_order") <= F.col("paint_order")))
    known = (F.col("s_kind") == "fill") & F.col("s_color").isNotNull() & (F.col("s_alpha") >= params.opaque)
    return under.groupBy(*RUN).agg(F.max_by(F.struct(F.when(known, F.col("s_color")).alias("color")), "s_order").alias("top"))


def classify_visibility(runs: DataFrame, shapes: DataFrame, pages: DataFrame, params: HiddenText = HiddenText()) -> DataFrame:
    """Adds ``hidden_reasons``, in a fixed order, to runs."""
    seen = background_at(runs, shapes, params).join(pages.select("doc_id", "page_number", F.col("box").alias("page_box")), ["doc_id", "page_number"], "left")
    return seen.withColumn("hidden_reasons", visibility_reasons(F.col("background"), F.col("page_box"), params)).drop("page_box", "background")


def visibility_reasons(background, b, params: HiddenText):
    off = params.off_page
    outside = (F.col("x") < b.x0 - off) | (F.col("x") > b.x1 + off) | (F.col("y") < b.y0 - off) | (F.col("y") > b.y1 + off)
    low = F.col("color").isNotNull() & background.isNotNull() & (contrast_ratio(F.col("color"), background) < params.contrast)
    return F.array_compact(
        F.array(
            F.when(F.col("render_mode").isin(3, 7), "invisible-mode"),
            F.when(F.col("alpha") < params.faint, "transparent"),
            F.when(F.col("font_size") <= params.tiny, "tiny-font"),
            F.when(outside, "off-page"),
            F.when(low, "low-contrast"),
        )
    )


def ocr_layer_pages(runs: DataFrame, shapes: DataFrame, pages: DataFrame, params: HiddenText = HiddenText()) -> DataFrame:
    """Adds ``ocr_layer`` to pages: text, all of it invisible, over an image of half the page."""
    texts = runs.where(trimmed(F.col("text")) != "").groupBy("doc_id", "page_number").agg(F.bool_and(F.array_contains("hidden_reasons", "invisible-mode")).alias("all_invisible"))
    both = shapes.where("kind = 'image'").select("doc_id", "page_number", F.col("box").alias("s")).join(pages.select("doc_id", "page_number", F.col("box").alias("p")), ["doc_id", "page_number"])
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(F.col(f"s.{high}"), F.col(f"p.{high}")) - F.greatest(F.col(f"s.{low}"), F.col(f"p.{low}")))
    area = (F.col("p.x1") - F.col("p.x0")) * (F.col("p.y1") - F.col("p.y0"))
    covered = both.groupBy("doc_id", "page_number").agg(F.bool_or(side("x0", "x1") * side("y0", "y1") >= area * params.image_share).alias("covered"))
    found = pages.join(texts, ["doc_id", "page_number"], "left").join(covered, ["doc_id", "page_number"], "left")
    return found.withColumn("ocr_layer", F.coalesce("all_invisible", F.lit(False)) & F.coalesce("covered", F.lit(False))).drop("all_invisible", "covered")


def apply_ocr_exception(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Invisible text over a scan is not hidden; adds ``hidden``."""
    found = runs.join(pages.select("doc_id", "page_number", "ocr_layer"), ["doc_id", "page_number"], "left")
    reasons = F.when(F.col("ocr_layer"), F.array_remove("hidden_reasons", "invisible-mode")).otherwise(F.col("hidden_reasons"))
    return found.withColumn("hidden_reasons", reasons).withColumn("hidden", F.size("hidden_reasons") > 0).drop("ocr_layer")


def screened_runs(runs: DataFrame, shapes: DataFrame, pages: DataFrame, params: HiddenText = HiddenText()) -> DataFrame:
    """Runs with ``hidden_reasons`` and ``hidden``: ``apply_ocr_exception`` over ``ocr_layer_pages`` over ``classify_visibility``.

    What paints under a run, its page's box and the images over the page come to the runs as rows of one
    shuffle by document, and meet them in windows of a page. So texts travel once, and windows and groups
    by document or page that follow need no shuffle.
    """
    clean = cleaned_runs(runs)
    columns = clean.columns
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(F.col(f"s.{high}"), F.col(f"box.{high}")) - F.greatest(F.col(f"s.{low}"), F.col(f"box.{low}")))
    images = shapes.where("kind = 'image'").select("doc_id", "page_number", F.col("box").alias("s")).join(pages.select("doc_id", "page_number", "box"), ["doc_id", "page_number"])
    covered = side("x0", "x1") * side("y0", "y1") >= (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0")) * params.image_share
    told = (
        clean.withColumn("__run", F.lit(True)),
        top_shapes(runs, shapes, params).withColumnRenamed("top", "__top"),
        pages.select("doc_id", "page_number", F.col("box").alias("__page")),
        images.where(covered).select("doc_id", "page_number", F.lit(True).alias("__covered")),
    )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told).repartition("doc_id")
    of_run, of_page = Window.partitionBy(*RUN), Window.partitionBy("doc_id", "page_number")
    rows = rows.withColumn("__top", F.max("__top").over(of_run))
    text_there = F.when(F.col("__run") & (trimmed(F.col("text")) != ""), F.coalesce(F.col("render_mode").isin(3, 7), F.lit(False)))
    rows = rows.withColumns({"__page": F.max("__page").over(of_page), "__scan": F.coalesce(F.max("__covered").over(of_page) & F.min(text_there).over(of_page) & F.max("__page").over(of_page).isNotNull(), F.lit(False))}).where("__run")
    background = F.when(F.col("__top").isNull(), "#ffffff").otherwise(F.col("__top.color"))
    reasons = visibility_reasons(background, F.col("__page"), params)
    rows = rows.select(*columns, F.array_remove(reasons, F.when(F.col("__scan"), "invisible-mode").otherwise("")).alias("hidden_reasons"))
    return rows.withColumn("hidden", F.size("hidden_reasons") > 0)


def summarize_hidden(runs: DataFrame, checked: bool = True, params: HiddenText = HiddenText()) -> DataFrame:
    """One row per document: counts, reasons in the order first seen, and the first hidden passages.

    Adjacent hidden runs of a page are one passage; a document's runs are bounded by admission.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("run_ord")
    starts = F.col("hidden") & ~(F.coalesce(F.lag("hidden").over(by_doc), F.lit(False)) & (F.lag("page_number").over(by_doc) == F.col("page_number")))
    hidden = runs.withColumn("__start", starts.cast("int")).withColumn("group", F.sum("__start").over(by_doc)).where("hidden")
    passage = hidden.groupBy("doc_id", "group").agg(
        F.min("page_number").alias("page"), F.count("*").alias("n_runs"), F.sum(seen_chars(F.col("text"))).alias("n_chars"), joined(trimmed(F.col("text"))).alias("text")
    )
    words = F.col("text").rlike(r"[\p{L}\p{N}]")
    ranked = passage.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(~words, "group")))
    sample = F.when((F.col("__n") <= params.samples) & words, F.struct("group", F.substring("text", 1, params.sample_chars).alias("text"), "page"))
    groups = ranked.groupBy("doc_id").agg(
        F.sum("n_runs").cast("int").alias("run_count"), F.sum("n_chars").cast("int").alias("char_count"), F.bool_or(words).alias("has_words"),
        F.transform(F.array_sort(F.collect_list(sample)), lambda s: F.struct(s["text"].alias("text"), s["page"].alias("page"))).alias("samples"),
    )
    first = hidden.select("doc_id", "run_ord", F.posexplode("hidden_reasons").alias("pos", "reason")).groupBy("doc_id", "reason").agg(F.min(F.struct("run_ord", "pos")).alias("at"))
    reasons = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda r: r["reason"]).alias("reasons"))
    docs = runs.select("doc_id").distinct()
    none = lambda name, value: F.coalesce(name, value).alias(name)
    return docs.join(groups, "doc_id", "left").join(reasons, "doc_id", "left").select(
        "doc_id", F.lit(checked).alias("checked"), none("run_count", F.lit(0)), none("char_count", F.lit(0)), none("has_words", F.lit(False)), none("reasons", F.array().cast("array<string>")), F.coalesce("samples", F.array().cast("array<struct<text:string,page:int>>")).alias("samples")
    )
