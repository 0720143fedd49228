"""Typography and layout of visible runs: fonts, lines, spacing, margins, columns, graphics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import rounded, seen_chars, trimmed
from folioscope.params import Layout

PAGE = ["doc_id", "page_number"]


def visible_runs(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("hidden") & (trimmed(F.col("text")) != ""))


def chars_of(runs: DataFrame):
    """A run's characters that are not white space, counted before where ``n_chars`` is there."""
    return F.col("n_chars") if "n_chars" in runs.columns else seen_chars(F.col("text"))


def font_usage(runs: DataFrame) -> DataFrame:
    """Characters by (family, bold, italic, size), with ``font_ord`` from most used down."""
    size = rounded(F.col("font_size"), 2)
    used = runs.groupBy("doc_id", F.col("font_family").alias("family"), "bold", "italic", size.alias("size")).agg(F.sum(chars_of(runs)).alias("char_count"), F.min("run_ord").alias("first_run"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("char_count"), "first_run", "family", "size")
    return used.withColumn("font_ord", F.row_number().over(order)).drop("first_run")


def body_title_size(fonts: DataFrame) -> DataFrame:
    plain = ~F.col("bold") & ~F.col("italic") & (F.col("family") != "Unknown")
    return fonts.groupBy("doc_id").agg(
        F.coalesce(F.min_by("size", F.when(plain, F.col("font_ord"))), F.max("size")).alias("body_size"), F.max("size").alias("title_size")
    )


def styled_share(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    near = runs.join(sizes, "doc_id").where(F.abs(F.col("font_size") - F.col("body_size")) <= 0.5).withColumn("chars", chars_of(runs))
    sums = near.groupBy("doc_id").agg(F.sum("chars").alias("n"), F.sum(F.when(F.col("bold"), F.col("chars")).otherwise(0)).alias("b"), F.sum(F.when(F.col("italic"), F.col("chars")).otherwise(0)).alias("i"))
    share = lambda c: F.when(F.col("n") > 0, rounded(F.col(c) / F.col("n"), 3))
    return sums.select("doc_id", share("b").alias("bold_ratio"), share("i").alias("italic_ratio"))


def anchor_fold(items, value, tolerance: float, strict: bool = False):
    """Numbers sorted items by groups: an item joins while it is within ``tolerance`` of the group's first.

    ``items`` is a sorted array of structs; the result pairs each with its group number, from 0.
    A fold, as neighbours may drift further than the tolerance.
    """

    def step(state, item):
        away = F.abs(value(item) - state["anchor"])
        same = state["anchor"].isNotNull() & ((away < tolerance) if strict else (away <= tolerance))
        group = F.when(same, state["group"]).otherwise(state["group"] + 1)
        return F.struct(F.when(same, state["anchor"]).otherwise(value(item)).alias("anchor"), group.alias("group"), F.concat(state["out"], F.array(group)).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("group"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(items, start, step, lambda s: s["out"])


def group_lines(runs: DataFrame, params: Layout = Layout()) -> DataFrame:
    """Adds ``line_no`` per page, from the top: a run joins while within 1 pt of the line's first run.

    Pages are bounded by admission; one page is one array of its runs by (y, run_ord), so
    nothing is joined back; select the columns that are needed first.
    """
    rest = [c for c in runs.columns if c not in PAGE]
    ordered = runs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), F.col("run_ord").alias("ord"), F.struct(*rest).alias("run")))).alias("items"))
    numbered = ordered.select(*PAGE, F.explode(F.arrays_zip("items", anchor_fold(F.col("items"), lambda i: i["down"], params.line_join).alias("lines"))).alias("z"))
    return numbered.select(*PAGE, "z.items.run.*", F.col("z.lines").alias("line_no"))


def line_table(lines: DataFrame) -> DataFrame:
    """One row per line: its baseline (that of its first run) and largest font."""
    return lines.groupBy(*PAGE, "line_no").agg(F.min_by("y", F.struct(-F.col("y"), "run_ord")).alias("y"), F.max("font_size").alias("font_size"))


def line_spacing(lines: DataFrame) -> DataFrame:
    """Lower-quartile ratio of baseline gaps to font size over all pages of a document."""
    by_page = Window.partitionBy(*PAGE).orderBy("line_no")
    gaps = line_table(lines).select(*PAGE, ((F.lag("y").over(by_page) - F.col("y")) / F.greatest(F.lag("font_size").over(by_page), F.col("font_size"))).alias("ratio"))
    kept = gaps.where("ratio >= 0.5 and ratio <= 3").groupBy("doc_id").agg(F.array_sort(F.collect_list("ratio")).alias("r"))
    at = F.floor(0.25 * (F.size("r") - 1)).cast("int") + 1
    return kept.select("doc_id", rounded(F.element_at("r", at), 2).alias("line_spacing"))


def margins(runs: DataFrame, pages: DataFrame) -> DataFrame:
    edges = runs.groupBy(*PAGE).agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("width")).alias("right"), F.max("y").alias("top"), F.min("y").alias("bottom"))
    on = edges.join(pages.select(*PAGE, "box"), PAGE)
    b = F.col("box")
    sides = {"left": F.col("left") - b.x0, "right": b.x1 - F.col("right"), "top": b.y1 - F.col("top"), "bottom": F.col("bottom") - b.y0}
    return on.groupBy("doc_id").agg(*(rounded(F.min(v), 1).alias(f"margin_{k}") for k, v in sides.items()))


# fixed values: results must agree on what marks an annotation
ANNOTATION = r"(?i)(?<![A-Za-z0-9_])(?:(?:19|20)[0-9]{2}|sekarang|saat ini|present|now|current)(?![A-Za-z0-9_])"


def annotation_clusters(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters of flush-right dates and places: aligned ends with ragged starts, or mostly dates."""
    ends = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("x") + F.col("width"))).alias("ends"), (F.max("x") - F.min("x")).alias("spread"), F.count("*").alias("n"), F.count_if((F.length(trimmed(F.col("text"))) <= 30) & F.col("text").rlike(ANNOTATION)).alias("dates"))
    median = F.element_at("ends", F.floor(F.size("ends") / 2).cast("int") + 1)
    aligned = F.size(F.filter("ends", lambda e: F.abs(e - median) <= 2))
    return ends.select(*keys, (((F.col("spread") > 4) & (aligned >= F.col("n") * 0.5)) | (F.col("dates") >= F.col("n") * 0.5)).alias("annotation"))


def detect_columns(lines: DataFrame, params: Layout = Layout()) -> DataFrame:
    """(doc_id, column_count): columns beside the primary one, the most of any page."""
    by_x = Window.partitionBy(*PAGE).orderBy("x", "line_no", "run_ord")
    gap = F.col("x") - F.lag("x").over(by_x) > params.column_gap
    samples = lines.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("cluster", F.sum("gap").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    at = line_table(lines).select(*PAGE, "line_no", F.col("y").alias("line_y"))
    held = samples.select(*PAGE, "cluster", "line_no").distinct().join(at, [*PAGE, "line_no"])
    keys = [*PAGE, "cluster"]
    clusters = held.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.max("line_y").alias("top"), F.min("line_y").alias("bottom")).where(F.col("n_lines") >= params.column_lines)
    primary = clusters.groupBy(*PAGE).agg(F.max_by(F.struct("cluster", "top", "bottom"), F.struct("n_lines", -F.col("cluster"))).alias("p"))
    others = clusters.join(primary, PAGE).where((F.col("cluster") != F.col("p.cluster")) & (F.col("p.top") > F.col("p.bottom")))
    mine = held.join(primary, PAGE).where(F.col("cluster") == F.col("p.cluster")).select(*PAGE, F.col("line_no").alias("p_line"), F.col("line_y").alias("p_y"))
    theirs = held.join(others.select(*keys), keys).select(*keys, F.col("line_no").alias("o_line"))
    shared = theirs.join(mine, PAGE).where("o_line = p_line").groupBy(*keys).agg(F.count("*").alias("shared"))
    inside = others.join(mine, PAGE).groupBy(*keys).agg(F.count_if((F.col("p_y") <= F.col("top")) & (F.col("p_y") >= F.col("bottom"))).alias("in_span"))
    notes = annotation_clusters(samples.join(others.select(*keys), keys), keys)
    found = others.join(shared, keys).join(inside, keys).join(notes, keys).where(
        (F.col("shared") >= params.column_shared)
        & ((F.col("top") - F.col("bottom")) / (F.col("p.top") - F.col("p.bottom")) >= params.column_span)
        & (F.col("n_lines") / F.greatest("in_span", F.lit(1)) >= params.column_density)
        & ~F.col("annotation")
    )
    by_page = found.groupBy(*PAGE).agg(F.count("*").alias("n"))
    most = by_page.groupBy("doc_id").agg(F.max("n").alias("n"))
    return lines.select("doc_id").distinct().join(most, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("column_count"))


def classify_graphics(shapes: DataFrame, pages: DataFrame, params: Layout = Layout()) -> DataFrame:
    """(doc_id, graphics): images and shadings large enough to matter, and stacks of aligned bars."""
    on = shapes.join(pages.select(*PAGE, F.col("box").alias("page")), PAGE)
    width, height = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    pw, ph = F.col("page.x1") - F.col("page.x0"), F.col("page.y1") - F.col("page.y0")
    large = on.where((F.col("kind") != "fill") & (F.least(width, height) >= params.graphic_side)).select("doc_id", F.col("kind").alias("graphic"))
    bar = (F.least(width, height) > params.bar_thickness) & (width <= pw * params.bar_page_share) & (height <= ph * params.bar_page_share) & ((width >= height * params.bar_aspect) | (height >= width * params.bar_aspect))
    flat = width > height
    start = F.when(flat, F.col("box.x0")).otherwise(F.col("box.y0"))
    center = F.when(flat, (F.col("box.y0") + F.col("box.y1")) / 2).otherwise((F.col("box.x0") + F.col("box.x1")) / 2)
    bars = on.where(bar & (width != height)).select(*PAGE, flat.alias("flat"), start.alias("start"), center.alias("center"))
    rows = bars.groupBy(*PAGE, "flat").agg(F.array_sort(F.collect_list(F.struct("start", "center"))).alias("items"))
    grouped = rows.select(*PAGE, "flat", F.explode(F.arrays_zip("items", anchor_fold(F.col("items"), lambda i: i["start"], params.bar_align).alias("groups"))).alias("z"))
    grouped = grouped.select(*PAGE, "flat", F.col("z.items.center").alias("center"), F.col("z.groups").alias("grp"))
    gap = F.col("center") - F.lag("center").over(Window.partitionBy(*PAGE, "flat", "grp").orderBy("center"))
    stacks = grouped.withColumn("step", gap).where((F.col("step") > params.bar_slot) & (F.col("step") <= params.bar_gap)).select("doc_id", F.lit("bar").alias("graphic"))
    return large.unionByName(stacks).groupBy("doc_id").agg(F.array_sort(F.collect_set("graphic")).alias("graphics"))


def typography_row(runs: DataFrame, pages: DataFrame, params: Layout = Layout()) -> DataFrame:
    """Everything about the type of a document's visible text, one row each."""
    seen = visible_runs(runs).select(*PAGE, "run_ord", "x", "y", "width", "font_size", "font_family", "bold", "italic", seen_chars(F.col("text")).alias("n_chars"))
    lines = seen = group_lines(seen, params).persist()  # a few numbers a run, read by every part below
    fonts = font_usage(seen)
    sizes = body_title_size(fonts)
    listed = fonts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("font_ord", "family", "bold", "italic", "size", "char_count"))), lambda f: f.dropFields("font_ord")).alias("fonts"))
    out = listed
    for part in (sizes, line_spacing(lines), margins(seen, pages), styled_share(seen, sizes)):
        out = out.join(part, "doc_id", "left")
    return out


def layout_row(runs: DataFrame, shapes: DataFrame, pages: DataFrame, params: Layout = Layout()) -> DataFrame:
    """column_count, graphics and OCR pages of every document."""
    columns = detect_columns(group_lines(visible_runs(runs), params), params)
    none = F.array().cast("array<string>")
    ocr = pages.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("ocr_layer"), F.col("page_number")))).alias("ocr_pages"))
    found = ocr.join(columns, "doc_id", "left").join(classify_graphics(shapes, pages, params), "doc_id", "left")
    return found.select("doc_id", F.coalesce("column_count", F.lit(1)).alias("column_count"), (F.size(F.coalesce("graphics", none)) > 0).alias("has_graphics"), F.coalesce("graphics", none).alias("graphics"), "ocr_pages")
