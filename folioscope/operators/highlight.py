"""Quoted passages to page boxes: interval maps of pages, search, boxes, image rectangles, mark groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import collapse_ws
from folioscope.operators.merge import needle
from folioscope.params import WS

PAGE = ["doc_id", "page_number", "hidden"]


def page_text_map(runs: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id, page_number, hidden, text, source, runs): an interval map of every page, a row a page.

    ``source`` joins the page's runs, with one space of no run where white space stands between two;
    ``text`` is its collapsed form. ``runs`` has where each run begins in ``source`` (from 0), its
    number and its length, in order. ``runs`` of the input carries text_start and text_end, ``raw``
    doc_id and raw_text. Where runs carry their lead and text too, these are taken, and a running count
    tells whether white space stands between two: cutting a long raw text for every run costs the square.
    """
    by_page = Window.partitionBy(*PAGE).orderBy("text_start", "run_ord")
    if {"lead", "text"} <= set(runs.columns):
        blank = lambda c: F.col(c).rlike(WS).cast("int")
        by_doc = Window.partitionBy("doc_id").orderBy("text_start", "run_ord").rowsBetween(Window.unboundedPreceding, 0)
        held = runs.select(*PAGE, "run_ord", "text_start", F.col("text").alias("own"), blank("text").alias("inside"), F.sum(blank("lead") + blank("text")).over(by_doc).alias("blanks"))
        between = F.col("blanks") - F.col("inside") > F.lag("blanks").over(by_page)  # null for the first of a page
        parts = held.select(*PAGE, "text_start", "run_ord", F.when(between, " ").otherwise("").alias("lead"), "own")
    else:
        parts = cut_pieces(runs, raw)
    ends = F.sum(F.length("lead") + F.length("own")).over(by_page.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("at", (ends - F.length("own")).cast("int"))
    pages = parts.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("text_start", "run_ord", "at", F.length("own").alias("n"), F.concat("lead", "own").alias("piece")))).alias("items"))
    source = F.array_join(F.transform("items", lambda i: i["piece"]), "")
    return pages.select(*PAGE, source.alias("source"), F.transform("items", lambda i: F.struct(i["at"].alias("at"), i["run_ord"].alias("run_ord"), i["n"].alias("n"))).alias("runs")).withColumn("text", collapse_ws(F.col("source")))


def cut_pieces(runs: DataFrame, raw: DataFrame) -> DataFrame:
    """Runs with their own text and what stands before it, cut from the raw text by their offsets."""
    by_page = Window.partitionBy(*PAGE).orderBy("text_start", "run_ord")
    held = runs.select(*PAGE, "run_ord", "text_start", "text_end", F.lag("text_end").over(by_page).alias("before")).join(raw, "doc_id")
    between = F.when(F.col("before").isNotNull(), F.substring("raw_text", F.col("before") + 1, F.col("text_start") - F.col("before"))).otherwise("")
    own = F.substring("raw_text", F.col("text_start") + 1, F.col("text_end") - F.col("text_start"))
    return held.select(*PAGE, "text_start", "run_ord", F.when(between.rlike(WS), " ").otherwise("").alias("lead"), own.alias("own"))


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE, "text")


def locate_highlight(suggestions: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, id, page_number, hidden, exact, at, size, needle): the best place of each snippet.

    An exact match on any page beats one that ignores spaces; the stored page beats the others, which
    follow in order. ``hidden-text`` looks at hidden runs only. ``at`` counts from 1; without exact
    match it counts characters that are not spaces.
    """
    s = suggestions.select("doc_id", "id", F.col("page_number").alias("stored"), needle(F.coalesce("snippet", F.lit(""))).alias("needle")).where("needle <> ''")
    on = s.join(texts, "doc_id").where((F.col("id") == "hidden-text") == F.col("hidden"))
    compact = F.replace("needle", F.lit(" "), F.lit(""))
    exact, loose = F.position("needle", "text"), F.position(compact, F.replace("text", F.lit(" "), F.lit("")))
    found = on.withColumn("e", exact).withColumn("l", loose).where("e > 0 or l > 0")
    best = F.struct((F.col("e") == 0).alias("rank"), (~F.col("page_number").eqNullSafe(F.col("stored"))).alias("other"), "page_number")
    place = F.struct("page_number", "hidden", (F.col("e") > 0).alias("exact"), F.when(F.col("e") > 0, F.col("e")).otherwise(F.col("l")).alias("at"), F.when(F.col("e") > 0, F.length("needle")).otherwise(F.length(compact)).alias("size"), "needle")
    return found.groupBy("doc_id", "id").agg(F.min_by(place, best).alias("p")).select("doc_id", "id", "p.*")


def as_pattern(needle: Column, exact: Column) -> Column:
    """Finds the needle in text that is not collapsed: any white space where it has a space, or between any two characters."""
    quoted = lambda c: F.regexp_replace(c, r"(\p{Punct})", r"\\$1")
    words = F.array_join(F.transform(F.split(needle, " "), quoted), f"{WS}+")
    chars = F.array_join(F.transform(F.filter(F.split(needle, ""), lambda c: ~c.isin("", " ")), quoted), f"{WS}*")
    return F.when(exact, words).otherwise(chars)


def highlight_boxes(places: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, id, page_number, line, x0, y0, x1, y1): a box per line of each match.

    ``pages`` is the interval map. The match is found again in a page's source; only the runs that it
    overlaps become rows. Of white space only the first character counts, and none in a match that
    ignores spaces.
    """
    pattern = as_pattern(F.col("needle"), F.col("exact"))
    hit = places.join(pages.select(*PAGE, "source", F.col("runs").alias("held")), PAGE).withColumn("pattern", pattern)
    hit = hit.withColumn("begin", F.regexp_instr("source", F.col("pattern")) - 1).withColumn("end", F.col("begin") + F.length(F.regexp_substr("source", F.col("pattern"))))
    over = F.filter("held", lambda r: (r["at"] < F.col("end")) & (r["at"] + r["n"] > F.col("begin")))
    part = hit.select("doc_id", "id", "page_number", "exact", "source", "begin", "end", F.explode(over).alias("r")).select("*", F.greatest("begin", "r.at").alias("low"), F.least("end", F.col("r.at") + F.col("r.n")).alias("high"))
    piece = F.substring("source", F.col("low") + 1, F.col("high") - F.col("low"))
    part = part.select("doc_id", "id", "page_number", "exact", F.col("r.run_ord").alias("run_ord"), F.col("r.at").alias("at"), "low", "high", piece.alias("piece"), ((F.col("low") > 0) & F.substring("source", F.col("low"), F.lit(1)).rlike(WS)).alias("after_space"))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", f"^{WS}+", ""))
    tail = F.length("piece") - F.length(F.regexp_replace("piece", f"{WS}+$", ""))
    part = part.withColumns({"lead": lead, "tail": tail})
    blank, spaced = F.col("lead") == F.length("piece"), F.col("exact")
    first = F.col("low") - F.col("at") + F.when(spaced & ~F.col("after_space"), 0).otherwise(F.col("lead"))
    last = F.when(blank, first + 1).otherwise(F.col("high") - F.col("at") - F.col("tail") + F.when(spaced & (F.col("tail") > 0), 1).otherwise(0))
    spans = part.where(~blank | (spaced & ~F.col("after_space"))).select("doc_id", "id", "page_number", "run_ord", first.alias("a"), last.alias("b"))
    r = spans.join(runs.select("doc_id", "run_ord", "x", "y", "width", "font_size", F.greatest(F.lit(1), F.col("text_end") - F.col("text_start")).alias("n")), ["doc_id", "run_ord"])
    pad = F.col("font_size") * 0.1
    box = r.select("doc_id", "id", "page_number", "run_ord", "y", "font_size", (F.col("x") + F.col("width") * F.col("a") / F.col("n") - pad).alias("x0"), (F.col("y") - F.col("font_size") * 0.2).alias("y0"), (F.col("x") + F.col("width") * F.col("b") / F.col("n") + pad).alias("x1"), (F.col("y") + F.col("font_size") * 0.8).alias("y1"))
    runs_of = box.groupBy("doc_id", "id", "page_number").agg(F.array_sort(F.collect_list(F.struct("run_ord", "y", "font_size", "x0", "y0", "x1", "y1"))).alias("items"))

    def step(state, i):  # a run joins while its baseline is near that of the line's first run
        same = state["y"].isNotNull() & (F.abs(state["y"] - i["y"]) < F.least(state["size"], i["font_size"]) * 0.5)
        line = F.when(same, state["line"]).otherwise(state["line"] + 1)
        return F.struct(F.when(same, state["y"]).otherwise(i["y"]).alias("y"), F.when(same, state["size"]).otherwise(i["font_size"]).alias("size"), line.alias("line"), F.concat(state["out"], F.array(line)).alias("out"))

    none = F.struct(F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("size"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("out"))
    lines = runs_of.select("doc_id", "id", "page_number", F.explode(F.arrays_zip("items", F.aggregate("items", none, step, lambda s: s["out"]).alias("lines"))).alias("z"))
    return lines.groupBy("doc_id", "id", "page_number", F.col("z.lines").alias("line")).agg(F.min("z.items.x0").alias("x0"), F.min("z.items.y0").alias("y0"), F.max("z.items.x1").alias("x1"), F.max("z.items.y1").alias("y1"))


def page_maps_to_image(pages: DataFrame) -> DataFrame:
    """Adds ``drawable``: an upright page whose image has the page's shape."""
    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    sizes = (F.col("img_width") > 0) & (F.col("img_height") > 0) & (w > 0) & (h > 0)
    drift = F.when(sizes, F.abs((w / h) / (F.col("img_width") / F.col("img_height")) - 1))
    return pages.withColumn("drawable", F.coalesce((F.col("rotation") == 0) & (drift <= 0.02), F.lit(False)))


def to_image_rect(page_box):
    """struct(left, top, width, height) in percent of the image, from columns x0..y1."""
    w, h = page_box["x1"] - page_box["x0"], page_box["y1"] - page_box["y0"]
    clamp = lambda v: F.least(F.lit(100.0), F.greatest(F.lit(0.0), v))
    left, right = clamp((F.col("x0") - page_box["x0"]) / w * 100), clamp((F.col("x1") - page_box["x0"]) / w * 100)
    top, bottom = clamp((page_box["y1"] - F.col("y1")) / h * 100), clamp((page_box["y1"] - F.col("y0")) / h * 100)
    return F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"))


def place_highlights(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes on drawable pages as rectangles; those without area are dropped."""
    drawn = page_maps_to_image(pages).where("drawable").select("doc_id", "page_number", F.col("box").alias("page_box"))
    rects = boxes.join(drawn, ["doc_id", "page_number"]).select("doc_id", "id", "page_number", "line", to_image_rect(F.col("page_box")).alias("rect"))
    return rects.where("rect.width > 0 and rect.height > 0")


RANK = {"high": 0, "medium": 1, "low": 2}


def priority_rank(c):
    return F.coalesce(*(F.when(c == k, v) for k, v in RANK.items()), F.lit(3))


def group_marks(rects: DataFrame, priorities: DataFrame, edge: float = 0.05) -> DataFrame:
    """(doc_id, id, page_number, lead): marks of a page with nearly the same rectangles share a lead.

    The first mark of a group is its measure, as nearness is not transitive: a fold over the page's marks.
    """
    marks = rects.groupBy("doc_id", "page_number", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "rect"))), lambda r: r["rect"]).alias("rects")).join(priorities, ["doc_id", "id"])
    pages = marks.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("sug_ord", "id", "priority", "rects"))).alias("items"))

    def near(a, b):
        sides = ("left", "top", "width", "height")
        pairs = F.zip_with(a, b, lambda p, q: F.coalesce(*[F.when(F.abs(p[s] - q[s]) >= edge, F.lit(False)) for s in sides], F.lit(True)) & p.isNotNull() & q.isNotNull())
        return (F.size(a) == F.size(b)) & F.forall(pairs, lambda x: x)

    def step(state, i):
        at = F.array_position(F.transform(state["firsts"], lambda f: near(f, i["rects"])), True).cast("int")
        group = F.when(at > 0, at).otherwise(F.size(state["firsts"]) + 1)
        return F.struct(F.when(at > 0, state["firsts"]).otherwise(F.concat(state["firsts"], F.array(i["rects"]))).alias("firsts"), F.concat(state["out"], F.array(group)).alias("out"))

    rect = "array<array<struct<left:double,top:double,width:double,height:double>>>"
    start = F.struct(F.array().cast(rect).alias("firsts"), F.array().cast("array<int>").alias("out"))
    rows = pages.select("doc_id", "page_number", F.explode(F.arrays_zip("items", F.aggregate("items", start, step, lambda s: s["out"]).alias("groups"))).alias("z"))
    rows = rows.select("doc_id", "page_number", F.col("z.items.id").alias("id"), F.col("z.items.priority").alias("priority"), F.col("z.items.sug_ord").alias("sug_ord"), F.col("z.groups").alias("grp"))
    lead = F.first("id").over(Window.partitionBy("doc_id", "page_number", "grp").orderBy(priority_rank(F.col("priority")), "sug_ord"))
    return rows.withColumn("lead", lead).select("doc_id", "id", "page_number", "lead")
