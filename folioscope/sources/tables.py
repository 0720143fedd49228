"""Reads layout tables, and derives the operators' inputs from the driver tables by plain projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS_IN = (
    "doc_id bigint, page_number int, run_ord int, text string, x double, y double, width double, font_size double, "
    "font_family string, bold boolean, italic boolean, color string, alpha double, render_mode int, paint_order int"
)
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SHAPES = f"doc_id bigint, page_number int, box {BOX}, kind string, color string, alpha double, paint_order int"
PAGES = f"doc_id bigint, page_number int, box {BOX}, rotation int, img_width int, img_height int"


def read_layout(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The runs, shapes and pages tables that an extractor wrote under ``path`` as Parquet."""
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in (("runs", RUNS_IN), ("shapes", SHAPES), ("pages", PAGES))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of few input files over all cores, where much is computed for each; larger inputs are left as they are."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("posting_id"), "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the posting of its number modulo the count of postings."""
    n = postings(spark, sf_dir).agg(F.count("*").alias("n"))
    return texts(spark, sf_dir).select("doc_id").join(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("posting_id"))


def runs_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per non-empty line of documents, with a fixed arithmetic placement and style."""
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).where("text <> ''")
    d, n = F.col("doc_id"), F.col("n")
    k = n % 40
    two = d % 5 == 0
    odd = (d + n).cast("long")
    return lines.select(
        "doc_id",
        (F.floor(n / 40) + 1).cast("int").alias("page_number"),
        n.cast("int").alias("run_ord"),
        "text",
        F.when(two & (n % 2 == 1), 332.0).otherwise(72.0).alias("x"),
        (720 - 14 * F.when(two, F.floor(k / 2)).otherwise(k)).cast("double").alias("y"),
        F.least(5 * F.length("text"), F.lit(200)).cast("double").alias("width"),
        F.when(n == 0, 16.0).when(odd % 29 == 0, 1.5).otherwise(11.0).alias("font_size"),
        F.when(d % 7 == 0, "Times").otherwise("Helvetica").alias("font_family"),
        (n == 0).alias("bold"),
        F.lit(False).alias("italic"),
        F.when(odd % 13 == 0, "#ffffff").when(odd % 17 == 0, "#e6e6e6").otherwise("#000000").alias("color"),
        F.when(odd % 31 == 0, 0.05).otherwise(1.0).alias("alpha"),
        F.when(odd % 37 == 0, 3).otherwise(0).alias("render_mode"),
        (10 + 2 * n).cast("int").alias("paint_order"),
    )


def box(x0: float, y0: float, x1: float, y1: float):
    return F.struct(*(F.lit(float(v)).alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id")
    fills = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("page_number"), box(60, 600, 400, 740).alias("box"), F.lit("fill").alias("kind"), F.lit("#1a1a33").alias("color"), F.lit(1.0).alias("alpha"), F.lit(5).alias("paint_order"))
    images = docs.where("doc_id % 11 = 0").select("doc_id", F.lit(1).alias("page_number"), box(0, 0, 612, 792).alias("box"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("color"), F.lit(1.0).alias("alpha"), F.lit(1).alias("paint_order"))
    bars = docs.where("doc_id % 13 = 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("doc_id", F.lit(1).alias("page_number"), F.struct(F.lit(100.0).alias("x0"), (F.lit(300.0) - 20 * F.col("i")).alias("y0"), (F.lit(160.0) + 10 * F.col("i")).alias("x1"), (F.lit(306.0) - 20 * F.col("i")).alias("y1")).alias("box"), F.lit("fill").alias("kind"), F.lit("#336699").alias("color"), F.lit(1.0).alias("alpha"), (F.col("i") + 500).cast("int").alias("paint_order"))
    return fills.unionByName(images).unionByName(bars)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that runs of a document lie on."""
    runs = runs_in(spark, sf_dir).select("doc_id", "page_number").distinct()
    return runs.select("doc_id", "page_number", box(0, 0, 612, 792).alias("box"), F.when(F.col("doc_id") % 10 == 0, 90).otherwise(0).alias("rotation"), F.lit(1240).alias("img_width"), F.lit(1605).alias("img_height"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: a client address from the user, success from the event type."""
    u = F.col("user_id")
    ip = F.when(u % 3 == 0, F.concat(F.lit("2001:db8:"), F.hex(u), F.lit("::"), F.hex(F.col("event_id") % 9))).otherwise(F.concat(F.lit("198.51."), (u % 200).cast("string"), F.lit("."), (u % 250).cast("string")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.lower(ip).alias("client_ip"), (F.col("event_type") != "error").alias("succeeded"))


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("cv_id"), F.col("c_name").alias("file_name"), F.col("c_nationkey").alias("page_count"), F.col("c_acctbal").cast("double").alias("uploaded_at"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("cv_id"), F.when(F.col("o_orderkey") % 2 == 0, "mode-b").otherwise("mode-a").alias("mode"), F.col("o_orderdate").cast("string").alias("created_at"), (F.col("o_orderkey") % 101).cast("int").alias("overall_score"))


def job_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as matches; some name a review or document that does not fit, for the integrity rules."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    return li.select(
        (key * 10 + F.col("l_linenumber")).alias("match_id"),
        F.when(F.col("l_partkey") % 97 == 0, -key).otherwise(key).alias("review_id"),
        (F.col("l_suppkey") % 50).alias("cv_id"),
        (F.col("l_quantity").cast("int") * 2).alias("match_score"),
    )
