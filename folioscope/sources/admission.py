"""Admission gates: the first failing rule of a file, document or request becomes its error_code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import seen_chars, trimmed
from folioscope.params import KEY_PREFIXES, MISTRAL_FAMILY, OPENAI_FAMILY, Admission

ERROR_CATALOG = (  # fixed values: code, status, retryable
    ("PDF_TOO_LARGE", 413, False), ("PDF_INVALID", 400, False), ("PDF_TOO_MANY_PAGES", 400, False), ("PDF_TOO_COMPLEX", 422, False),
    ("PDF_NO_TEXT_FOUND", 422, False), ("INVALID_INPUT", 400, False),
)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def admit_files(files: DataFrame, params: Admission = Admission()) -> DataFrame:
    """Size before header, so the content of a file that is too large is never looked at."""
    head = F.decode(F.substring("content", 1, params.header_bytes), "ISO-8859-1")
    code = F.when(F.col("length") > params.file_bytes, "PDF_TOO_LARGE").when(F.instr(head, "%PDF-") == 0, "PDF_INVALID")
    return files.withColumn("error_code", code)


def admit_layout(pages: DataFrame, runs: DataFrame, shapes: DataFrame, texts: DataFrame, params: Admission = Admission()) -> DataFrame:
    """(doc_id, error_code): page count, page side, runs and shapes a page, then visible characters.

    ``texts`` holds doc_id and visible text. Counts aggregate partially before they shuffle.
    """
    side = F.greatest(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0"))
    by_doc = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.max(side).alias("side"))
    most = lambda df, name: df.groupBy("doc_id", "page_number").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias(name))
    seen = texts.select("doc_id", seen_chars(F.col("text")).alias("seen"))
    found = seen.join(by_doc, "doc_id", "left").join(most(runs, "most_runs"), "doc_id", "left").join(most(shapes, "most_shapes"), "doc_id", "left")
    code = (
        F.when(F.col("n_pages") > params.pages, "PDF_TOO_MANY_PAGES")
        .when((F.col("side") > params.page_side) | (F.col("most_runs") > params.runs_a_page) | (F.col("most_shapes") > params.shapes_a_page), "PDF_TOO_COMPLEX")
        .when(F.coalesce("seen", F.lit(0)) < params.least_chars, "PDF_NO_TEXT_FOUND")
    )
    return found.select("doc_id", code.alias("error_code"))


def choose_text_source(primary: DataFrame, fallback: DataFrame, params: Admission = Admission()) -> DataFrame:
    """Runs with ``source``: the fallback where it has enough text and the primary under half of that."""
    total = lambda df, name: df.groupBy("doc_id").agg(F.sum(seen_chars(F.col("text"))).alias(name))
    sums = total(primary, "p").join(total(fallback, "f"), "doc_id", "full").select("doc_id", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("f", F.lit(0)).alias("f"))
    choice = sums.select("doc_id", F.when((F.col("f") >= params.least_chars) & (F.col("p") < F.col("f") * 0.5), "fallback").otherwise("primary").alias("source"))
    mine = primary.join(choice.where("source = 'primary'"), "doc_id")
    return mine.unionByName(fallback.join(choice.where("source = 'fallback'"), "doc_id"), allowMissingColumns=True)


def fallback_runs(text_content: DataFrame) -> DataFrame:
    """Runs known by text and place only: no family, style or colour, never hidden."""
    return (
        text_content.withColumn("font_family", F.lit("Unknown")).withColumn("bold", F.lit(False)).withColumn("italic", F.lit(False)).withColumn("color", F.lit(None).cast("string"))
        .withColumn("hidden", F.lit(False)).withColumn("hidden_reasons", F.array().cast("array<string>"))
    )


def normalize_page(pages: DataFrame) -> DataFrame:
    b = F.col("box")
    corners = F.struct(F.least(b.x0, b.x1).alias("x0"), F.least(b.y0, b.y1).alias("y0"), F.greatest(b.x0, b.x1).alias("x1"), F.greatest(b.y0, b.y1).alias("y1"))
    turn = F.pmod("rotation", F.lit(360))
    return pages.withColumn("box", corners).withColumn("rotation", F.when(turn % 90 == 0, turn).otherwise(0).cast("int"))


def validate_requests(requests: DataFrame, params: Admission = Admission()) -> DataFrame:
    """Request rows with error_code; mode-b requests lose title and posting."""
    posting = F.length(trimmed(F.coalesce("posting", F.lit(""))))
    a, b = F.col("mode") == "mode-a", F.col("mode") == "mode-b"
    code = (
        F.when(~F.coalesce(F.col("mode").isin("mode-a", "mode-b"), F.lit(False)), "INVALID_INPUT")
        .when(a & ((posting == 0) | (posting > params.posting_chars)), "INVALID_INPUT")
        .when((F.length(F.coalesce("title", F.lit(""))) > params.short_chars) | (F.length(F.coalesce("model", F.lit(""))) > params.short_chars), "INVALID_INPUT")
        .when(F.coalesce("file_size", F.lit(0)) == 0, "INVALID_INPUT")
        .when(F.col("file_size") > params.file_bytes, "PDF_TOO_LARGE")
    )
    return requests.withColumn("error_code", code).withColumn("title", F.when(~b, F.col("title"))).withColumn("posting", F.when(~b, F.col("posting")))


def classify_prefix(tokens: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """Adds ``provider`` to (token, model): the first prefix that fits, else a rule on the model family.

    The prefix table is a parameter of a few rows; by default it is in the expression itself.
    """
    token = trimmed(F.col("token"))
    if prefixes is None:
        by_prefix: Column = F.coalesce(*(F.when(token.startswith(p), F.lit(name)) for p, name in KEY_PREFIXES))
        found = tokens.withColumn("__named", by_prefix)
    else:
        order = prefixes.agg(F.sort_array(F.collect_list(F.struct("priority", "prefix", "provider"))).alias("__prefixes"))
        found = tokens.join(F.broadcast(order))
        found = found.withColumn("__named", F.get(F.filter("__prefixes", lambda p: token.startswith(p["prefix"])), F.lit(0))["provider"]).drop("__prefixes")
    family = F.when(F.col("model").contains("/"), "").otherwise(F.lower(trimmed(F.coalesce("model", F.lit("")))))
    generic = F.when(family.startswith("deepseek"), "deepseek").when(family.rlike(OPENAI_FAMILY), "openai")
    rule = F.when(token.startswith("sk-"), generic).when(family.rlike(MISTRAL_FAMILY), "mistral")
    return found.withColumn("provider", F.coalesce("__named", rule)).drop("__named")


def error_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERROR_CATALOG, "error_code string, status int, retryable boolean")


def error_catalog_join(errors: DataFrame, catalog: DataFrame) -> DataFrame:
    """Status and retryability of every error code; the catalog is a parameter table of a few dozen rows."""
    return errors.join(F.broadcast(catalog), "error_code", "left")
