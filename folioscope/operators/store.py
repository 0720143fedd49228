"""History: newest-first lists, latest review per document, integrity rules, all-or-nothing writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.commit import Store, committed
from folioscope.operators.highlight import highlight_boxes, locate_highlight, page_text_map, page_texts, place_highlights


def list_cvs(cvs: DataFrame) -> DataFrame:
    """Newest first, without file bytes; equal times by id, larger first."""
    return cvs.drop("content").orderBy(F.desc("uploaded_at"), F.desc("cv_id"))


def reviews_by_cv(reviews: DataFrame, cv_id: int) -> DataFrame:
    return reviews.where(F.col("cv_id") == cv_id).orderBy(F.desc("created_at"), F.desc("review_id"))


def matches_by_cv(matches: DataFrame, cv_id: int) -> DataFrame:
    return matches.where(F.col("cv_id") == cv_id).orderBy(F.desc("match_score"), F.desc("match_id"))


def matches_by_review(matches: DataFrame, review_id: int) -> DataFrame:
    return matches.where(F.col("review_id") == review_id).orderBy(F.desc("match_score"), F.desc("match_id"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The newest review of every document, by one aggregation with a map-side part."""
    cols = [c for c in reviews.columns if c != "cv_id"]
    return reviews.groupBy("cv_id").agg(F.max_by(F.struct(*cols), F.struct("created_at", "review_id")).alias("r")).select("cv_id", "r.*")


def list_history(cvs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every document with its latest review or nulls."""
    return cvs.join(latest_reviews(reviews), "cv_id", "left")


def stored_highlights(reviews: DataFrame, runs: DataFrame, raw: DataFrame, pages: DataFrame) -> DataFrame:
    """(review_id, highlights): the boxes of a review's quotes on its document's pages, from stored text and runs.

    ``reviews`` has one review a document with ``suggestions`` (id, snippet, page_number, ..). Only
    documents that quote something are looked at.
    """
    asked = reviews.select(F.col("cv_id").alias("doc_id"), "review_id", F.explode("suggestions").alias("s")).where("coalesce(s.snippet, '') <> ''")
    asked = asked.select("doc_id", "review_id", "s.id", "s.snippet", "s.page_number")
    docs = asked.select("doc_id").distinct()
    mine, texts = runs.join(docs, "doc_id", "left_semi"), raw.join(docs, "doc_id", "left_semi")
    mapped = page_text_map(mine, texts)
    rects = place_highlights(highlight_boxes(locate_highlight(asked, page_texts(mapped)), mapped, mine), pages)
    shown = rects.join(asked.select("doc_id", "review_id", "id").distinct(), ["doc_id", "id"])
    return shown.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("id", "page_number", "line", "rect"))).alias("highlights"))


def load_analysis(
    cvs: DataFrame, reviews: DataFrame, matches: DataFrame, cv_id: int | None = None, review_id: int | None = None, pages: DataFrame | None = None, runs: DataFrame | None = None, raw: DataFrame | None = None
) -> DataFrame:
    """Documents with one review (the latest, or the named one) and its matches as an array, best first.

    With ``pages`` (doc_id, page_number, box, rotation, img_width, img_height) their images are an
    array too; with ``runs`` and ``raw`` text of the documents the review's highlights are made anew.
    """
    chosen = latest_reviews(reviews) if review_id is None else reviews.where(F.col("review_id") == review_id)
    base = cvs if cv_id is None else cvs.where(F.col("cv_id") == cv_id)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("match_score")).alias("down"), (-F.col("match_id")).alias("newest"), "match_id", "match_score"))), lambda m: F.struct(m["match_id"].alias("match_id"), m["match_score"].alias("match_score")))
    by_review = matches.groupBy("review_id").agg(ranked.alias("matches"))
    out = base.join(chosen, "cv_id", "left").join(by_review, "review_id", "left")
    out = out.withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<match_id:bigint,match_score:int>>")))
    if pages is not None:
        images = pages.groupBy(F.col("doc_id").alias("cv_id")).agg(F.array_sort(F.collect_list(F.struct("page_number", "img_width", "img_height"))).alias("pages"))
        out = out.join(images, "cv_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(images.schema["pages"].dataType)))
        if runs is not None and raw is not None:
            held = chosen.join(base.select("cv_id"), "cv_id", "left_semi")
            shown = stored_highlights(held, runs, raw, pages)
            out = out.join(shown, "review_id", "left").withColumn("highlights", F.coalesce("highlights", F.array().cast(shown.schema["highlights"].dataType)))
    return out


def orphan_reviews(reviews: DataFrame, cvs: DataFrame) -> DataFrame:
    return reviews.join(cvs.select("cv_id"), "cv_id", "left_anti")


def orphan_matches(matches: DataFrame, reviews: DataFrame) -> DataFrame:
    return matches.join(reviews.select("review_id"), "review_id", "left_anti")


def match_mode_violations(matches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Matches of reviews that compare with a posting; only mode-b reviews have matches."""
    return matches.join(reviews.where("mode <> 'mode-b'").select("review_id"), "review_id", "left_semi")


def match_cv_violations(matches: DataFrame, reviews: DataFrame) -> DataFrame:
    owner = reviews.select("review_id", F.col("cv_id").alias("review_cv"))
    return matches.join(owner, "review_id").where(F.col("cv_id") != F.col("review_cv"))


def violations(matches: DataFrame, reviews: DataFrame, cvs: DataFrame) -> DataFrame:
    """(rule, id) of every broken rule."""
    parts = (
        (orphan_reviews(reviews, cvs), "orphan_reviews", "review_id"), (orphan_matches(matches, reviews), "orphan_matches", "match_id"),
        (match_mode_violations(matches, reviews), "match_mode", "match_id"), (match_cv_violations(matches, reviews), "match_cv", "match_id"),
    )
    out = None
    for df, rule, key in parts:
        rows = df.select(F.lit(rule).alias("rule"), F.col(key).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Tables of the store; every one has the key of its document.
TABLES = ("cvs", "cv_files", "cv_pages", "reviews", "job_matches")


def all_or_nothing_batch(store: Store, tables: dict[str, DataFrame], broken: DataFrame, base: int | None = None) -> bool:
    """Commits every table of a batch at once, unless a rule is broken."""
    if not broken.isEmpty():
        return False
    store.commit(tables, base=base)
    return True


def saved(store: Store, batch: dict[str, DataFrame]) -> bool:
    """Saves a batch of analyses (tables of ``TABLES``) whole, or not at all.

    Reviews and matches may belong to documents and reviews that the store has already.
    """

    def change(base: int) -> bool:
        def all_of(table: str) -> DataFrame | None:
            held, new = store.read(table, base), batch.get(table)
            return held.unionByName(new) if held is not None and new is not None else held if new is None else new

        cvs, reviews = all_of("cvs"), all_of("reviews")
        new_reviews, new_matches = batch.get("reviews"), batch.get("job_matches")
        if new_matches is None and new_reviews is None:
            return all_or_nothing_batch(store, batch, store.spark.range(0), base)
        new_reviews = reviews.limit(0) if new_reviews is None else new_reviews
        broken = orphan_reviews(new_reviews, cvs).select(F.lit("orphan_reviews").alias("rule"), F.col("review_id").alias("id"))
        if new_matches is not None:
            broken = broken.unionByName(violations(new_matches, reviews, cvs).where("rule <> 'orphan_reviews'"))
        return all_or_nothing_batch(store, batch, broken, base)

    return committed(store, change)


def write_report(spark: SparkSession, cvs: DataFrame, reviews: DataFrame, matches: DataFrame, path: str, files: DataFrame | None = None, pages: DataFrame | None = None) -> bool:
    """Saves analyses with their documents, file bytes and pages to the store at ``path``, whole or not at all."""
    batch = {"cvs": cvs, "cv_files": files, "cv_pages": pages, "reviews": reviews, "job_matches": matches}
    return saved(Store(spark, path), {name: df for name, df in batch.items() if df is not None})


def cascade_delete(store: Store, gone: DataFrame) -> dict[str, set[str]]:
    """Takes the documents in ``gone`` (cv_id) out of every table in one commit; returns the files written anew."""
    return committed(store, lambda _: store.replace_rows(list(TABLES), gone))
