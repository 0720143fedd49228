"""Whole commits over several tables: conflicts, recovery, copy-on-write deletion."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.operators import store as D
from folioscope.operators.commit import CommitConflict, Store


def batch(spark, low: int, high: int):
    ids = spark.range(low, high).select(F.col("id").alias("cv_id"))
    reviews = ids.select((F.col("cv_id") * 10).alias("review_id"), "cv_id", F.lit("mode-b").alias("mode"), F.lit("2026").alias("created_at"))
    return {
        "cvs": ids.withColumn("file_name", F.col("cv_id").cast("string")),
        "cv_files": ids.withColumn("content", F.lit(b"%PDF")),
        "cv_pages": ids.withColumn("page_number", F.lit(1)),
        "reviews": reviews,
        "job_matches": reviews.select((F.col("review_id") + 1).alias("match_id"), "review_id", "cv_id", F.lit(5).alias("match_score")),
    }


def files(store, table):
    return {f["path"] for f in store.manifest()[table]["files"]}


def test_delete_rewrites_only_files_that_hold_the_document(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for low in (0, 100, 200):
        assert D.saved(store, batch(spark, low, low + 100))
    before = {t: files(store, t) for t in D.TABLES}
    touched = D.cascade_delete(store, spark.createDataFrame([(150,), (151,), (None,), (999,), (150,)], "cv_id long"))
    assert set(touched) == set(D.TABLES)
    for t in D.TABLES:
        assert before[t] - files(store, t) == touched[t] and len(touched[t]) < len(before[t])
        assert sorted(r[0] for r in store.read(t).select("cv_id").collect()) == [i for i in range(300) if i not in (150, 151)]
        assert store.read(t, 3).count() == 300  # an earlier state can still be read
    assert store.version() == 4
    # between the bounds of a file, but in none
    assert D.cascade_delete(store, spark.createDataFrame([(150,)], "cv_id long")) == {}
    assert D.cascade_delete(store, spark.createDataFrame([], "cv_id long")) == {}
    assert store.version() == 4
    left = D.cascade_delete(store, spark.range(0, 300).select(F.col("id").alias("cv_id")))
    assert set(left) == set(D.TABLES) and store.read("cvs").count() == 0


def test_the_second_of_two_writers_starts_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))  # a path without a scheme
    base = store.version()
    assert D.saved(store, batch(spark, 0, 5))
    with pytest.raises(CommitConflict):
        store.commit(batch(spark, 5, 10), base=base)
    assert store.read("cvs").count() == 5
    assert len(store.recover()) == len(D.TABLES)  # the files of the one that lost
    assert store.recover() == []
    assert D.saved(store, batch(spark, 5, 10)) and store.read("reviews").count() == 10


def test_broken_batches_leave_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert D.saved(store, batch(spark, 0, 5))
    good = batch(spark, 5, 8)
    odd = {
        "orphan review": good | {"cvs": good["cvs"].where("cv_id <> 6")},
        "orphan match": good | {"job_matches": good["job_matches"].withColumn("review_id", F.lit(-1).cast("long"))},
        "mode": good | {"reviews": good["reviews"].withColumn("mode", F.lit("mode-a"))},
        "owner": good | {"job_matches": good["job_matches"].withColumn("cv_id", F.lit(7).cast("long"))},
    }
    for wrong in odd.values():
        assert not D.saved(store, wrong)
    assert store.version() == 1 and store.recover() == []
    # a review of a document that is there already, and matches of a review that is
    later = batch(spark, 3, 4)
    assert D.saved(store, {"reviews": later["reviews"].withColumn("review_id", F.col("review_id") + 5)})
    assert D.saved(store, {"job_matches": later["job_matches"]})
    assert store.read("job_matches").where("cv_id = 3").count() == 2
    assert Store(spark, f"file://{tmp_path}/none").read("cvs") is None
