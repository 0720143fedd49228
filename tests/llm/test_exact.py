import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm.exact_dedup import ExactDedupParams, grow_directory, exact_dedup, normalised, without_copies


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normalised(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(((d, min(groups[normalised(t)])[3], len(groups[normalised(t)])) for d, t in rows), key=repr)


def test_matches_brute_force_with_nulls_ties_and_tiny_buckets(spark):
    random.seed(1)
    texts = ["", None, " \t\n", "a b", "ab", "a  b ", "é", "x" * 50_000, "A b"] + [f"text {n}" for n in range(40)]
    rows = [(n, random.choice(texts)) for n in range(300)] + [(None, "a b"), (5, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("key", F.lit("k"))
    out = exact_dedup(spark, docs, ExactDedupParams(bucket_bytes=400, bucket_rows=3)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=repr) == brute(rows)
    kept = [r.text_sha256 for r in out if r.kept]
    assert len(kept) == len(set(kept)) == len({normalised(t) for _, t in rows})


def test_repeated_rows_leave_one_and_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, " a", "y"), (3, "b", "z")], "doc_id long, text string, source string")
    out = without_copies(spark, docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, " a"), (3, "b")]


def test_empty_table(spark):
    assert exact_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("cells", [[], [(0, 5, 10)], [(i, 3, 30) for i in range(16)], [(3, 100, 1000), (12, 1, 1)]])
def test_directory_covers_every_slot_in_order(cells):
    made = grow_directory(cells, 4, ExactDedupParams(bucket_bytes=100, bucket_rows=6))
    buckets = made.buckets()
    assert list(buckets) == sorted(buckets) and set(buckets) == set(range(len(made.local)))
    assert sum(1 << (made.depth - d) for d in made.local.values()) == 1 << made.depth
