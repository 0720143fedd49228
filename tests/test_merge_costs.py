"""What the merged score makes and moves: no sentences, nothing of a document's size broadcast, nothing kept in executors' memory."""

from __future__ import annotations

from folioscope.operators import merge as G
from folioscope.plans import reports
from folioscope.plans import scoring as Q

SMALL = "/root/testdata/sf0.001"


def test_scores_without_sentences_are_the_same_scores(spark):
    narrow = Q.checks(spark, SMALL, fields=("check_id", "check_ord", "score", "status"))
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert not any(sentence in plan for sentence in ("Missing: ", "Needs fixing", "No skills section", "bullet points have numbers"))
    assert sorted(narrow.collect()) == sorted(Q.checks(spark, SMALL).drop("detail").collect())


def test_merged_score_broadcasts_no_table_of_documents(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # any size that a session may allow
        score = reports.q_merge_score(spark, SMALL)
        score.count()
        plan = score._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Broadcast" not in plan and "InMemoryTableScan" not in plan


def test_merge_of_checks_with_and_without_detail(spark):
    rules = spark.createDataFrame([(1, 0, "keyword", 0, 50, "fail", "r"), (1, 0, "skills", 1, 90, "pass", "r"), (1, 0, "formatting", 3, 40, "warn", "r")], "doc_id long, posting_id long, check_id string, check_ord int, score int, status string, detail string")
    model = spark.createDataFrame([(1, 0, "keyword", 85, "m"), (1, 0, "skills", 10, ""), (1, 0, "formatting", 99, "m")], "doc_id long, posting_id long, check_id string, score int, detail string")
    want = [("formatting", 40, "warn", "r"), ("keyword", 85, "pass", "m"), ("skills", 90, "pass", "r")]
    columns = ["check_id", "score", "status", "detail"]
    assert sorted(tuple(r) for r in G.merge_checks(rules, model).select(*columns).collect()) == want
    assert sorted(tuple(r) for r in G.merge_checks(rules.drop("detail"), model).select(*columns[:3]).collect()) == [w[:3] for w in want]
