"""Display order of suggestions and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.highlight import priority_rank


def order_suggestions(suggestions: DataFrame) -> DataFrame:
    """Adds ``rank`` per document: high, medium, low, otherwise as they stand."""
    order = Window.partitionBy("doc_id").orderBy(priority_rank(F.col("priority")), "sug_ord")
    return suggestions.withColumn("rank", F.row_number().over(order))


def top_jobs(jobs: DataFrame, key: str = "review_id", n: int = 5) -> DataFrame:
    """The n best matches of each key; equal scores as they stand (``job_ord``)."""
    order = Window.partitionBy(key).orderBy(F.desc("match_score"), "job_ord")
    return jobs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
