"""Connected components of a link table, by alternating large-star and small-star steps.

Each step groups links by a node with partial aggregation (a minimum) and joins the minimum back,
of which Spark splits a skewed side; no neighbour list is ever gathered. Rounds grow with the
logarithm of the component size, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Scratch


def stars(links: DataFrame, large: bool) -> DataFrame:
    """One step. Large: a node's larger neighbours move to its least one; small: its smaller ones do."""
    if large:
        near = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    moved = near.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b); the component is its least id.

    Links of a node to itself and repeated links change nothing; nodes without others are left out.
    """
    now = scratch.keep(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    mark = None
    while not now.isEmpty():
        after = scratch.keep(stars(stars(now, True), False), "links")
        scratch.drop(now)
        now = after
        # F.sum of a 64-bit hash may wrap in ANSI mode, so its 32-bit half is summed
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
