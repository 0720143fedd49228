"""Running sums of which no key is one task: a prefix scan over time blocks.

Each key's rows are cut into blocks of time. A block is summed on its own, by tasks of their own;
what came before it is added up over the blocks' totals, a row each, and joined back. For the least
running sum so far, a block passes on its sum and its own least running sum; such pairs compose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, keys: list[str], at: str, tie: str, change: Column, block: int, total: str, least: str | None = None) -> DataFrame:
    """Adds ``total``, the sum of ``change`` over the rows of ``keys`` up to and with this one by (``at``, ``tie``).

    ``least``, if named, is added too: the smallest total up to and with this row. ``block`` is the
    length of a block in seconds. Null keys are a key; a null change counts as 0; rows with a null
    time come first, as a block of their own.
    """
    made = ["__change", "__block", "__sum", "__low", "__start", "__floor"]
    micros = F.expr(f"unix_micros(cast(`{at}` as timestamp)) div {block * 1_000_000}L")
    r = rows.withColumn("__change", F.coalesce(change.cast("long"), F.lit(0))).withColumn("__block", micros)
    inside = Window.partitionBy(*keys, "__block").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("__sum", F.sum("__change").over(inside))
    ends = [F.sum("__change").alias("__ends")]
    if least:
        r = r.withColumn("__low", F.min("__sum").over(inside))
        ends.append(F.min("__sum").alias("__lows"))
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (r if least else r.drop("__sum")).groupBy(*keys, "__block").agg(*ends)
    blocks = blocks.withColumn("__start", F.coalesce(F.sum("__ends").over(before), F.lit(0)))
    if least:
        blocks = blocks.withColumn("__floor", F.min(F.col("__start") + F.col("__lows")).over(before))
    blocks = blocks.select(*(F.col(k).alias(f"__of_{k}") for k in [*keys, "__block"]), "__start", *(["__floor"] if least else []))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in [*keys, "__block"]))
    out = r.join(blocks, same).withColumn(total, F.col("__start") + F.col("__sum"))
    if least:
        out = out.withColumn(least, F.least("__floor", F.col("__start") + F.col("__low")))
    return out.drop(*made, *(f"__of_{k}" for k in [*keys, "__block"]))
