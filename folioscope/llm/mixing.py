"""Mixing sources to target weights by weighted fair queueing.

Every source has a target of words: its weight's share of the budget, at most ``epochs`` times its
size, where the excess is shared again by weight. Each source queues its documents in a shuffled
order that a hash of the document's id fixes, once an epoch. A document's virtual finish time is
the words of its source up to its end, divided by the source's target. The queues are merged by a
global range-sort on that time and cut where the budget is used up, so that each source has had
its share at every point of the mix, and the last document is cut to the words that are left.

Running sums over a sorted table are made the same way each time: rows are range-partitioned, each
partition adds up its own, and the partitions' totals, one row each, are added up and joined back.
So no source is summed up by one task, and the sources themselves may be many.

Edge cases: null and empty texts have size 0 and are taken 0 times; a source without words has
target 0. A null source is a source of its own, last in order. Rows that repeat an id are
documents of their own, next to each other in the shuffle. Null ids take part. An empty table
gives no rows, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import Scratch


@dataclass(frozen=True)
class MixingParams:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources in order, repeating
    budget_percent: int = 150  # of all words
    epochs: int = 2  # times that a document is taken at most
    seed: str = "mix"


def running(scratch: Scratch, rows: DataFrame, order: list[str], value: str, total: str) -> DataFrame:
    """``rows`` with ``total``, the sum of the long ``value`` over the rows up to and with each one in ``order`` (columns, no two rows alike)."""
    schema = rows.schema
    at = schema.fieldNames().index(value)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            sums = np.cumsum(batch.column(at).to_numpy(zero_copy_only=False)) + so_far
            so_far = int(sums[-1]) if len(sums) else so_far
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "__sum"])

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, __sum long")
    placed = scratch.keep(placed.withColumn("__part", F.spark_partition_id()), "placed")
    ends = placed.groupBy("__part").agg(F.max("__sum").alias("__end"))
    # one row a partition, of which the plan has a set number
    ends = sorted((r["__part"], r["__end"]) for r in ends.collect())
    before = np.cumsum([0, *(end for _, end in ends)])[:-1]
    offsets = scratch.spark.createDataFrame([(part, int(b)) for (part, _), b in zip(ends, before, strict=True)], "__part int, __before long")
    return placed.join(F.broadcast(offsets), "__part").withColumn(total, F.col("__sum") + F.col("__before")).drop("__part", "__sum", "__before")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(scratch: Scratch, sizes: DataFrame, params: MixingParams) -> DataFrame:
    """(source, place, source_size, target) of each source.

    Sources in order of size over weight: as many of the first as cannot use up their share of what
    is left have ``epochs`` times their size, all others share the rest by weight.
    """
    known = sizes.withColumn("last", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).withColumn("one", F.lit(1).cast("long"))
    placed = running(scratch, known, ["last", "name"], "one", "place")
    w = F.element_at(F.array(*map(F.lit, params.weights)), (F.pmod(F.col("place") - 1, F.lit(len(params.weights))) + 1).cast("int"))
    placed = placed.select("source", "place", "source_size", w.cast("long").alias("weight"))
    most = placed.withColumn("most", F.col("source_size") * params.epochs).withColumn("ratio", F.col("most") / F.col("weight"))
    summed = running(scratch, running(scratch, most, ["ratio", "place"], "most", "filled"), ["ratio", "place"], "weight", "weighed")
    summed = scratch.keep(summed, "filled")
    whole = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget, weight = (whole["words"] or 0) * params.budget_percent // 100, whole["weight"] or 0
    left, others = F.lit(budget) - F.col("filled") + F.col("most"), F.lit(weight) - F.col("weighed") + F.col("weight")
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products pass 64 bits
    full = summed.withColumn("full", wide(F.col("most")) * wide(others) <= wide(left) * wide(F.col("weight")))
    held = full.where("full").agg(F.coalesce(F.sum("most"), F.lit(0)).alias("most"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    share = F.col("weight") * F.lit(budget - held["most"]) / F.lit(max(1, weight - held["weight"]))
    return full.select("source", "place", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def mixed(spark: SparkSession, docs: DataFrame, params: MixingParams = MixingParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    scratch = Scratch(spark, "mix")
    turn = F.md5(F.concat_ws(":", F.lit(params.seed), F.col(id_col).cast("string")))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), turn.alias("turn"), F.monotonically_increasing_id().alias("row"))
    sized = scratch.keep(sized, "sized")
    sources = scratch.keep(targets(scratch, sized.groupBy("source").agg(F.sum("size").alias("source_size")), params), "targets")
    queued = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "turn", "row", "place", "source_size", "target")
    order = ["place", "turn", "doc_id", "row"]
    queued = running(scratch, queued, order, "size", "ended")
    firsts = running(scratch, scratch.again(sources).select("place", "source_size"), ["place"], "source_size", "through").select("place", (F.col("through") - F.col("source_size")).alias("began"))
    queued = scratch.keep(queued.join(firsts, "place").withColumn("ended", F.col("ended") - F.col("began")).drop("began"), "queued")

    finish = lambda epoch: (F.col("ended") + epoch * F.col("source_size")) / F.col("target")
    copies = queued.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(params.epochs - 1))))
    copies = copies.select(finish(F.col("epoch")).alias("finish"), "place", "epoch", "turn", "doc_id", "row", "size")
    key = ["finish", "place", "epoch", "turn", "doc_id", "row"]
    merged = scratch.keep(running(scratch, copies, key, "size", "through"), "merged")
    budget = (queued.agg(F.sum("size").alias("words")).first()["words"] or 0) * params.budget_percent // 100
    whole = merged.where(F.col("through") <= budget).groupBy("row").agg(F.sum("size").alias("taken"))
    cut = merged.where((F.col("through") > budget) & (F.col("through") - F.col("size") < budget)).select("row", (F.lit(budget) - F.col("through") + F.col("size")).alias("taken"))
    taken = whole.unionByName(cut).groupBy("row").agg(F.sum("taken").alias("taken"))
    return scratch.again(queued).join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
