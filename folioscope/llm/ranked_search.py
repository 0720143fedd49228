"""Ranked lexical search, term at a time with a limited number of accumulators.

A scan of the texts leaves one posting per query term and document. Each item's terms are then
taken rarest first, in a few rounds: a round adds its terms' contributions to the item's
accumulators, one for each document met so far. After it, the k-th partial score is compared with
the most that all remaining terms can still give, the sum of the largest contributions in their
postings. Where a document that was never met could not reach the k-th partial score any more, the
item makes no more accumulators. Those that cannot reach it either are given up, and the others
are brought to their exact scores over the remaining terms, by document, so that the long postings
of frequent words never meet all their queries. No item is cut short: one whose bounds never fall
below goes through all its terms.

Scores are 64-bit integers. A document's place is that of its row, so that rows that repeat an id
are documents of their own.

Edge cases: null and empty texts hold no term; items without a term that some document holds have
no rows. Equal scores go by ascending doc_id (null first), then by row. Rows that repeat an item's
id are items of their own. A null id is carried through. An empty table gives no rows, and other
columns are ignored, whatever their names. Texts are read whole, one at a time within blocks of
bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.byte_words import text_slices, words_of
from folioscope.llm.common import Scratch


@dataclass(frozen=True)
class RankedSearchParams:
    k: int = 10
    steady: int = 8  # weight of a document's length against a term's occurrences, and of it in per cent
    slope: int = 90
    #: a round ends where remaining terms hold at most this share of an item's bound; the last takes the rest
    rounds: tuple[float, ...] = (0.5, 0.3, 0.15, 0.0)
    filter_terms: int = 200_000  # so many query terms, and bytes of them, go to every task at most; beyond, postings are joined with them
    filter_bytes: int = 4 << 20
    block_bytes: int = 16 << 20  # of text taken apart at a time
    shorter: str = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # a term, as code points; bytes of terms are those from 0x80 on, digits and letters


def postings_scanner(params: RankedSearchParams, wanted: list[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (doc, doc_id, text): (doc, doc_id, n, term, tf); and a row a block with a null term: doc texts that hold terms, n of those in all."""
    block_bytes = params.block_bytes
    is_term = np.zeros(256, bool)
    is_term[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
    is_term[0x80:] = True
    names = ["doc", "doc_id", "n", "term", "tf"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(wanted, pa.string()) if wanted is not None else None
        for batch in batches:
            doc, doc_id = batch.column(0), batch.column(1)
            for first, data, bounds in text_slices(batch.column(2), block_bytes):
                words = words_of(data, bounds, is_term)
                if not len(words.code):
                    continue
                n = np.bincount(words.row, minlength=len(bounds) - 1)
                yield pa.record_batch([pa.array([int((n > 0).sum())]), pa.nulls(1, pa.int64()), pa.array([len(words.code)]), pa.nulls(1, pa.string()), pa.array([0])], names=names)
                row, code, size = words.row, words.code, len(words.vocabulary)
                if known is not None:
                    held = pc.is_in(words.vocabulary, value_set=known).to_numpy(zero_copy_only=False)[code]
                    row, code = row[held], code[held]
                pair, tf = np.unique(row * size + code, return_counts=True)
                row, code = np.divmod(pair, size)
                for at in range(0, len(pair), 100_000):
                    part = slice(at, at + 100_000)
                    rows = pa.array(row[part] + first)
                    yield pa.record_batch([doc.take(rows), doc_id.take(rows), pa.array(n[row[part]]), words.vocabulary.take(pa.array(code[part])), pa.array(tf[part].astype(np.int64))], names=names)

    return scan


def terms_of(items: DataFrame, params: RankedSearchParams, text_col: str, id_col: str) -> DataFrame:
    """(item, item_id, term), each term of an item once; ``item`` tells rows apart."""
    lower = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_distinct(F.regexp_extract_all(lower, F.lit(params.shorter), F.lit(0)))
    told = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), found.alias("terms"))
    return told.select("item", "item_id", F.explode("terms").alias("term"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k first of each item, with ``rank``; lists are cut to k where they are before they meet."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id"), F.col("doc"))
    return scores.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def ranked_search(
    spark: SparkSession, docs: DataFrame, items: DataFrame, params: RankedSearchParams = RankedSearchParams(), doc_id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", query_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k highest-scoring documents above 0."""
    scratch = Scratch(spark, "search")
    asked = scratch.keep(terms_of(items, params, query_col, item_id_col), "asked")
    words = asked.select("term").distinct()
    size = words.agg(F.count("*").alias("terms"), F.sum(F.octet_length("term")).alias("bytes")).first()
    small = size["terms"] <= params.filter_terms and (size["bytes"] or 0) <= params.filter_bytes
    wanted = [r["term"] for r in words.collect()] if small else None

    texts = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(doc_id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = texts.mapInArrow(postings_scanner(params, wanted), "doc long, doc_id long, n long, term string, tf long")
    if not small:
        scanned = scanned.join(words.withColumn("asked", F.lit(True)), "term", "left").where("term IS NULL OR asked").drop("asked")
    postings = scratch.keep(scanned, "postings")
    whole = postings.where(F.col("term").isNull()).agg(F.coalesce(F.sum("doc"), F.lit(0)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    count, length = whole["n"], max(1, whole["l"])

    # what a term's weight is multiplied by in a document
    long = F.expr(f"{100 - params.slope} + ({params.slope}L * n * {count}L) div {length}L")
    postings = postings.where(F.col("term").isNotNull()).select("doc", "doc_id", "term", F.expr("tf * 1000000000").alias("tf9"), (F.col("tf") * 1000 + params.steady * long).alias("under"))
    postings = postings.select("doc", "doc_id", "term", F.expr("tf9 div under").alias("part"))
    stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    stats = stats.withColumn("w", F.floor(1000 * F.log(F.lit(2 * count + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long"))
    rarest = Window.partitionBy("item").orderBy("df", "term")
    weighed = asked.join(stats.where("w > 0"), "term").withColumn("bound", F.col("w") * F.col("most"))
    weighed = weighed.withColumn("after", F.sum("bound").over(Window.partitionBy("item")) - F.sum("bound").over(rarest.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("after") + F.col("bound")
    total = F.sum("bound").over(Window.partitionBy("item"))
    last = len(params.rounds) - 1
    turn = reduce(lambda so_far, i: F.when(before > total * params.rounds[i], i).otherwise(so_far), reversed(range(last)), F.lit(last))
    weights = scratch.keep(weighed.withColumn("round", turn.cast("int")).select("item", "item_id", "term", "w", "after", "round"), "weights")

    nothing = spark.createDataFrame([], "item long, doc long, doc_id long, score long")
    acc, open_items, survivors, due = nothing, weights.select("item").distinct(), [], []
    for i in range(last + 1):
        batch = scratch.again(weights).where(F.col("round") == i).join(open_items, "item", "left_semi").select("item", "term", "w")
        more = postings.join(batch, "term").select("item", "doc", "doc_id", (F.col("w") * F.col("part")).alias("score"))
        acc = acc.unionByName(more).groupBy("item", "doc").agg(F.max("doc_id").alias("doc_id"), F.sum("score").alias("score"))
        if i == last:
            break
        acc = scratch.keep(acc, "accumulators")
        kth = top(acc, params.k).where(F.col("rank") == params.k).select("item", F.col("score").alias("kth"))
        rest = scratch.again(weights).where(F.col("round") <= i).groupBy("item").agg(F.min("after").alias("rest"))
        closed = scratch.keep(rest.join(kth, "item").where("rest < kth"), "closed")
        survive = scratch.keep(acc.join(closed, "item").where("score + rest >= kth").select("item", "doc", "doc_id", "score"), "survivors")
        survivors.append(survive)
        due.append(survive.select("item", "doc").join(scratch.again(weights).where(F.col("round") > i).select("item", "term", "w"), "item"))
        open_items = open_items.join(scratch.again(closed), "item", "left_anti")
        acc = acc.join(scratch.again(closed), "item", "left_anti")
    due, survivors = reduce(DataFrame.unionByName, due), reduce(DataFrame.unionByName, survivors)
    gains = postings.select("doc", "term", "part").join(due, ["doc", "term"]).select("item", "doc", F.lit(None).cast("long").alias("doc_id"), (F.col("w") * F.col("part")).alias("score"))
    exact = survivors.unionByName(gains).groupBy("item", "doc").agg(F.max("doc_id").alias("doc_id"), F.sum("score").alias("score"))
    ids = scratch.again(weights).select("item", "item_id").distinct()
    return top(exact.unionByName(acc).where("score > 0"), params.k).join(ids, "item").select("item_id", "rank", "doc_id", "score")
