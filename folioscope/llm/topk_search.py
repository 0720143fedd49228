"""Exact top-k search by tiled integer matrix products.

Vectors are quantised to floor(256 * x). Queries and candidates are dealt into blocks of bounded
size by a hash of their id; a tile is one query block against one candidate shard, and every pair of
blocks is met in exactly one tile. A tile multiplies strips of its matrices and selects each query's
best candidates at once, so only k rows a query leave it; the lists are then merged level by level,
a bounded number at a time. The stated query set meets all rows in blocks; nothing is broadcast.

Ties go to the smaller id, exactly: a tile orders candidates by id and selects on one integer that
holds score and position. Scores are exact: float64 products where the bound of a dot product is
below 2^53, int64 ones otherwise.

Edge cases: vectors that are null, empty or hold null or non-finite components, and rows with a
null id, take no part. Vectors of different lengths are never compared: a query meets those of its
own length. Rows that repeat an id are searched like others, but no row meets its own id. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Scratch


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    query_rows: int = 2048  # rows a query block holds, about
    shard_rows: int = 8192  # rows a candidate shard holds, about
    strip: int = 256  # queries multiplied at a time
    fan_in: int = 16  # lists of a query merged at a time


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Usable vectors only, as (vec_id, q array<bigint>, dim)."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256)).alias("q"), F.size(x).alias("dim"))


def matrix(table: pa.Table, dim: int) -> np.ndarray:
    flat = table.column("q").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best_in_tile(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, shard_ids: np.ndarray, k: int, strip: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per strip of queries: query ids, candidate ids and scores of each one's k best in this shard."""
    order = np.argsort(shard_ids, kind="stable")
    shard, shard_ids = shard[order], shard_ids[order]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * shard.shape[1]
    kind = np.float64 if bound < 2**53 else np.int64
    right, n = shard.astype(kind).T, len(shard_ids)
    for start in range(0, len(queries), strip):
        ids = query_ids[start : start + strip]
        scores = (queries[start : start + strip].astype(kind) @ right).astype(np.int64)
        own = ids[:, None] == shard_ids[None, :]
        if bound * n < 2**62:  # one integer that orders by score, then by smaller id
            rank = scores * n + (n - 1 - np.arange(n))
            rank[own] = np.iinfo(np.int64).min
            top = np.argpartition(rank, max(0, n - k), axis=1)[:, max(0, n - k) :]
        else:
            top = np.stack([np.lexsort((np.arange(n), -s, o))[:k] for s, o in zip(scores, own, strict=True)])
        row, _ = np.indices(top.shape)
        keep = ~own[row, top]
        yield ids[row[keep]], shard_ids[top[keep]], scores[row[keep], top[keep]]


def topk_search(spark: SparkSession, vectors: DataFrame, is_query, params: TopKParams = TopKParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of each query.

    ``is_query`` is a Column over (vec_id) that states the query set.
    """
    scratch = Scratch(spark, "topk")
    q = scratch.keep(quantised(vectors, id_col, vector_col), "vectors")
    counts = q.agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries")).first()
    blocks = max(1, -(-counts["queries"] // params.query_rows))
    shards = max(1, -(-counts["n"] // params.shard_rows))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = q.where(is_query).withColumn("block", place(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = scratch.again(q).withColumn("shard", place(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[2].as_py()
        found = [], [], []
        if mine.num_rows and theirs.num_rows:
            ids = mine.column("vec_id").to_numpy(), theirs.column("vec_id").to_numpy()
            for part in best_in_tile(matrix(mine, dim), ids[0], matrix(theirs, dim), ids[1], params.k, params.strip):
                for to, x in zip(found, part, strict=True):
                    to.append(x)
        of = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
        ids, others, scores = map(of, found)
        return pa.table({"query_id": ids, "vec_id": others, "score": scores, "level": pa.array([shard] * len(ids), pa.int32())})

    lists = left.groupBy("dim", "block", "shard").cogroup(right.groupBy("dim", "block", "shard")).applyInArrow(tile, "query_id long, vec_id long, score long, level int")
    order = F.col("score").desc(), F.col("vec_id")
    while shards > 1:  # a tree: at each level fan_in lists of a query become one
        shards = -(-shards // params.fan_in)
        lists = lists.withColumn("level", F.floor(F.col("level") / params.fan_in).cast("int"))
        ranked = Window.partitionBy("query_id", "level").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= params.k).select("query_id", "vec_id", "score", "level")
    ranked = Window.partitionBy("query_id").orderBy(*order)
    return lists.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")
