"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when identical after deleting ASCII white space. Every distinct text has a 64-bit
key, the head of its SHA-256. A directory over the top bits of the keys doubles until no bucket is
overfull; each bucket belongs to one owner task, which reads its key range in key order, chains
texts whose keys collide and compares their bytes. The owners write the index to the shared folder.

Skew: each map task first folds its own copies of a text into one entry, so a group that holds a
third of all rows sends one entry per task to its owner. The way back from groups to rows is a
sort-merge join on the digest, of which Spark splits the skewed side; groups of one take no part.

Edge cases: a null or empty text counts as the empty string, so all such rows form one group. Of
rows that tie in length and doc_id (repeated rows) exactly one stays; a null doc_id sorts last.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import Rows, Scratch, rows_of, shuffle_partitions

ASCII_SPACE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class ExactDedupParams:
    bucket_bytes: int = 8 << 20  # a bucket over this splits; 256 MB suits 100 TB
    bucket_rows: int = 100_000
    fold_bytes: int = 32 << 20  # entries a map task holds before it hands them on


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, ASCII_SPACE)


def digest_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def slot_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """The top ``depth`` bits of signed 64-bit keys."""
    if depth == 0:
        return np.zeros(len(keys), np.int64)
    return (keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64)


@dataclass
class Directory:
    """Slots of ``depth`` top bits, each naming a bucket; a bucket covers 2^(depth - local) slots."""

    depth: int = 0
    local: dict[int, int] = field(default_factory=lambda: {0: 0})  # first slot of a bucket -> its local depth

    def double(self) -> None:
        self.depth += 1
        self.local = {first * 2: d for first, d in self.local.items()}

    def split(self, first: int) -> None:
        if self.local[first] == self.depth:
            self.double()
            first *= 2
        deeper = self.local[first] + 1
        self.local[first] = deeper
        self.local[first + (1 << (self.depth - deeper))] = deeper

    def buckets(self) -> np.ndarray:
        """Bucket numbers by slot, in key order."""
        out = np.empty(1 << self.depth, np.int64)
        for number, first in enumerate(sorted(self.local)):
            out[first : first + (1 << (self.depth - self.local[first]))] = number
        return out


def grow_directory(cells: list[tuple[int, int, int]], bits: int, params: ExactDedupParams) -> Directory:
    """cells: (top bits of the key, distinct texts, their bytes), at ``bits`` bits."""
    rows, size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for cell, n, b in cells:
        rows[cell], size[cell] = n, b
    rows, size = np.concatenate([[0], rows.cumsum()]), np.concatenate([[0], size.cumsum()])
    made = Directory()
    work = [(0, 0)]  # (prefix, its bits)
    while work:
        prefix, local = work.pop()
        low, high = prefix << (bits - local), (prefix + 1) << (bits - local)
        if local == bits or (rows[high] - rows[low] <= params.bucket_rows and size[high] - size[low] <= params.bucket_bytes):
            continue
        made.split(prefix << (made.depth - local))
        work += [(prefix * 2, local + 1), (prefix * 2 + 1, local + 1)]
    return made


def text_keys(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_key (of the unchanged text), code points, bytes, key, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            found = [normalised(t) for t in texts.to_pylist()]
            digests = [hashlib.sha256(b).digest() for b in found]
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pc.cast(pc.utf8_length(texts), pa.int64()), pa.array([len(b) for b in found], pa.int64()), pa.array(map(digest_key, digests), pa.int64()), pa.array(digests, pa.binary())],
                names=["doc_id", "text_key", "n_points", "n_bytes", "key", "digest"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text")).mapInArrow(run, "doc_id long, text_key long, n_points long, n_bytes long, key long, digest binary")


def directory_of(keys: DataFrame, params: ExactDedupParams) -> Directory:
    """Counts distinct texts by key prefix, deeper until no cell is overfull, and grows the directory.

    What reaches the driver is one row per filled cell, a number in proportion to the buckets.
    """
    texts = keys.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"))
    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
    want = max(total["n"] / params.bucket_rows, total["b"] / params.bucket_bytes, 1)
    bits = min(24, int(np.ceil(np.log2(want))) + 3)
    cell = F.shiftrightunsigned("key", 64 - bits)
    cells = texts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).collect()
    return grow_directory([tuple(c) for c in cells], bits, params)


ENTRY = pa.schema([("bucket", pa.int64()), ("owner", pa.int32()), ("key", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("n_rows", pa.int64()), ("n_points", pa.int64()), ("doc_id", pa.int64())])
INDEX = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("chain", pa.int32()), ("digest", pa.binary()), ("body", pa.binary()), ("n_rows", pa.int64()), ("n_points", pa.int64()), ("doc_id", pa.int64())])


def better(n: int, doc_id: int | None, than_n: int, than_id: int | None) -> bool:
    """More code points stay, then the smaller doc_id; a null doc_id comes last."""
    return n > than_n or n == than_n and doc_id is not None and (than_id is None or doc_id < than_id)


def folded_entries(docs: DataFrame, directory: Directory, owners: int, params: ExactDedupParams) -> DataFrame:
    """Each map task's distinct texts with their row counts and best rows, and their owner task."""
    depth, buckets = directory.depth, directory.buckets()
    n_buckets = len(directory.local)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            digests = [hashlib.sha256(b).digest() for b in held]
            keys = np.array([digest_key(d) for d in digests], np.int64)
            at = buckets[slot_of(keys, depth)]
            gathered = Rows(ENTRY)
            for (body, (n, points, best)), digest, key, bucket in zip(held.items(), digests, keys.tolist(), at.tolist(), strict=True):
                if full := gathered.add((bucket, bucket * owners // n_buckets, key, digest, body, n, points, best), len(body) + 96):
                    yield full
            yield gathered.flush()

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            body, points = normalised(text), len(text or "")
            if (entry := held.get(body)) is None:
                held[body] = [1, points, doc_id]
                size += len(body)
                if size > params.fold_bytes:
                    yield from filter(None, out())
                    held, size = {}, 0
            else:
                entry[0] += 1
                if better(points, doc_id, entry[1], entry[2]):
                    entry[1:] = points, doc_id
        yield from filter(None, out())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket long, owner int, key long, digest binary, body binary, n_rows long, n_points long, doc_id long")


def build_index(entries: DataFrame, owners: int) -> DataFrame:
    """Owner tasks walk their key range in order, chain collisions and merge entries with equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Rows(INDEX)
        now, chain = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for k, (bucket, digest, body, n, points, best) in enumerate(chain):
                if full := gathered.add((bucket, now, k, digest, body, n, points, best), len(body) + 96):
                    yield full

        for bucket, key, digest, body, n, points, doc_id in rows_of(batches, "bucket", "key", "digest", "body", "n_rows", "n_points", "doc_id", at_once=200):
            if key != now:
                yield from out()
                now, chain = key, []
            for entry in chain:
                if entry[2] == body:
                    entry[3] += n
                    if better(points, doc_id, entry[4], entry[5]):
                        entry[4:] = points, doc_id
                    break
            else:
                chain.append([bucket, digest, body, n, points, doc_id])
        yield from out()
        if last := gathered.flush():
            yield last

    return (
        entries.repartitionById(owners, F.col("owner"))
        .sortWithinPartitions("bucket", "key")
        .select("bucket", "key", "digest", "body", "n_rows", "n_points", "doc_id")
        .mapInArrow(run, "bucket long, key long, chain int, digest binary, body binary, n_rows long, n_points long, doc_id long")
    )


def exact_dedup(spark: SparkSession, docs: DataFrame, params: ExactDedupParams = ExactDedupParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key."""
    scratch = Scratch(spark, "exact")
    # row_id numbers repeated rows apart; it is fixed once the table is written
    keys = scratch.keep(text_keys(docs).withColumn("row_id", F.monotonically_increasing_id()), "keys")
    directory = directory_of(keys, params)
    owners = min(shuffle_partitions(spark), len(directory.local))
    index = scratch.keep(build_index(folded_entries(docs, directory, owners, params), owners), "index")
    groups = scratch.keep(
        index.where("n_rows > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("n_points").alias("keep_points"), F.col("n_rows").alias("group_size")),
        "groups",
    )
    scratch.drop(index)
    found = keys.join(groups, "digest", "left")
    stays = F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_points") == F.col("n_points"))
    # Only rows that tie for their group's place come here: one a group, unless rows repeat.
    first = keys.join(groups, "digest").where(stays).groupBy("digest").agg(F.min("row_id").alias("keep_row"))
    return found.join(first, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_key",
    )


def without_copies(spark: SparkSession, docs: DataFrame, params: ExactDedupParams = ExactDedupParams()) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    stays = exact_dedup(spark, docs, params).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    rows = docs.withColumn("__key_here", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(stays["__id"]) & (rows["__key_here"] == stays["__key"])
    # a row that is repeated whole comes through as often as it stands; one stays
    return rows.join(stays, same, "left_semi").dropDuplicates(["doc_id", "__key_here"]).drop("__key_here")
