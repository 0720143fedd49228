"""Substring deduplication with a log-structured fingerprint index.

A window is 50 consecutive words. Of all windows of a document the index keeps the content-defined
ones: every window's least hash of 10 consecutive words, about one in 21 positions. Two equal
windows have the same least hash, so no repeat escapes, whatever its place.

``FingerprintLog.ingest`` takes a batch: its fingerprints are merge-joined with the historical runs and
become a sorted immutable run on the shared folder themselves. What they share with other documents
only nominates windows; those are verified by two independent hashes over all 50 words (64 and 32
bits, from different word hashes). Runs are compacted into one when there are too many of them. The
query ingests its table in two ranges of doc_id, so the second meets the run of the first.

Skew: fingerprints and windows are grouped with partial aggregation (minimum and maximum doc_id);
the joins back are sort-merge joins of which Spark splits the skewed side. No list of a passage's
documents is ever gathered; only lists of one document's own positions are.

Edge cases: a null or empty text has no words; under 50 words there is no window. Rows that repeat a
doc_id are one document to the smaller-id rule, so they do not remove each other's words; each row
is judged by the windows of its own text. A null doc_id has no smaller one and removes nothing; its
words stay. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import Rows, Scratch, made_once, per_worker, rows_of, shuffle_partitions

STEP = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers of the two polynomial hashes
STEP_2 = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class SubstringParams:
    window: int = 50
    gram: int = 10
    block_words: int = 300_000  # words hashed at a time
    remember: int = 500_000  # word hashes a worker remembers
    max_runs: int = 4  # runs that the index holds before it compacts them


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over x[i : i + width], by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


class WordHashes:
    """Two independent 64-bit hashes of every word, remembered by word up to a bound."""

    def __init__(self, remember: int):
        self.remember, self.number = remember, {}
        self.pairs = np.empty((2, 1024), np.uint64)

    def of(self, words: list) -> np.ndarray:
        if len(self.number) > self.remember:
            self.number = {}
        number = self.number
        for word in set(words).difference(number):
            at = number[word] = len(number)
            if at >= self.pairs.shape[1]:
                self.pairs = np.concatenate([self.pairs, np.empty_like(self.pairs)], axis=1)
            both = xxhash.xxh3_128_intdigest(word)
            self.pairs[:, at] = both & 0xFFFFFFFFFFFFFFFF, both >> 64
        return self.pairs[:, np.fromiter(map(number.__getitem__, words), np.int64, len(words))]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * STEP + hashes[j : len(hashes) - n + 1 + j]
    return np.maximum(mixed(out), np.uint64(1))


def windows(hashes: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """Polynomial hash of each n consecutive words, from prefix sums modulo 2^64."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    back = np.uint64(pow(int(step), -1, 2**64))
    powers = np.cumprod(np.full(len(hashes), step))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
    undo = np.cumprod(np.full(len(hashes) - n + 1, back))
    return mixed((sums[n:] - sums[:-n]) * undo)


@dataclass
class Block:
    """Documents laid end to end: gram hashes, which windows are whole, and which grams are chosen."""

    starts: np.ndarray  # first word of each document; one more for the end
    hashes: np.ndarray

    def select(self, params: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram hashes, whole windows, chosen grams), by position."""
        gram, window = grams(self.hashes[0], params.gram), params.window
        n = max(0, len(self.hashes[0]) - window + 1)
        whole = np.zeros(n, bool)
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            whole[a : max(a, b - window + 1)] = True
        wide = window - params.gram + 1
        chosen = np.zeros(len(gram), bool)
        if n:
            least = np.where(whole, sliding(gram, wide, np.minimum), np.uint64(0))
            pad = np.zeros(wide - 1, np.uint64)
            chosen = sliding(np.concatenate([pad, least, pad]), wide, np.maximum) == gram
        return gram, whole, chosen


def blocks(rows: Iterator[tuple], word_hashes: WordHashes, limit: int) -> Iterator[tuple[list[tuple], list[bytes], Block]]:
    """(rows, their words, Block) of about ``limit`` words; the second item of a row is its text."""

    def made() -> tuple[list[tuple], list[bytes], Block]:
        return held, words, Block(np.array(starts), word_hashes.of(words))

    held, words, starts = [], [], [0]
    for row in rows:
        held.append(row)
        words += (row[1] or "").encode().split()
        starts.append(len(words))
        if len(words) >= limit:
            yield made()
            held, words, starts = [], [], [0]
    if held:
        yield made()


def fingerprints(docs: DataFrame, params: SubstringParams) -> DataFrame:
    """(fp, doc_id), each pair once a task at most, of documents with a doc_id."""

    cell = per_worker(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made_once(cell, lambda: WordHashes(params.remember))
        for rows, _, block in blocks(rows_of(batches, "doc_id", "text", at_once=200), known, params.block_words):
            gram, _, chosen = block.select(params)
            at = np.flatnonzero(chosen)
            if len(at) == 0:
                continue
            owner = np.searchsorted(block.starts, at, side="right") - 1
            pairs = np.unique(np.stack([gram[at].view(np.int64), owner]), axis=1)
            ids = np.array([r[0] for r in rows], np.int64)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(ids[pairs[1]])], names=["fp", "doc_id"])

    return docs.where("doc_id is not null").mapInArrow(run, "fp long, doc_id long")


WINDOW = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int32()), ("judged", pa.bool_()), ("row_id", pa.int64()), ("text", pa.string())])
WINDOW_DDL = "h1 long, h2 int, doc_id long, place int, judged boolean, row_id long, text string"


def nominated_windows(texts: DataFrame, params: SubstringParams) -> DataFrame:
    """Windows whose least gram other documents share, and once each text that may lose words.

    ``texts``: row_id, text, doc_id, in_batch, older and newer: fingerprints that a document with a
    smaller or larger id has. A window is judged if a smaller id may have it; else it is a source.
    """

    cell = per_worker(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made_once(cell, lambda: WordHashes(params.remember))
        names = "row_id", "text", "doc_id", "in_batch", "older", "newer"
        wide = params.window - params.gram + 1
        for rows, _, block in blocks(rows_of(batches, *names, at_once=100), known, params.block_words):
            gram, whole, chosen = block.select(params)
            if not whole.any():
                continue
            at = np.flatnonzero(chosen)
            owner = np.searchsorted(block.starts, at, side="right") - 1
            least = sliding(gram, wide, np.minimum)
            nowhere = np.uint64(2**64 - 1)

            def shared(column: int, allowed: np.ndarray) -> np.ndarray:
                """Whole windows whose least gram is in their document's list."""
                listed = [np.array(r[column] or [], np.int64).view(np.uint64) * STEP_2 + np.uint64(i) for i, r in enumerate(rows)]  # noqa: B023
                there = at[np.isin(gram[at] * STEP_2 + owner.astype(np.uint64), np.concatenate(listed))]  # noqa: B023
                found = np.full(len(gram), nowhere)  # noqa: B023
                found[there] = gram[there]  # noqa: B023
                return whole & (sliding(found, wide, np.minimum) == least) & np.repeat(allowed, np.diff(block.starts))[: len(whole)]  # noqa: B023

            every = np.ones(len(rows), bool)
            judged = shared(4, np.array([r[3] for r in rows], bool))
            place = np.flatnonzero(judged | shared(5, every))
            if len(place) == 0:
                continue
            h1, h2 = (windows(h, params.window, s)[place].view(np.int64) for h, s in zip(block.hashes, (STEP, STEP_2), strict=True))
            h2 = (h2 >> 32).astype(np.int32)
            owner = np.searchsorted(block.starts, place, side="right") - 1
            ids, numbers = np.array([r[2] for r in rows], np.int64), np.array([r[0] for r in rows], np.int64)
            n = len(place)
            yield pa.record_batch([pa.array(h1), pa.array(h2), pa.array(ids[owner]), pa.array((place - block.starts[owner]).astype(np.int32)), pa.array(judged[place]), pa.array(numbers[owner]), pa.nulls(n, pa.string())], schema=WINDOW)
            texts_of = Rows(WINDOW)
            for i in np.unique(owner[judged[place]]).tolist():
                if full := texts_of.add((None, None, rows[i][2], None, None, rows[i][0], rows[i][1]), len(rows[i][1])):
                    yield full
            if last := texts_of.flush():
                yield last

    return texts.select("row_id", "text", "doc_id", "in_batch", "older", "newer").mapInArrow(run, WINDOW_DDL)


JUDGED = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
JUDGED_DDL = "row_id long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def judged_rows(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Removes the words under the windows at ``places`` (null: none) and joins the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Rows(JUDGED)
        for row_id, doc_id, text, places in rows_of(batches, "row_id", "doc_id", "text", "places", at_once=200):
            words = (text or "").encode().split()
            n = len(words)
            if places:
                edges = np.zeros(n + 1, np.int64)
                np.add.at(edges, places, 1)
                np.add.at(edges, np.array(places) + window, -1)
                words = [w for w, gone in zip(words, (edges.cumsum()[:n] > 0).tolist(), strict=True) if not gone]
            kept = b" ".join(words)
            row = row_id, doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None
            if full := gathered.add(row, 200 + len(kept) * with_text):
                yield full
        if last := gathered.flush():
            yield last

    return rows.select("row_id", "doc_id", "text", "places").mapInArrow(run, JUDGED_DDL)


class FingerprintLog:
    """The index: sorted runs of (fp, doc_id) on the shared folder, compacted when too many.

    With a ``path`` the runs stay there, and a log opened at the same path, in this session or another,
    goes on from them. A run counts once Spark has committed its folder. Compaction writes the merged run
    before it deletes its parts; a crash between leaves pairs twice, which changes no minimum or maximum.

    Batches should come in doc_id order, as a verdict is final: a document that comes later with a
    smaller id does not take back what an earlier batch decided.
    """

    def __init__(self, spark: SparkSession, params: SubstringParams = SubstringParams(), path: str | None = None):
        self.spark, self.params = spark, params
        self.scratch = Scratch(spark, "substring")
        self.root = path.rstrip("/") if path else self.scratch.path("log")
        self.runs: list[str] = self.committed()

    def committed(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [f.getPath() for f in files.listStatus(root)]
        return sorted(f.toString() for f in found if files.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def pairs(self) -> DataFrame:
        """What the runs hold."""
        return self.spark.read.schema("fp long, doc_id long").parquet(*self.runs)

    def add_run(self, pairs: DataFrame) -> str:
        """Writes a sorted run: range-dealt, so a fingerprint that many documents hold is split over tasks."""
        to = f"{self.root}/run-{uuid.uuid4().hex}"
        ordered = pairs.repartitionByRange(shuffle_partitions(self.spark), "fp", "doc_id").sortWithinPartitions("fp", "doc_id")
        ordered.write.option("compression", "zstd").parquet(to)
        return to

    def compact(self) -> None:
        if len(self.runs) > self.params.max_runs:
            merged = self.add_run(self.pairs().distinct())
            for run in self.runs:
                self.scratch.delete(run)
            self.runs = [merged]

    def ingest(self, batch: DataFrame, history: DataFrame | None = None, with_text: bool = False) -> DataFrame:
        """A row per row of ``batch``: row_id, doc_id, n_words, n_removed, kept_sha256, kept_text.

        ``history`` holds the texts of the earlier batches, which verification reads again.
        """
        plain = lambda df: df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        mine = plain(batch)
        fresh = self.scratch.keep(fingerprints(mine, self.params), "fresh")
        ends = F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
        spread = fresh.groupBy("fp").agg(*ends)
        every = fresh
        if self.runs:
            # of the history only fingerprints that the batch has matter
            met = self.scratch.keep(self.pairs().join(spread.select("fp"), "fp", "left_semi"), "met")
            spread = spread.unionByName(met.groupBy("fp").agg(*ends)).groupBy("fp").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            every = fresh.unionByName(self.scratch.again(met))
        spread = spread.where("low < high")
        spread = self.scratch.keep(spread, "spread")  # a table of its own, so Spark can split a hot fingerprint
        lists = (
            every.join(spread, "fp")
            .groupBy("doc_id")
            .agg(
                F.collect_list(F.when(F.col("low") < F.col("doc_id"), F.col("fp"))).alias("older"),
                F.collect_list(F.when(F.col("high") > F.col("doc_id"), F.col("fp"))).alias("newer"),
            )
        )
        texts = mine.withColumn("in_batch", F.lit(True))
        if history is not None:
            texts = texts.unionByName(plain(history).withColumn("in_batch", F.lit(False)))
        # rows that repeat a doc_id are told apart by their text
        found = texts.join(lists, "doc_id").withColumn("row_id", F.xxhash64("text"))
        nominated = self.scratch.keep(nominated_windows(found, self.params), "windows")
        seen = nominated.where("h1 is not null")
        first = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
        first = self.scratch.keep(first, "first")
        hits = seen.where("judged").join(first, ["h1", "h2"]).where("first < doc_id")
        places = hits.groupBy("doc_id", "row_id").agg(F.collect_set("place").alias("places"))
        losing = nominated.where("text is not null").dropDuplicates(["doc_id", "row_id"]).join(places, ["doc_id", "row_id"])
        cut = self.scratch.keep(judged_rows(losing, self.params.window, with_text), "cut")
        self.scratch.drop(nominated, first, spread)
        self.runs.append(self.add_run(fresh))
        self.scratch.drop(fresh)
        self.compact()
        self.scratch.free_shuffles()
        whole = judged_rows(mine.withColumn("row_id", F.xxhash64("text")).withColumn("places", F.lit(None).cast("array<int>")), self.params.window, with_text)
        mended = cut.select("doc_id", "row_id", *(F.col(c).alias(f"cut_{c}") for c in ("n_removed", "kept_sha256", "kept_text")))
        return whole.join(mended, ["doc_id", "row_id"], "left").select(
            "row_id",
            "doc_id",
            "n_words",
            F.coalesce("cut_n_removed", "n_removed").alias("n_removed"),
            F.coalesce("cut_kept_sha256", "kept_sha256").alias("kept_sha256"),
            F.coalesce("cut_kept_text", "kept_text").alias("kept_text"),
        )


def substring_dedup(spark: SparkSession, docs: DataFrame, batches: int = 2, params: SubstringParams = SubstringParams(), with_text: bool = False) -> DataFrame:
    """Ingests ``docs`` in ``batches`` ranges of doc_id and returns a row per row of ``docs``."""
    log = FingerprintLog(spark, params)
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or [])) if batches > 1 else []
    out, low = None, None
    for high in [*cuts, None]:
        inside = F.lit(True)
        if high is not None:
            inside = (F.col("doc_id") <= high) if low is not None else (F.col("doc_id").isNull() | (F.col("doc_id") <= high))
        if low is not None:
            inside = inside & (F.col("doc_id") > low)
        history = docs.where(F.col("doc_id") <= low) if low is not None else None
        part = log.ingest(docs.where(inside), history, with_text)
        out = part if out is None else out.unionByName(part)
        low = high
    return out
