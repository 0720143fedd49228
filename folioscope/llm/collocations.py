"""Phrase collocations by marginalising counts of the longest windows.

Only one kind of window is ever counted: at each word, that word and the ones that follow it in its
piece, ``longest`` in all, as columns w1, w2, ... that are null past the end of the piece. A phrase
occurs once for each window that it leads, so the count of every shorter phrase is a sum over the
windows that begin with it. Spark's ROLLUP takes those sums level by level; no text is exploded
into phrases of each length. Windows are counted within blocks of texts before they are shuffled,
packed as compressed lines, and dealt by language and all words but the last; a frequent word or
pair thus comes as one line a block and last word. Where they meet, phrases that are rare for
certain are folded into their prefixes, which changes no sum that matters and leaves the ROLLUP few
rows.

Scores are exact: products are 38-digit decimals, which hold while a phrase occurs less than 10^15
times.

Edge cases: null and empty texts have no words, a null language counts as ``und``. Repeated rows
count each time. Equal scores and counts are ordered by phrase, of which a language has each once.
An empty table, or one in which nothing is frequent, gives no rows. A null id matters nothing, and
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import csv
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.byte_words import text_slices, words_of
from folioscope.llm.common import Scratch, rows_of


@dataclass(frozen=True)
class CollocationParams:
    longest: int = 3  # words of the longest phrase
    least: int = 10  # occurrences of a candidate
    inside: int = 50  # per cent of its occurrences that a longer candidate must have to replace a phrase
    top: int = 2000  # rows returned a language
    unknown: str = "und"  # stands for a null language
    gaps: str = " \t"  # between words
    ends: str = ".,;:!?\n\x0b\x0c\r"  # between pieces
    block_bytes: int = 4 << 20  # of text counted at a time
    bucket_bytes: int = 1 << 20  # of text whose windows make a bucket, about
    ranked_rows: int = 50_000  # candidates ranked in one task, about
    fan_in: int = 16  # ranked lists merged at a time


def window_counter(params: CollocationParams, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (lang, text), the windows of each block with their counts, packed by bucket and language.

    A bucket holds all windows that agree in language and all words but the last. Those of one first
    word are dealt to at most the square root of all buckets, side by side, so that a frequent word
    is spread and a rare one stays together.
    """
    longest, block_bytes = params.longest, params.block_bytes
    spread = math.isqrt(buckets)
    is_word, is_end = np.ones(256, bool), np.zeros(256, bool)
    is_word[[ord(c) for c in params.gaps + params.ends]] = False
    is_end[[ord(c) for c in params.ends]] = True

    def hashes(words: pa.Array) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))

    def distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct tuples in order, and how many there are of each."""
        if np.prod([float(s) for s in sizes]) < 2.0**62:
            key = columns[0]
            for column, size in zip(columns[1:], sizes[1:], strict=True):
                key = key * size + column
            key, counts = np.unique(key, return_counts=True)
            parts = []
            for size in reversed(sizes[1:]):
                key, part = np.divmod(key, size)
                parts.append(part)
            return [key, *reversed(parts)], counts
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        first = np.ones(len(order), bool)
        first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        at = np.flatnonzero(first)
        return [c[at] for c in columns], np.diff(at, append=len(order))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        pool = pa.default_memory_pool()
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang_code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names, lang_hash = langs.dictionary.to_pylist(), hashes(langs.dictionary)
            for first, data, bounds in text_slices(batch.column(1), block_bytes):
                words = words_of(data, bounds, is_word)
                if not len(words.code):
                    continue
                piece = np.searchsorted(np.flatnonzero(is_end[data]), words.start)
                joined = (piece[1:] == piece[:-1]) & (words.row[1:] == words.row[:-1])  # with the word before
                led = [words.code + 1]  # 0 pads
                for _ in range(1, longest):
                    after = np.zeros_like(led[-1])
                    after[:-1] = np.where(joined, led[-1][1:], 0)
                    led.append(after)
                size = len(words.vocabulary) + 1
                (lang, *found), counts = distinct([lang_code[first + words.row], *led], [len(names), *[size] * longest])

                word_hash = np.concatenate((np.zeros(1, np.uint64), hashes(words.vocabulary)))
                inner = np.zeros(len(lang), np.uint64)
                for w in found[1:-1]:
                    inner = inner * np.uint64(31) + word_hash[w]
                bucket = (((word_hash[found[0]] ^ lang_hash[lang]) % np.uint64(buckets) + inner % np.uint64(spread)) % np.uint64(buckets)).astype(np.int64)
                group = bucket * len(names) + lang
                order = np.argsort(group, kind="stable")
                group = group[order]
                text = [pc.fill_null(words.vocabulary.take(pa.array(w[order] - 1, mask=w[order] == 0)), "") for w in found]
                lines = pc.binary_join_element_wise(*text, pc.binary_join_element_wise(pa.array(counts[order]).cast(pa.string()), "", "\n"), " ")
                _, offsets, flat = lines.buffers()
                offsets, flat = np.frombuffer(offsets, np.int32)[: len(lines) + 1], memoryview(flat)
                begins = np.flatnonzero(np.diff(group, prepend=-1))
                ends = np.append(begins[1:], len(group))
                for at in range(0, len(begins), 1000):
                    part = slice(at, at + 1000)
                    where, which = np.divmod(group[begins[part]], len(names))
                    packed = [pack(flat[a:b]) for a, b in zip(offsets[begins[part]].tolist(), offsets[ends[part]].tolist(), strict=True)]
                    yield pa.record_batch([pa.array(where), langs.dictionary.take(pa.array(which)), pa.array(packed, pa.binary())], names=["bucket", "lang", "windows"])
                del led, found, counts, bucket, group, order, text, lines, flat, offsets
                pool.release_unused()

    return count


def rare_folder(params: CollocationParams, held_bytes: int = 4 << 20, held_rows: int = 250_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of packed windows sorted by bucket, the sums; what is rare is folded into its prefix.

    A bucket's sums are final, so a phrase below ``least`` passes its count to its prefix, whose sum
    does not change by that. Of a bucket with more than ``held_rows`` distinct windows partial sums
    go on as they are, unfolded, and meet in the ROLLUP.
    """
    longest, least = params.longest, params.least
    led = [f"w{i + 1}" for i in range(longest)]

    def unpacked(rows: list[tuple[str, bytes]]) -> pa.Table:
        by_lang: dict[str, list[bytes]] = {}
        for lang, lines in rows:
            by_lang.setdefault(lang, []).append(lines)
        tables = []
        for lang, lines in by_lang.items():
            data = b"".join(lines)
            table = csv.read_csv(
                pa.BufferReader(data),
                csv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=[*led, "times"]),
                csv.ParseOptions(delimiter=" ", quote_char=False, double_quote=False),
                csv.ConvertOptions(check_utf8=False, null_values=[""], strings_can_be_null=True, column_types={w: pa.string() for w in led} | {"times": pa.int64()}),
            )
            tables.append(table.add_column(0, "lang", pa.repeat(pa.scalar(lang, pa.string()), len(table))))
        return pa.concat_tables(tables)

    def summed(rows: pa.Table, keys: list[str], *sums: str) -> pa.Table:
        out = rows.group_by(keys, use_threads=False).aggregate([(s, "sum") for s in sums])
        return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*keys, *sums])

    def shaped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [rows.column(c) if c in rows.column_names else pa.nulls(len(rows), pa.string()) for c in ("lang", *led)]
        yield from pa.table([*columns, rows.column("times")], names=["lang", *led, "times"]).to_batches(max_chunksize=50_000)

    def folded(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        level = summed(rows, ["lang", *led], "times")
        level = level.append_column("sent", pa.array(np.zeros(len(level), np.int64)))
        for n in range(longest, 0, -1):
            stays = pc.is_valid(level.column(led[n - 1]))
            if n > 1:
                stays = pc.and_(stays, pc.greater_equal(level.column("times"), least))
            rest = pc.subtract(level.column("times"), level.column("sent"))
            out = level.select(["lang", *led[:n]]).append_column("times", rest)
            yield from shaped(out.filter(pc.and_(stays, pc.greater(rest, 0))))
            if n > 1:
                level = level.set_column(level.column_names.index("sent"), "sent", pc.if_else(stays, level.column("times"), level.column("sent")))
                level = summed(level, ["lang", *led[: n - 1]], "times", "sent")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        ready: list[tuple[str, bytes]] = []  # of whole buckets
        ready_bytes = 0
        for _, rows in groupby(rows_of(batches, "bucket", "lang", "windows", at_once=100), itemgetter(0)):
            held, size, part, unfolded = [], 0, None, False
            for _, lang, packed in rows:
                held.append((lang, unpack(packed)))
                size += len(held[-1][1])
                if size >= held_bytes:
                    part = summed(pa.concat_tables([unpacked(held), *([part] if part else [])]), ["lang", *led], "times")
                    held, size = [], 0
                    if len(part) >= held_rows:
                        yield from shaped(part)
                        part, unfolded = None, True
            if part is not None or unfolded:
                tables = ([unpacked(held)] if held else []) + ([part] if part is not None else [])
                if tables:
                    yield from (shaped if unfolded else folded)(pa.concat_tables(tables))
            else:
                ready += held
                ready_bytes += size
                if ready_bytes >= held_bytes:
                    yield from folded(unpacked(ready))
                    ready, ready_bytes = [], 0
        if ready:
            yield from folded(unpacked(ready))

    return fold


def phrase_counts(docs: DataFrame, params: CollocationParams, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, f) of all phrases that occur ``least`` times, and for each language words = 0 with the number of all its words."""
    led = [f"w{i + 1}" for i in range(params.longest)]
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(params.unknown)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // params.bucket_bytes))
    # neighbouring buckets go together, as they share first words
    together = max(1, math.isqrt(buckets) // 8)
    packed = texts.mapInArrow(window_counter(params, buckets), "bucket long, lang string, windows binary")
    dealt = packed.repartition(F.floor(F.col("bucket") / together)).sortWithinPartitions("bucket")
    windows = dealt.mapInArrow(rare_folder(params), f"lang string, {', '.join(f'{w} string' for w in led)}, times long")
    words = ", ".join(led)
    rolled = docs.sparkSession.sql(f"SELECT lang, {words}, grouping_id() AS level, sum(times) AS f FROM {{windows}} GROUP BY lang, ROLLUP({words})", windows=windows)
    n = F.lit(params.longest) - F.bit_count("level")  # grouping_id has a bit for each column that is rolled up
    last = F.coalesce(*(F.when(n == i + 1, F.col(w)) for i, w in enumerate(led)))
    rolled = rolled.where((n == 0) | (last.isNotNull() & (F.col("f") >= params.least)))
    return rolled.select("lang", F.concat_ws(" ", *led).alias("phrase"), n.cast("int").alias("words"), "f")


def wide(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def scored(phrases: DataFrame, params: CollocationParams) -> DataFrame:
    """Candidates with the cut that scores least."""
    part = lambda words, first, n: F.array_join(F.slice(words, first, n), " ")
    cuts = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("list"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part("list", F.lit(1), F.col("k")).alias("left"), part("list", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = phrases.where("words >= 1")
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side])
    cuts = cuts.withColumn("product", wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn("parts", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("product div parts"))
    least = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): of phrases inside longer candidates, the most that one of those occurs."""
    long = phrases.where("words >= 3").select("lang", "words", "f", F.split("phrase", " ").alias("list"))
    long = long.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)))
    return long.select("lang", F.array_join(F.slice("list", F.col("first"), F.col("n")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def best_of_each(candidates: DataFrame, rows: int, params: CollocationParams) -> DataFrame:
    """The first ``top`` of each language: lists of bounded size are ranked by many tasks, then merged, some at a time."""
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    parts = max(1, -(-rows // params.ranked_rows))
    lists = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int"))
    while parts > 1:
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= params.top)
        parts = -(-parts // params.fan_in)
        lists = lists.withColumn("part", F.floor(F.col("part") / params.fan_in).cast("int"))
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= params.top)


def collocations(spark: SparkSession, docs: DataFrame, params: CollocationParams = CollocationParams(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` collocations."""
    scratch = Scratch(spark, "collocations")
    phrases = scratch.keep(phrase_counts(docs, params, text_col, lang_col), "phrases")
    kept = scored(phrases, params).join(contained(phrases), ["lang", "phrase"], "left")
    kept = scratch.keep(kept.where(F.col("longer").isNull() | (100 * F.col("longer") < params.inside * F.col("a"))).drop("longer"), "candidates")
    first = best_of_each(kept, kept.count(), params)
    sizes = phrases.where("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
