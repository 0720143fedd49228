"""Best-fit packing of token sequences.

Documents become pieces of at most ``capacity`` tokens; best-fit decreasing then depends only on how
many pieces have each length, so the fit runs over that histogram (``capacity`` rows at most) with a
segment tree over remaining capacities. Bins in the same state are handled as one range of ids: a
step fills as many equal bins with as many equal pieces as one-at-a-time best fit would. The result
is a plan of rank ranges; every piece finds its bin from its rank among the pieces of its length.
Ranks are dealt out by hash chunk, so no length, however common, is numbered in one task.

Edge cases: a null or empty text is the one end token. A document of more than ``capacity`` tokens
is cut into full pieces, the last may be shorter. Repeated rows are packed once each. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Remembered, Scratch, made_once, per_worker, shuffle_partitions, text_blocks


@dataclass(frozen=True)
class PackingParams:
    tokenizer: str  # path of a tokenizers file
    capacity: int = 2048
    end_id: int = 0
    remember: int = 400_000  # encoded words in a generation of a worker's cache
    remember_pieces: int = 400_000
    block_chars: int = 4 << 20  # characters of the documents encoded together


class CapacityTree:
    """A segment tree over remaining capacities: the smallest one >= x that an open bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.size
        self.filled[i] = there
        while i > 1:
            i //= 2
            self.filled[i] = self.filled[2 * i] or self.filled[2 * i + 1]

    def at_least(self, x: int) -> int | None:
        i = x + self.size
        if self.filled[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.filled[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.filled[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces.

    Rows (length, first rank, end rank, first bin, pieces a bin, offset): the piece of rank r goes
    to bin first_bin + (r - first) // a_bin, at offset + (r - first) % a_bin * length.
    """
    plan, tree, bins = [], CapacityTree(capacity), 0
    free: dict[int, list[list[int]]] = {}  # remaining capacity -> ranges [first bin, number]

    def put(rest: int, first: int, n: int) -> None:
        if rest:
            free.setdefault(rest, []).append([first, n])
            tree.set(rest, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            rest = tree.at_least(length)
            if rest is None:
                rest, per = capacity, capacity // length
                span = [bins, -(-left // per)]
                bins += span[1]
            else:
                span, per = free[rest].pop(), rest // length
                if not free[rest]:
                    del free[rest]
                    tree.set(rest, False)
            whole = min(span[1], left // per)
            if whole:
                plan.append((length, rank, rank + whole * per, span[0], per, capacity - rest))
                put(rest - per * length, span[0], whole)
                rank, left, span = rank + whole * per, left - whole * per, [span[0] + whole, span[1] - whole]
            if left and span[1]:  # fewer pieces are left than fill one bin
                plan.append((length, rank, rank + left, span[0], left, capacity - rest))
                put(rest - left * length, span[0], 1)
                span, left = [span[0] + 1, span[1] - 1], 0
            if span[1]:
                put(rest, *span)
    return plan


class WordEncoder:
    """Ids of whole texts by the tokenizer, which sees every distinct word once.

    The tokenizer drops white space and no token spans it, so a text's ids are its words' ids. Words
    of plain Latin letters are cut further by the tokenizer's own pattern after lower-casing; new
    pieces are then encoded many at a time. Other words go to the tokenizer as they are, and so does,
    whole, a text that quotes one of the tokenizer's added tokens, as these may stand inside words.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"  # fixed: that of the tokenizer file
    PLAIN = r"[\x21-\x7e\xa1-\xff]+"  # here lower-casing is by character and NFC changes nothing

    def __init__(self, path: str, remember: int, remember_pieces: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut, self.plain = regex.compile(self.PATTERN).findall, regex.compile(self.PLAIN).fullmatch
        self.known, self.pieces = Remembered(remember), Remembered(remember_pieces or remember)

    def learn_pieces(self, pieces: list[str]) -> None:
        for start in range(0, len(pieces), 20_000):
            part = pieces[start : start + 20_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, words = np.array(found.ids, "<u4"), np.array(found.word_ids, np.int64)
            at = np.searchsorted(words, np.arange(len(part) + 1))
            if len(words) == 0 or words[-1] != len(part) - 1:
                raise ValueError("the tokenizer cuts words otherwise than its pattern")
            at, ids = (at * 4).tolist(), ids.tobytes()
            self.pieces.now.update((p, ids[a:b]) for p, a, b in zip(part, at, at[1:], strict=False))

    def words(self, text: str) -> list[str]:
        """White-space separated words; the four separators that only Python calls white space stay in them."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return text.split()

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        whole = {n: self.encoded(t) for n, t in enumerate(texts) if any(a in t for a in self.added)}
        cut = [[] if n in whole else self.words(t) for n, t in enumerate(texts)]
        new = self.known.missing(chain.from_iterable(cut))
        known = self.known.now
        one, more, other = self.in_pieces(new)
        self.learn_pieces(self.pieces.missing(chain(one.values(), chain.from_iterable(more.values()))))
        piece = self.pieces.now.__getitem__
        known.update(zip(one, map(piece, one.values()), strict=True))
        for word, pieces in more.items():
            known[word] = piece(pieces[0]) + piece(pieces[1]) if len(pieces) == 2 else b"".join(map(piece, pieces))
        for word in other:
            known[word] = self.encoded(word)
        return [whole[n] if n in whole else b"".join(map(known.__getitem__, words)) for n, words in enumerate(cut)]

    def in_pieces(self, words: list[str]) -> tuple[dict[str, str], dict[str, tuple[str, ...]], list[str]]:
        """Plain words that are one piece, those of several pieces, and the words that are not plain.

        A run of letters, and one before a mark, need no pattern.
        """
        one, more, other = {}, {}, []
        for word in words:
            if not (word.isascii() and word.isprintable()) and not self.plain(word):
                other.append(word)
            elif word.isalpha():
                one[word] = word.lower()
            elif word[-1:] in ".,;:!?" and (head := word[:-1]).isalpha():
                more[word] = head.lower(), word[-1]
            else:
                more[word] = self.cut(word.lower())
        return one, more, other

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, params: PackingParams) -> DataFrame:
    cell = per_worker(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = made_once(cell, lambda: WordEncoder(params.tokenizer, params.remember, params.remember_pieces)), 4 * params.capacity
        end = np.array([params.end_id], "<u4").tobytes()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        for block in text_blocks(batches, params.block_chars):
            rows = []
            for (doc_id, _), ids in zip(block, encoder.encode_block([t for _, t in block]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield out(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def with_bins(ranked: DataFrame, plan: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Looks each piece's (length, rank) up in the plan, which is bounded by the capacity alone."""
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, _, bins, per, offsets = table.T
        keys = (lengths << 44) + firsts  # fewer than 2^44 pieces of a length
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            n = rank - firsts[at]
            given = batch.drop_columns(["rank"])
            yield pa.record_batch([*given.columns, pa.array(bins[at] + n // per[at]), pa.array(offsets[at] + n % per[at] * length)], names=[*given.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECE}, sequence_id long, offset long")


def best_fit_packing(spark: SparkSession, docs: DataFrame, params: PackingParams) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    chunks = 4 * shuffle_partitions(spark)
    chunk = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int")
    pieces = scratch.keep(token_pieces(docs, params).withColumn("chunk", chunk), "pieces")
    counted = scratch.keep(pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(histogram, params.capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("length", "chunk", before.alias("before"))
    order = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("n", F.row_number().over(order)).join(starts, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("n") - 1).alias("rank"))
    return with_bins(ranked, plan)
