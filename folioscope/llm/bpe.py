"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task treats a block of documents as one corpus: the pattern cuts the texts into pieces, and the
pieces not yet known are laid out one after another as symbols. An inverted index from
merge rank to positions then applies merges in rank order over the whole block; a merge touches only
its two neighbours, whose new pairs enter the index. Ids come from the ranks; known pieces are
remembered by the worker within a bound, so a piece is not replayed once per occurrence. Blocks
need nothing from each other, so the job is one pass without a shuffle and loses nothing when
executors do.

The order is the usual one of byte-pair encoders: in a piece always the lowest rank, and of equal
ranks the leftmost. A merge may bring up a rank below the current one; the rest of the current
positions then waits.

Edge cases: a null or empty text has no tokens. Every byte is in the rank file, so any text encodes,
and decoding the ids gives the text's UTF-8 bytes. Rows that repeat are encoded alike. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Remembered, Rows, made_once, per_worker, rows_of, text_blocks


@dataclass(frozen=True)
class BpeParams:
    rank_file: str
    pattern: str
    block_chars: int = 4 << 20  # characters of a block of documents
    remember: int = 400_000  # pieces in a generation of a worker's cache


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@dataclass
class Merges:
    """Pairs of ids that merge, as left << 32 | right -> rank, and the ranks of byte pairs."""

    ranks: dict[bytes, int]

    def __post_init__(self) -> None:
        ranks = self.ranks
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])


def replay_merges(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """Every piece's ids as little-endian unsigned 32-bit integers, all merged together in rank order."""
    if not pieces:
        return []
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    n = len(text)
    pair_ranks = np.full(n, -1)
    pair_ranks[:-1] = merges.byte_pairs[text[:-1], text[1:]]
    last = np.zeros(n, bool)
    last[ends - 1] = True
    pair_ranks[last] = -1
    following = np.where(last, -1, np.arange(1, n + 1)).tolist()
    before = np.arange(-1, n - 1)
    before[np.concatenate([[0], ends[:-1]])] = -1
    before = before.tolist()
    # the inverted index: rank -> positions whose pair merges at it
    order = np.argsort(pair_ranks, kind="stable")
    order = order[np.searchsorted(pair_ranks[order], 0) :]
    present, starts = np.unique(pair_ranks[order], return_index=True)
    index = {rank: part.tolist() for rank, part in zip(present.tolist(), np.split(order, starts[1:]), strict=True)} if len(order) else {}
    queue = list(index)
    heapq.heapify(queue)
    symbols, pair_ranks, pairs = merges.bytes[text].tolist(), pair_ranks.tolist(), merges.pairs.get
    while queue:
        rank = heapq.heappop(queue)
        if (positions := index.pop(rank, None)) is None:
            continue
        positions.sort()
        for done, at in enumerate(positions):
            if pair_ranks[at] != rank:
                continue  # an earlier merge took one of the two
            right = following[at]
            after = following[at] = following[right]
            symbols[at], symbols[right] = rank, -1
            pair_ranks[right] = -1
            lowest = rank + 1
            if after >= 0:
                before[after] = at
                new = pair_ranks[at] = pairs(rank << 32 | symbols[after], -1)
                if new >= 0:
                    lowest = min(lowest, new)
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heapq.heappush(queue, new)
            else:
                pair_ranks[at] = -1
            first = before[at]
            if first >= 0:
                new = pair_ranks[first] = pairs(symbols[first] << 32 | rank, -1)
                if new >= 0:
                    lowest = min(lowest, new)
                    if new in index:
                        index[new].append(first)
                    else:
                        index[new] = [first]
                        heapq.heappush(queue, new)
            if lowest <= rank and done + 1 < len(positions):
                index.setdefault(rank, []).extend(positions[done + 1 :])
                heapq.heappush(queue, rank)
                break
    found = np.array(symbols)
    alive = found >= 0
    to = np.concatenate([[0], np.cumsum(alive)[ends - 1]]) * 4
    ids = found[alive].astype("<u4").tobytes()
    return [ids[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


class Encoder:
    def __init__(self, params: BpeParams):
        self.ranks = read_ranks(params.rank_file)
        self.merges = Merges(self.ranks)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.cut = regex.compile(params.pattern).findall
        self.known = Remembered(params.remember)

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, per text."""
        cut = [self.cut(t) for t in texts]
        known, new = self.known, []
        for piece in known.missing(chain.from_iterable(cut)):
            body = piece.encode()
            if body in self.ranks:  # a piece that is a token whole stays one
                known.now[piece] = np.array([self.ranks[body]], "<u4").tobytes()
            else:
                new.append((piece, body))
        known.now.update(zip([p for p, _ in new], replay_merges([b for _, b in new], self.merges), strict=True))
        return [b"".join(map(known.now.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded_blocks(batches: Iterator[pa.RecordBatch], encoder: Encoder, block_chars: int) -> Iterator[tuple[int, bytes]]:
    for block in text_blocks(batches, block_chars):
        yield from zip((i for i, _ in block), encoder.encode_block([t for _, t in block]), strict=True)


def encode(docs: DataFrame, params: BpeParams) -> DataFrame:
    """doc_id and the ids of its whole text, as array<int>."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    cell = per_worker(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Rows(schema)
        for doc_id, ids in encoded_blocks(batches, made_once(cell, lambda: Encoder(params)), params.block_chars):
            if full := gathered.add((doc_id, np.frombuffer(ids, "<i4")), len(ids) + 16):
                yield full
        if last := gathered.flush():
            yield last

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, params: BpeParams) -> DataFrame:
    """doc_id and the decoded bytes; null ids decode to null."""
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(params.rank_file).items()}
        gathered = Rows(schema)
        for doc_id, ids in rows_of(batches, "doc_id", "ids", at_once=50):
            body = None if ids is None else b"".join(map(tokens.__getitem__, ids))
            if full := gathered.add((doc_id, body), len(body or b"") + 16):
                yield full
        if last := gathered.flush():
            yield last

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, body binary")


def round_trip(docs: DataFrame, params: BpeParams) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes, then decodes the ids, in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    cell = per_worker(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, gathered = made_once(cell, lambda: Encoder(params)), Rows(schema, 1 << 20)
        for doc_id, ids in encoded_blocks(batches, encoder, params.block_chars):
            if full := gathered.add((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()), 200):
                yield full
        if last := gathered.flush():
            yield last

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
