"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Words are lower-cased runs of letters, digits and underscores; a k-mer is 5 consecutive words,
labelled with its occurrence number in the text. A sketch takes the 4 k-mers that are least under
its hash and keeps them in text order, so it agrees when content and order agree, as edit similarity
asks. Documents meet in the buckets of 8 sketches. A pair is linked when the word edit
distance, by a bit-parallel alignment inside the band that 0.8 allows, is at most 0.2 of the longer
text. One word in five changed leaves few runs of 5 words, so 32 loose sketches of 2 k-mers of 2 words
stand beside: they carry the recall down to the link threshold. Candidates are the pairs that share two
of all 40, as texts within the threshold do and long texts of one language seldom. Texts of up to 14 words with few edits
are found without chance: two of them are within e edits only if leaving out at most e words of each
gives one sequence, and every such sequence is a key.

Copies (equal word sequences) are one class before anything else. In a bucket every text is compared
with the bucket's least document only, so a group of n near copies costs n - 1 alignments; the star
of links is closed to components. Where a bucket still holds several components, its documents are
compared by their bags of words, counted in 256 cells: two texts share no more words than their cells
do. Only pairs of different components that these leave possible are aligned: first every document with
the one most like it, then, once the components have grown, those that remain. So no link between
different texts is lost, no group's pairs are emitted, and texts are joined to listed pairs alone.

A bucket over ``tile`` documents, as of a passage that many texts hold, is not compared pair by pair
but dealt out anew by what its documents do not share: see ``rare_runs``, which loses nothing.

Skew: buckets are grouped with partial aggregation, and the joins back to their members and texts
are sort-merge joins of which Spark splits the skewed side.

Edge cases: texts of 1 to 4 words have one k-mer, all their words. Null, empty and wordless texts
are a class of their own each. Rows that repeat a doc_id are one node: what links one links all. A
null doc_id has a null class and stays. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import Rows, Scratch, made_once, per_worker, rows_of
from folioscope.llm.components import components
from folioscope.llm.substring_dedup import STEP, WordHashes, grams, mixed

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class OrderMinHashParams:
    k: int = 5
    kept: int = 4  # k-mers in a sketch
    sketches: int = 8
    loose_k: int = 2
    loose_kept: int = 2
    loose_sketches: int = 32
    agreeing: int = 2  # sketches that the texts of a candidate pair share
    short_words: int = 14  # texts up to this length also meet by what a few words left out leave
    most_left_out: int = 128  # such sequences of a text; a text with more has none
    similarity: float = 0.8
    seed: int = 20
    remember: int = 400_000  # word hashes a worker remembers
    block_words: int = 200_000  # words hashed at a time
    tile: int = 2048  # documents whose sketches and bags of words are compared in one task at once
    block: int = 256  # documents of a block, where texts are aligned; two blocks meet in a task


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def occurrences(kmers: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.empty(len(kmers), np.uint64)
    out[order] = np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))
    return out


def least_places(values: np.ndarray, kept: int) -> np.ndarray:
    """The places of the least ``kept`` values of each row, in order of place; overwrites ``values``."""
    rows = np.arange(len(values))
    out = np.empty((len(values), kept), np.int64)
    for n in range(kept):
        out[:, n] = values.argmin(axis=1)
        values[rows, out[:, n]] = np.uint64(2**64 - 1)
    return np.sort(out, axis=1)


#: Made once a task. A plain dict, as functools' caches pickle by name and workers may lack the package.
families: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    if (count, seed) not in families:
        rng = np.random.default_rng(seed)
        masks = rng.integers(0, 2**63, count, np.uint64)
        families[count, seed] = masks, rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    return families[count, seed]


def sketches_of(hashes: np.ndarray, k: int, most: int, count: int, seed: int) -> np.ndarray:
    """``count`` sketches of ``most`` k-mers each."""
    masks, odd = hash_family(count, seed)
    kmers = grams(hashes, min(k, len(hashes)))
    labelled = mixed(kmers + occurrences(kmers) * STEP)
    n, kept = len(kmers), min(most, len(kmers))
    out = np.empty(count, np.uint64)
    at_once = max(1, (1 << 20) // n)
    for start in range(0, count, at_once):
        part = slice(start, start + at_once)
        values = (labelled[None, :] ^ masks[part, None]) * odd[part, None]
        at = least_places(values, kept) if kept < n else np.broadcast_to(np.arange(n), values.shape)
        sketch = np.zeros(len(values), np.uint64)
        for column in kmers[at].T:
            sketch = sketch * STEP + column
        out[part] = mixed(sketch)
    return out


def order_sketches(hashes: np.ndarray, params: OrderMinHashParams) -> np.ndarray:
    """The sketches of one text, from its word hashes (at least one)."""
    return sketches_of(hashes, params.k, params.kept, params.sketches, params.seed)


def left_out(hashes: np.ndarray, params: OrderMinHashParams) -> np.ndarray:
    """Keys of the sequences that a short text leaves when up to its allowed edits of words are left out."""
    n = len(hashes)
    edits = allowed_edits(n, n, params.similarity)
    if n > params.short_words or sum(comb(n, e) for e in range(edits + 1)) > params.most_left_out:
        return np.empty(0, np.uint64)
    found = []
    for size in range(max(1, n - edits), n + 1):
        rows = hashes[np.array(list(combinations(range(n), size)))]
        key = np.full(len(rows), size, np.uint64)
        for column in rows.T:
            key = key * STEP + column
        found.append(mixed(key))
    return np.unique(np.concatenate(found))


def text_sketches(hashes: np.ndarray, params: OrderMinHashParams) -> np.ndarray:
    """Those of 5 words, the loose ones, and, from place sketches + loose_sketches on, what short texts leave."""
    loose = sketches_of(hashes, params.loose_k, params.loose_kept, params.loose_sketches, params.seed + 1)
    return np.concatenate([order_sketches(hashes, params), loose, left_out(hashes, params)])


CELLS = 256


def signature_of(sketches: np.ndarray) -> bytes:
    """Sixteen bits of every sketch but the keys of short texts; equal sketches have equal bits."""
    return (sketches >> np.uint64(48)).astype(np.uint16).tobytes()


def bag_of(hashes: np.ndarray) -> bytes:
    """How many words fall in each cell; empty where a byte does not hold a count."""
    counts = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_alike(n: np.ndarray, bags: np.ndarray, others: np.ndarray, their_bags: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which texts could be linked with those of the other side, and words in common; a bag of zeros says nothing."""
    longer = np.maximum(others, n)
    limit = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    shared = np.minimum(bags, their_bags).sum(axis=1, dtype=np.int64)
    return (longer - np.minimum(others, n) <= limit) & ((shared >= longer - limit) | ~bags.any(axis=1) | ~their_bags.any(axis=1)), shared


def agree(signatures: np.ndarray, others: np.ndarray, n: np.ndarray, lengths: np.ndarray, params: OrderMinHashParams) -> np.ndarray:
    """Which texts share ``agreeing`` sketches with those of the other side; short texts met by a key without chance."""
    return ((others == signatures).sum(axis=1) >= params.agreeing) | ((lengths <= params.short_words) & (n <= params.short_words))


def signature_rows(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(len(signatures), -1)


def bag_rows(bags: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(b or bytes(CELLS) for b in bags), np.uint8).reshape(-1, CELLS)


KEYS = "doc_id long, c1 long, c2 long, n_words int, bag binary, signature binary, sketches array<long>"


def text_keys(docs: DataFrame, params: OrderMinHashParams) -> DataFrame:
    """A row per document with words: the 128-bit key of its word sequence and its sketches."""

    cell = per_worker(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made_once(cell, lambda: WordHashes(params.remember))

        def out() -> pa.RecordBatch:
            hashes = known.of(words)
            rows = []
            for doc_id, a, b in zip(ids, starts, starts[1:], strict=False):
                mine = hashes[:, a:b]
                powers = np.cumprod(np.full(b - a, STEP))
                c1, c2 = (int(mixed((h * powers).sum(keepdims=True) + np.uint64(b - a)).view(np.int64)[0]) for h in mine)
                sketches = text_sketches(mine[0], params)
                rows.append((doc_id, c1, c2, b - a, bag_of(mine[0]), signature_of(sketches[: params.sketches + params.loose_sketches]), sketches.view(np.int64)))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "c1", "c2", "n_words", "bag", "signature", "sketches"])

        ids, words, starts = [], [], [0]
        for doc_id, text in rows_of(batches, "doc_id", "text", at_once=200):
            if mine := words_of(text):
                ids.append(doc_id)
                words += mine
                starts.append(len(words))
            if len(words) >= params.block_words:
                yield out()
                ids, words, starts = [], [], [0]
        if ids:
            yield out()

    return docs.where("doc_id is not null").mapInArrow(run, KEYS)


def allowed_edits(a: int, b: int, similarity: float) -> int:
    return int((1 - similarity) * max(a, b) + 1e-9)


def banded_distance(long: list, short: list, limit: int) -> int:
    """Edit distance of two sequences, the first not shorter; limit + 1 if it is over ``limit``.

    Hyyrö's bit-parallel recurrence, kept to the diagonals within ``limit`` of the main one: the
    vectors of vertical differences are integers as wide as the band, which slides down one row a step.
    """
    a = b = 0
    while b < len(short) and long[b] == short[b]:
        b += 1
    long, short = long[b:], short[b:]
    while a < len(short) and long[-1 - a] == short[-1 - a]:
        a += 1
    if a:
        long, short = long[:-a], short[:-a]
    n, m = len(long), len(short)
    if n - m > limit:
        return limit + 1
    if not m:
        return n
    limit = min(limit, n)
    places: dict = {}
    for i, x in enumerate(long):
        places.setdefault(x, []).append(i)
    masks = {}
    for x in set(short):
        if x in places:
            bits = bytearray(n // 8 + 1)
            for i in places[x]:
                bits[i >> 3] |= 1 << (i & 7)
            masks[x] = int.from_bytes(bits, "little")
    width = 2 * limit + 2
    full = (1 << width) - 1
    up, down = (full << (width - limit - 1)) & full, 0  # vertical +1 and -1
    distance, shift = limit, limit + 1 - width
    diagonal, horizontal = 1 << (width - 1), 1 << (width - 2)
    most = limit + m - (n - limit)
    for i, x in enumerate(short):
        match = masks.get(x, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        plus = (down | ~(zero | up)) & full
        minus = zero & up
        if i < n - limit:
            distance += not zero & diagonal
        else:
            distance += bool(plus & horizontal) - bool(minus & horizontal)
            horizontal >>= 1
        if distance > most:
            return limit + 1
        zero >>= 1
        up, down = (minus | ~(zero | plus)) & full, zero & plus
        shift += 1
    return distance if distance <= limit else limit + 1


def alike(a: list[str], b: list[str], similarity: float) -> bool:
    if len(a) < len(b):
        a, b = b, a
    limit = allowed_edits(len(a), len(b), similarity)
    return len(a) - len(b) <= limit and banded_distance(a, b, limit) <= limit


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verified(pairs: DataFrame, params: OrderMinHashParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, last, words = Rows(LINKS, 1 << 20), None, []
        for a, b, text_a, text_b in rows_of(batches, "a", "b", "text_a", "text_b", at_once=50):
            if (b, text_b) != last:
                last, words = (b, text_b), words_of(text_b)
            if alike(words_of(text_a), words, params.similarity) and (full := gathered.add((a, b), 16)):
                yield full
        if rest := gathered.flush():
            yield rest

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def with_texts(pairs: DataFrame, texts: DataFrame, scratch: Scratch, params: OrderMinHashParams) -> DataFrame:
    """The pairs (a, b) that alignment links; texts are joined to the listed pairs alone."""
    left, right = (scratch.again(texts).select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return verified(scratch.again(pairs).join(left, "a").join(right, "b"), params)


def promising_pairs(pairs: DataFrame, bags: DataFrame, again: DataFrame, params: OrderMinHashParams) -> DataFrame:
    """The pairs whose sketches, lengths and bags of words leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            (bag_a, bag_b), (sign_a, sign_b) = ((read(batch.column(f"{c}_{end}").to_pylist()) for end in "ab") for c, read in (("bag", bag_rows), ("signature", signature_rows)))
            may = agree(sign_a, sign_b, n_a, n_b, params) & may_be_alike(n_a, bag_a, n_b, bag_b, params.similarity)[0]
            yield batch.select(["a", "b"]).filter(pa.array(may))

    left, right = (t.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{y}_{c}") for x, y in (("n_words", "n"), ("bag", "bag"), ("signature", "signature")))) for t, c in ((bags, "a"), (again, "b")))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long").distinct()


def likely_pairs(rows: pa.Table, numbers: np.ndarray, params: OrderMinHashParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of equal (sorted) numbers and different components that sketches and bags leave likely, and words in common."""
    n, component, block = (rows.column(c).to_numpy() for c in ("n_words", "component", "block"))
    bags, signatures = bag_rows(rows.column("bag").to_pylist()), signature_rows(rows.column("signature").to_pylist())
    across = rows.column("low").to_numpy() != rows.column("high").to_numpy()  # two blocks: only pairs between them
    found = [[], [], []]
    step, i = 0, np.arange(len(n))
    while True:
        step += 1
        i = i[i + step < len(n)]
        i = i[numbers[i + step] == numbers[i]]
        if len(i) == 0:
            break
        x = i[(component[i] != component[i + step]) & (~across[i] | (block[i] != block[i + step]))]
        x = x[agree(signatures[x], signatures[x + step], n[x], n[x + step], params)]
        y = x + step
        may, shared = may_be_alike(n[x], bags[x], n[y], bags[y], params.similarity)
        for to, what in zip(found, (x[may], y[may], shared[may]), strict=True):
            to.append(what)
    return tuple(np.concatenate(what) if what else np.empty(0, np.int64) for what in found)


def open_documents(rows: pa.Table, numbers: np.ndarray, params: OrderMinHashParams) -> Iterator[pa.RecordBatch]:
    """(doc_id, nearest) of the likely pair with most words in common of each document, and (doc_id, star) that
    ties the documents with a likely pair to the first of them in their bucket."""
    ids = rows.column("doc_id").to_numpy()
    x, y, shared = likely_pairs(rows, numbers, params)
    if len(x) == 0:
        return
    x, y, shared = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([shared, shared])
    order = np.lexsort((ids[y], -shared, ids[x]))
    best = order[np.concatenate([[True], np.diff(ids[x[order]]) != 0])]
    yield pa.record_batch([pa.array(ids[x[best]]), pa.array(ids[y[best]]), pa.nulls(len(best), pa.int64())], names=["doc_id", "nearest", "star"])
    at = np.unique(x)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(numbers[at]) != 0]))
    star = np.repeat(ids[at[starts]], np.diff(np.append(starts, len(at))))
    yield pa.record_batch([pa.array(ids[at]), pa.nulls(len(at), pa.int64()), pa.array(star)], names=["doc_id", "nearest", "star"])


def linked_in_tile(rows: pa.Table, numbers: np.ndarray, params: OrderMinHashParams) -> Iterator[pa.RecordBatch]:
    """Links of whole tiles, as many as join the components that belong together; the likeliest pairs come first."""
    ids, component = rows.column("doc_id").to_numpy(), rows.column("component").to_numpy()
    x, y, shared = likely_pairs(rows, numbers, params)
    words = [words_of(t) for t in rows.column("text").to_pylist()]
    bags = [Counter(w) for w in words]
    root: dict[int, int] = {}

    def of(c: int) -> int:
        while (up := root.get(c, c)) != c:
            c = up
        return c

    found = []
    for i in np.argsort(-shared, kind="stable"):
        a, b = int(x[i]), int(y[i])
        p, q = of(int(component[a])), of(int(component[b]))
        if p != q and share_enough(bags[a], bags[b], max(len(words[a]), len(words[b])), params) and alike(words[a], words[b], params.similarity):
            found.append((int(ids[a]), int(ids[b])))
            root[max(p, q)] = min(p, q)
    if found:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def in_whole_tiles(tiles: DataFrame, keys: list[str], made, schema: str, params: OrderMinHashParams, rows_at_once: int) -> DataFrame:
    """``made`` of sorted whole tiles, a bounded number of rows at a time."""

    def numbers_of(rows: pa.Table) -> np.ndarray:
        found = [rows.column(c).to_numpy() for c in keys]
        return np.concatenate([[0], np.cumsum(np.any([k[1:] != k[:-1] for k in found], axis=0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                part = pa.Table.from_batches([batch.slice(start, rows_at_once)])
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows < rows_at_once:
                    continue
                numbers = numbers_of(held)
                if whole := int(np.searchsorted(numbers, numbers[-1])):
                    yield from made(held.slice(0, whole), numbers[:whole], params)
                    held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from made(held, numbers_of(held), params)

    return tiles.repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(run, schema)


def share_enough(a: Counter, b: Counter, longer: int, params: OrderMinHashParams) -> bool:
    """An alignment has no more matches than the texts have words in common."""
    return sum((a & b).values()) >= longer - allowed_edits(longer, longer, params.similarity)


def merged(labels: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (id, component) after the links ``more``: their components alone are closed anew."""
    named = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    ends = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    joined = scratch.keep(components(ends, scratch), "joined")
    moved = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return scratch.keep(moved.unionByName(scratch.again(joined).join(labels.select("id"), "id", "left_anti")), "labels")


def in_tiles(placed: DataFrame, tile: int) -> DataFrame:
    """Groups of ``n`` <= ``tile`` documents are a tile; larger ones are dealt to blocks, of which any two meet."""
    placed = placed.withColumn("blocks", F.ceil(F.col("n") / tile).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    out = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("n", "blocks", "other")


CELL_BITS = 18


def two_word_runs(hashes: np.ndarray) -> np.ndarray:
    """Every two consecutive words, labelled with their occurrence number in the text."""
    pairs = grams(hashes, 2)
    return mixed(pairs + occurrences(pairs) * STEP) if len(pairs) else pairs


def run_rows(texts: DataFrame, params: OrderMinHashParams, schema: str, made) -> DataFrame:
    """Rows (a dict of columns) that ``made`` gives for (doc_id, labelled two-word runs) of each text."""
    cell = per_worker(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made_once(cell, lambda: WordHashes(params.remember))
        for doc_id, text in rows_of(batches, "doc_id", "text", at_once=200):
            hashes = known.of(words_of(text))[0]
            if len(hashes) > 1 and (rows := made(doc_id, len(hashes), two_word_runs(hashes))):
                yield pa.record_batch(rows)

    return texts.select("doc_id", "text").mapInArrow(run, schema)


def rare_runs(texts: DataFrame, params: OrderMinHashParams) -> DataFrame:
    """(band, sketch, doc_id): buckets in which any two of ``texts`` that are to be linked meet, without chance.

    An edit touches two of a text's two-word runs at most, so texts of n words within 0.2 n edits share at
    least 0.6 n - 1 of them. In any order of all runs two such texts then share one among each one's first
    n - (0.6 n - 1); the order here puts first what few of the texts have, by counts in a table of fixed size,
    so a passage that all of them hold makes no bucket.
    """
    cells = 1 << CELL_BITS

    def counted(doc_id: int, n: int, runs: np.ndarray) -> dict:
        found, times = np.unique((runs >> np.uint64(64 - CELL_BITS)).astype(np.int64), return_counts=True)
        return {"cell": pa.array(found.astype(np.int32)), "n": pa.array(times)}

    # at most 2^CELL_BITS rows, whatever the input
    counts = run_rows(texts, params, "cell int, n long", counted).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(cells, np.int64)
    held[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(held)

    def first(doc_id: int, n: int, runs: np.ndarray) -> dict:
        need = max(1, int(np.ceil((2 * params.similarity - 1) * n - 1e-9)) - 1)
        how_many = sent.value[(runs >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        chosen = runs[np.lexsort((runs, how_many))[: max(0, len(runs) - need + 1)]]
        return {"band": pa.array(np.full(len(chosen), -1, np.int32)), "sketch": pa.array(chosen.view(np.int64)), "doc_id": pa.array(np.full(len(chosen), doc_id, np.int64))}

    return run_rows(texts, params, "band int, sketch long, doc_id long", first)


def with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def apart(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, sketch, doc_id, component, n) of the buckets that hold several components, equal ones once."""
    labelled = with_component(members.select("band", "sketch", "doc_id"), labels)
    buckets = (
        labelled.groupBy("band", "sketch")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum(F.hash("doc_id").cast("long")).alias("h1"), F.sum(F.hash(F.col("doc_id"), F.lit(1)).cast("long")).alias("h2"))
        .where("low < high")
        .groupBy("n", "h1", "h2")
        .agg(F.min(F.struct("band", "sketch")).alias("bucket"))
        .select("bucket.band", "bucket.sketch", "n")
    )
    return scratch.keep(labelled.join(scratch.keep(buckets, "buckets"), ["band", "sketch"]), "apart")


def near_classes(spark: SparkSession, docs: DataFrame, params: OrderMinHashParams = OrderMinHashParams()) -> DataFrame:
    """A row per row of ``docs``: doc_id, class_id (the least doc_id of its class), class_size, kept."""
    scratch = Scratch(spark, "near")
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = scratch.keep(text_keys(plain, params), "keys")
    copies = keys.groupBy("c1", "c2", "n_words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    same = scratch.keep(keys.select("doc_id", "c1", "c2", "n_words").join(copies.where("n > 1"), ["c1", "c2", "n_words"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies")
    # each sketch of each distinct text; a group of copies becomes one row of partial aggregation
    bags = scratch.keep(keys.select("doc_id", "n_words", "bag", "signature"), "bags")
    band = F.least("band", F.lit(params.sketches + params.loose_sketches)).alias("band")
    sketched = keys.select("c1", "c2", "n_words", "doc_id", F.posexplode("sketches").alias("band", "sketch")).select("c1", "c2", "n_words", "doc_id", band, "sketch").groupBy("band", "sketch", "c1", "c2", "n_words").agg(F.min("doc_id").alias("doc_id"))
    sketched = scratch.keep(sketched.select("band", "sketch", "doc_id"), "sketches")
    scratch.drop(keys)
    buckets = sketched.groupBy("band", "sketch").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).where("n > 1")
    buckets = scratch.keep(buckets, "buckets")  # a table of its own, so Spark can split a hot bucket
    members = scratch.keep(sketched.join(buckets, ["band", "sketch"]), "members")
    scratch.drop(sketched)
    scratch.free_shuffles()
    pairs = scratch.keep(members.where("doc_id <> center").select(F.col("doc_id").alias("a"), F.col("center").alias("b")).distinct(), "pairs")
    pairs = scratch.keep(promising_pairs(pairs, bags, scratch.again(bags), params), "promising")
    involved = members.select("doc_id").distinct()
    texts = scratch.keep(plain.join(involved, "doc_id"), "texts")
    links = scratch.keep(with_texts(pairs, texts, scratch, params).unionByName(same), "links")
    scratch.free_shuffles()
    labels = components(links, scratch)

    # what the stars left apart: first every document is aligned with the one most like it, then all that remain
    labels = scratch.keep(labels, "labels")
    met = apart(members, labels, scratch)
    hot = scratch.keep(met.where(F.col("n") > params.tile).select("doc_id").distinct(), "hot")
    if not hot.isEmpty():
        runs = rare_runs(scratch.again(texts).join(hot, "doc_id"), params)
        met = apart(scratch.keep(met.where(F.col("n") <= params.tile).select("band", "sketch", "doc_id").unionByName(runs), "met"), labels, scratch)
    tiles = in_tiles(met, params.tile).join(scratch.again(bags), "doc_id")
    open_ = scratch.keep(in_whole_tiles(tiles, ["band", "sketch", "low", "high"], open_documents, "doc_id long, nearest long, star long", params, 16_384), "open")
    first = open_.where("nearest is not null").select(F.greatest("doc_id", "nearest").alias("a"), F.least("doc_id", "nearest").alias("b")).distinct()
    first = scratch.keep(first.join(scratch.again(pairs), ["a", "b"], "left_anti"), "first")
    scratch.drop(met, members)
    labels = merged(labels, scratch.keep(with_texts(first, texts, scratch, params), "more"), scratch)
    scratch.free_shuffles()
    # documents whose likely pairs hang together are one group, so that a pair of many buckets is aligned once
    grouped = scratch.keep(components(open_.where("star is not null").select(F.col("doc_id").alias("a"), F.col("star").alias("b")), scratch), "grouped")
    grouped = with_component(grouped.select(F.col("id").alias("doc_id"), F.col("component").alias("grp")), scratch.again(labels))
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("grp", "n")
    placed = scratch.keep(grouped.join(scratch.keep(sizes, "sizes"), "grp"), "placed")
    tiles = in_tiles(placed, params.block).join(scratch.again(bags), "doc_id").join(scratch.again(texts), "doc_id")
    more = in_whole_tiles(tiles, ["grp", "low", "high"], linked_in_tile, "a long, b long", params, 2 * params.block)
    labels = merged(labels, scratch.keep(more, "more"), scratch)
    scratch.drop(texts, pairs, bags, buckets)
    scratch.free_shuffles()
    sizes = scratch.keep(labels.groupBy("component").agg(F.count("*").alias("class_size")), "sizes")
    named = labels.join(sizes, "component").withColumnRenamed("id", "doc_id")
    return docs.select(F.col("doc_id").cast("long")).join(named, "doc_id", "left").select(
        "doc_id",
        F.coalesce("component", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("component").isNull() | (F.col("component") == F.col("doc_id"))).alias("kept"),
    )
