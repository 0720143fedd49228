"""Collocations, ranked search and mixing against brute force on small tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import pyarrow as pa
import pytest
import zstandard

from folioscope.llm.collocations import CollocationParams, collocations, rare_folder
from folioscope.llm.mixing import mixed
from folioscope.llm.ranked_search import RankedSearchParams, ranked_search

SCHEMA = "doc_id long, text string, lang string, source string, item string, w1 string, score int, taken int, __sum long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Documents with columns whose names clash with ours."""
    return spark.createDataFrame([(i, t, lang, src, "x", None, 1, None, 5) for i, t, lang, src in rows], SCHEMA)


def made(n: int, seed: int, words: int = 12):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "İx", "A-b", "the", "The"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "!", " "]
    out = []
    for i in range(n):
        text = "".join(dice.choice(vocabulary[: dice.choice([3, 6, len(vocabulary)])]) + dice.choice(ends[: dice.choice([1, len(ends)])]) for _ in range(dice.randrange(60)))
        out.append((i, text, dice.choice(["en", "de", None]), dice.choice(["a", "b", "c", "d", None])))
    out += [(n, None, "en", "a"), (n + 1, "", "fr", "e"), (None, "the The THE", None, None), out[3], out[3], (n + 2, "w1 w2 w3 " * 3000, "en", "a")]
    return out


# --- collocations


def brute_collocations(rows, longest=3, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if a >= least and " " in p}
        for phrase, a in candidates.items():
            if any(f" {phrase} " in f" {longer} " and longer != phrase and 100 * b >= inside * a for longer, b in candidates.items()):
                continue
            words = phrase.split(" ")
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[" ".join(words[:k])], counts[" ".join(words[k:])]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("params", [{}, {"longest": 4, "least": 5, "inside": 80}, {"top": 3, "ranked_rows": 5, "fan_in": 2, "block_bytes": 50}])
def test_collocations_are_those_of_brute_force(spark, params):
    rows = made(150, 1)
    params = CollocationParams(**params)
    got = rows_of(collocations(spark, table(spark, rows).repartition(5), params))
    assert got == sorted(brute_collocations(rows, params.longest, params.least, params.inside, params.top), key=repr)
    assert got


def test_collocations_of_nothing(spark):
    assert collocations(spark, table(spark, [])).collect() == []
    assert collocations(spark, table(spark, [(1, None, None, None), (2, "a b", "en", None)])).collect() == []


@pytest.mark.parametrize("held", [(10, 1), (10, 30), (200, 10), (1 << 20, 1 << 20)])
def test_folding_keeps_the_sums_of_frequent_phrases(held):
    dice = random.Random(3)
    rows = []
    for _ in range(3000):
        w = [dice.choice("abc"), dice.choice("abcdefgh"), dice.choice("abcdefghijklmnop")]
        w = w[: dice.choice([1, 2, 3, 3, 3])] + [None] * 3
        rows.append((zlib.crc32(repr(w[:2]).encode()) % 5, dice.choice(["en", "de"]), *w[:3], dice.randrange(1, 4)))
    rows.sort(key=lambda r: r[0])
    pack = lambda r: zstandard.compress((" ".join(w or "" for w in r[2:5]) + f" {r[5]}\n").encode())
    batches = [pa.record_batch([[r[0] for r in part], [r[1] for r in part], [pack(r) for r in part]], names=["bucket", "lang", "windows"]) for part in (rows[i : i + 40] for i in range(0, len(rows), 40))]

    def sums(found):
        out = Counter()
        for *words, times in found:
            for k in range(4):
                if None not in words[: k + 1]:
                    out[tuple(words[: k + 1])] += times
        return {p: f for p, f in out.items() if f >= 10 or len(p) == 1}

    folded = [tuple(r.values()) for b in rare_folder(CollocationParams(), *held)(iter(batches)) for r in b.to_pylist()]
    assert sums(folded) == sums(r[1:] for r in rows)


# --- ranked search


def brute_search(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    held = [(i, Counter(words), len(words)) for i, words in ((d[0], find(d[1])) for d in docs)]
    count, length = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        terms, scores = set(find(text)), []
        for doc, tf, n in held:
            score = 0
            for t in terms & tf.keys():
                m = 10 + 90 * n * count // length
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, rank, doc if there else None, -score) for rank, (score, there, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(0, "w1 w2 The"), (1, "É w3-w4; İx w1 w1"), (2, None), (3, ""), (4, "nowhere"), (5, "the"), (5, "w5 w6"), (None, "w7 w8 w9 w10 w11"), (8, "w0 w1 w2 w3 w4 w5 w6 w7 b a")]


@pytest.mark.parametrize("params", [{}, {"filter_terms": 0}, {"k": 2, "rounds": (0.9, 0.8, 0.7, 0.5, 0.3, 0.2, 0.1, 0.0), "block_bytes": 100}, {"k": 1, "rounds": (0.6, 0.0)}])
def test_search_is_that_of_brute_force(spark, params):
    docs = made(120, 2)
    params = RankedSearchParams(**params)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc", "2 AS w", "3 AS doc_id")
    got = ranked_search(spark, table(spark, docs).repartition(4), items, params)
    assert rows_of(got) == brute_search(docs, ITEMS, params.k)


def test_search_of_many_rare_documents_stops_early(spark):
    dice = random.Random(5)
    docs = [(i, " ".join(["common", "often"] + [f"r{dice.randrange(40)}" for _ in range(4)] * (1 + i % 3)), None, None) for i in range(400)]
    items = [(i, f"common often r{i} r{i + 1} r{i + 2}") for i in range(0, 40, 4)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    for rounds in ((0.5, 0.3, 0.15, 0.0), (0.05, 0.0)):
        assert rows_of(ranked_search(spark, table(spark, docs), asked, RankedSearchParams(k=3, rounds=rounds))) == brute_search(docs, items, 3)


def test_search_in_or_for_nothing(spark):
    asked = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search(spark, table(spark, []), asked).collect() == []
    assert ranked_search(spark, table(spark, made(5, 3)), asked.limit(0)).collect() == []
    assert ranked_search(spark, table(spark, [(1, None, None, None)]), asked).collect() == []


# --- mixing


def water_fill(sizes, weights, budget):
    """Targets by sharing what is over again and again."""
    targets, open_sources = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_sources:
        left = budget - sum(targets[s] for s in sizes if s not in open_sources)
        share = {s: weights[s] * left / sum(weights[o] for o in open_sources) for s in open_sources}
        over = {s for s in open_sources if share[s] >= 2 * sizes[s]}
        if not over:
            return targets | share
        targets |= {s: 2.0 * sizes[s] for s in over}
        open_sources -= over
    return targets


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rows = made(300, seed)
    got = [r.asDict() for r in mixed(spark, table(spark, rows).repartition(6)).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(r[0]), size(r[1])) for r in rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()) * 3 // 2)
    of = {i: s for i, _, _, s in rows}
    taken, longest = Counter(), Counter()
    for r in got:
        source = of[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        taken[source] += r["taken"]
        longest[source] = max(longest[source], r["size"])
    assert sum(taken.values()) == sum(sizes.values()) * 3 // 2
    # documents are whole, so at the cut each source has at most its longest document less than its share of the time
    late = sum(longest.values()) / sum(want.values())
    for source in sizes:
        assert -longest[source] - 1 <= taken[source] - want[source] <= late * want[source] + 1
    again = [r.asDict() for r in mixed(spark, table(spark, rows[::-1]).repartition(3)).collect()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mix_of_little(spark):
    assert mixed(spark, table(spark, [])).collect() == []
    assert rows_of(mixed(spark, table(spark, [(1, None, None, "a"), (2, " \t", None, None)]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert rows_of(mixed(spark, table(spark, [(1, "a b c d", None, "s")]))) == [(1, 4, 4, 6.0, 6)]


def test_params_are_plain():
    assert replace(CollocationParams(), top=5).top == 5
