import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm.bpe import BpeParams, Encoder, decode, encode, read_ranks, round_trip
from folioscope.llm.packing import PackingParams, WordEncoder, best_fit_packing, best_fit_plan

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARAMS = BpeParams(RANKS, public_tokenizers.PATTERN)
ODD = ["", " ", "it's 'll A1b2  \n\n x", "ééé 中文 🙂", "\x1c \xa0 a\x85b", "aaaa" * 50, "<|endoftext|> ok", "Σας ΣΑΣ İ", "\ta\r\nb", "  lead", "é"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PARAMS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_bpe_is_the_librarys(encoder, library, text):
    ids = encoder.encode_block([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_bpe_query_rows(spark, library):
    rows = [(n, t) for n, t in enumerate([*ODD, None, "word " * 5000])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids_sha256 string")
    twice = round_trip(docs.union(docs).union(docs.select(F.lit(None).cast("long"), "text", "ids_sha256")), PARAMS)
    assert twice.count() == 3 * len(rows) and twice.distinct().count() == 2 * len(rows) - 1  # no text and an empty one encode alike
    assert round_trip(docs.limit(0), PARAMS).count() == 0
    got = {r.doc_id: r for r in round_trip(docs, PARAMS).collect()}
    for n, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[n].n_tokens == len(ids) // 4 and got[n].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[n].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    bodies = {r.doc_id: bytes(r.body) for r in decode(encode(docs, PARAMS), PARAMS).collect()}
    assert bodies == {n: (t or "").encode() for n, t in rows}


def test_words_are_the_librarys():
    library = Tokenizer.from_file(WORDS)
    random.seed(2)
    letters = list("abtheing 'sllve\n\t  123éü中文🙂́\x1c\xa0.,!?ΣςİÅ")
    texts = ODD + ["".join(random.choices(letters, k=40)) for _ in range(500)]
    mine = WordEncoder(WORDS, 50).encode_block(texts)
    assert mine == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def one_at_a_time(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        open_ = [i for i, r in enumerate(bins) if r >= x]
        if open_:
            bins[min(open_, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return Counter(bins)


@settings(max_examples=200, deadline=None)
@given(items=st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(items):
    used, spans = Counter(), []
    for length, first, end, bin_, per, offset in best_fit_plan(Counter(items), 40):
        for r in range(first, end):
            to = bin_ + (r - first) // per
            spans.append((to, offset + (r - first) % per * length, length))
            used[to] += length
    end = {}
    for to, at, length in sorted(spans):
        assert end.get(to, 0) == at
        end[to] = at + length
    assert Counter(40 - n for n in used.values()) == one_at_a_time(items, 40) and len(spans) == len(items)


def test_packing_places_every_token_once(spark):
    rows = [(n, t) for n, t in enumerate([*ODD, None, "word " * 700, "other thing " * 30])]
    rows = [*rows, rows[2], (None, "no id")]  # a repeated row and a null id are packed like others
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, sequence_id long, piece string")
    out = best_fit_packing(spark, docs, PackingParams(WORDS, capacity=64)).collect()
    library = Tokenizer.from_file(WORDS)
    want = []
    for n, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(-1 if n is None else n, i, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for i, a in enumerate(range(0, len(ids), 64))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert len({r.sequence_id for r in out}) == sum(one_at_a_time([w[2] for w in want], 64).values())
    full = {}
    for r in out:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 1 <= r.length <= 64 and r.start == r.piece * 64
    for spans in full.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert {r.doc_id for r in out} == {n for n, _ in rows}
    assert best_fit_packing(spark, docs.limit(0), PackingParams(WORDS)).count() == 0


def test_added_tokens_are_the_librarys(spark):
    library = Tokenizer.from_file(WORDS)  # untouched
    rows = [(n, t) for n, t in enumerate([*ODD, "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", "<|endoftext"])]
    ids = {n: [*library.encode(t, add_special_tokens=False).ids, 0] for n, t in rows}
    assert 49407 in ids[len(ODD)]
    out = best_fit_packing(spark, spark.createDataFrame(rows, "doc_id long, text string"), PackingParams(WORDS)).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in out} == {n: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for n, x in ids.items()}
