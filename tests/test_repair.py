"""Repair of botched answers, and what parsing makes of them."""

from __future__ import annotations

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.operators import answers as N
from folioscope.operators.repair import repaired

REPAIRS = [
    ('{"a": "abc', {"a": "abc"}),
    ('{"a": [1,2', {"a": [1, 2]}),
    ('{"a":', {"a": None}),
    ('{"a"', {"a": None}),
    ('{"foo', {"foo": None}),
    ("{", {}),
    ('{"a":"b\\', {"a": "b"}),
    ('{"a":"b\\u20', {"a": "b"}),
    ('{"a":"b\\\\', {"a": "b\\"}),
    ("{a: 1, b: hello world}", {"a": 1, "b": "hello world"}),
    ("{'a': 'It's', 'b': \"x\"}", {"a": "It's", "b": "x"}),
    ('{"a":1,,"b":2,}', {"a": 1, "b": 2}),
    ('{"a":[1,2,],}', {"a": [1, 2]}),
    ('{"a":1 "b":[2 3]}', {"a": 1, "b": [2, 3]}),
    ('/*c*/{"a": 1 // x\n, "b": True, "c": None}', {"a": 1, "b": True, "c": None}),
    ('```json\n{"a": [1', {"a": [1]}),
    ('```json\n{"a": [1,]}\n```', {"a": [1]}),
    ('{"a": "The "quoted" word", "b": 2.}', {"a": 'The "quoted" word', "b": 2.0}),
    ('{"a":[{"b":1]}', {"a": [{"b": 1}]}),
    ('{"a": “hi”, ‘b’: 1e}', {"a": "hi", "b": 1.0}),
    ('{"a": "x\\q\n y"}', {"a": "xq\n y"}),
    ('{"a": 05, "b": -, "c": tru', {"a": "05", "b": 0, "c": "tru"}),
    ('{"a" 1, "b" {"c": 2}}', {"a": 1, "b": {"c": 2}}),
    ('{"a": , "b": }', {"a": None, "b": None}),
    ("{{{", None),
    ("[1]", None),
    ("", None),
    (None, None),
    ('text {"a":1}', None),
    ('{"a":1} tail', None),
]


@pytest.mark.parametrize(("text", "want"), REPAIRS)
def test_repairs(text, want):
    got = repaired(text)
    assert want is None and got is None or json.loads(got) == want


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=8), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=5), v, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=5), VALUES, max_size=4), st.data())
def test_valid_json_stays_and_cut_json_parses(value, data):
    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1)):
        got = repaired(text)
        assert got is not None and len(json.loads(got)) == len(value)
        cut = text[: data.draw(st.integers(1, len(text)))]
        assert isinstance(json.loads(repaired(cut)), dict)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="{}[],:\"'\\ab1 \n/*", max_size=30))
def test_any_text_gives_an_object_or_nothing(text):
    got = repaired("{" + text)
    assert got is None or isinstance(json.loads(got), dict)


def test_long_answers_take_time_in_proportion():
    start = time.perf_counter()
    assert repaired("{" * 100_000 + " none") is None
    assert N.objects_in("{" * 100_000 + " none") == []
    assert len(repaired('{"a": ["' + 'x"y ' * 50_000)) > 100_000
    assert len(repaired('{"a": [' + '"b",' * 50_000)) > 100_000
    assert time.perf_counter() - start < 5


def test_objects_are_found_as_character_by_character():
    def slowly(raw):
        found, depth, start, quoted, escaped = [], 0, 0, False, False
        for at, c in enumerate(raw):
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), quoted and (escaped or c != '"')
            elif c == '"':
                quoted = depth > 0
            elif c == "{":
                start, depth = (at if depth == 0 else start), depth + 1
            elif c == "}" and depth:
                depth -= 1
                found += [raw[start : at + 1]] if depth == 0 else []
        return found

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet='{}"\\ab', max_size=25))
    def same(raw):
        assert N.objects_in(raw) == slowly(raw)

    same()


def test_readings_of_answers(spark):
    """The reference's own cases: what parses, which reading, and the reason where none does."""
    raws = {
        1: '{"atsChecks": [{"id": "keyword", "score": 70, "detail": "Cukup",},], "weaknesses": [], "suggestions": [],}',
        2: "{'atsChecks': [{'id': 'skills', 'score': 60, 'detail': 'Sebagian'}]}",
        3: '{"atsChecks": [{"id": "readability\',\'score": 80, "detail": "Ringkas"}]}',
        4: '{\'atsChecks": [{"id": "quantified", "score": 40, "detail": "Sedikit angka"}]}',
        5: '{"atsChecks": [{"id": "keyword"',
        6: "   ",
        7: "Maaf, saya tidak bisa menilai CV ini.",
        8: '{"atsChecks": [], "weaknesses": ["x"]}',
        9: '{"atsChecks": [{"id": "keyword", "score": 55, "detail": "cut off he',
        10: None,
        11: "{" * 2000 + " tidak ada JSON",
        12: '{// c\n atsChecks: [{id: keyword, score: 33}]}',
    }
    answers = spark.createDataFrame([(i, "mode-a", "en", raw) for i, raw in raws.items()], "answer_id long, mode string, language string, raw string")
    picked = {r["answer_id"]: r for r in N.pick_answer(answers).collect()}
    reasons = {i: r["reason"] for i, r in picked.items()}
    assert reasons == {1: None, 2: None, 3: None, 4: None, 5: "incomplete", 6: "empty", 7: "no-json", 8: "incomplete", 9: None, 10: "empty", 11: "no-json", 12: None}
    parsed = N.parse_variants(N.answer_candidates(answers))
    best = N.pick_answer(answers).where("reason IS NULL").select("answer_id", "cand_ord", "variant")
    found = {r["answer_id"]: (r["check_id"], r["score"]) for r in N.normalize_checks(parsed.join(best, ["answer_id", "cand_ord", "variant"])).collect()}
    assert found == {1: ("keyword", 70), 2: ("skills", 60), 3: ("readability", 80), 4: ("quantified", 40), 9: ("keyword", 55), 12: ("keyword", 33)}
