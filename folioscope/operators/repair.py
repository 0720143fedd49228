"""Repair of JSON objects as models write them: a stack automaton over tokens.

A text is cut into tokens by one pattern; a fold over them keeps a stack of open objects and arrays
and writes valid JSON. Closed are strings, arrays and objects that the text leaves open; keys and
words get their quotes; single and typographic quotes become double ones; comments, a code fence,
superfluous commas and broken escapes go; missing commas, colons and values (null) are put in.
What is no object, has keys that are no strings, or goes on after its end, is not repaired.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# a quote inside a string closes it only where the text goes on as after a value
_ENDS = r"(?=\s*(?:[,:\[\]{}\"'“0-9/]|\Z))"
_STRING = rf"\"[^\"\\]*(?:(?:\\(?:.|\Z)|\"(?!{_ENDS}))[^\"\\]*)*\"?"
_SINGLE = rf"'[^'\\]*(?:(?:\\(?:.|\Z)|'(?!{_ENDS}))[^'\\]*)*'?"
_CURLED = r"“[^”\\]*(?:\\(?:.|\Z)[^”\\]*)*”?|[‘][^’\\]*(?:\\(?:.|\Z)[^’\\]*)*’?"
_COMMENT = r"/\*.*?(?:\*/|\Z)|//[^\n]*"
_WORD = r"(?!//|/\*)[^\s{}\[\],:\"'“‘]+"
TOKEN = re.compile(rf"\s+|{_COMMENT}|(?P<text>{_STRING}|{_SINGLE}|{_CURLED})|(?P<mark>[{{}}\[\],:])|(?P<word>-?\d[\d.eE+-]*(?=[\s,\]}}]|\Z)|{_WORD}(?:[ \t]+{_WORD})*)", re.S)
FENCE = re.compile(r"\s*```(?:[a-zA-Z]+)?\s*(.*?)\s*(?:```\s*)?\Z", re.S)
INSIDE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)|[\"\x00-\x1f]", re.S)
NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d*)?([eE][+-]?\d*)?\Z")
CLOSERS = {'"': '"', "'": "'", "“": "”", "‘": "’"}
CONSTANTS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "undefined": "null"}


def _escaped(m: re.Match) -> str:
    if m[1] is None:
        return json.dumps(m[0])[1:-1]
    return m[0] if m[1][0] in '"\\/bfnrt' or len(m[1]) == 5 else json.dumps(m[1])[1:-1]


def string_of(token: str) -> str:
    """A quoted token, maybe without its end, as a JSON string."""
    body = token[1:]
    closed = body.endswith(CLOSERS[token[0]]) and (len(body) - len(body[:-1].rstrip("\\"))) % 2 == 1
    body = body[:-1] if closed else re.sub(r"(?<!\\)((?:\\\\)*)\\(?:u[0-9a-fA-F]{0,3})?\Z", r"\1", body)
    return f'"{INSIDE.sub(_escaped, body)}"'


def word_of(token: str) -> str:
    """A bare value: a constant, a number (completed where it was cut) or else a string."""
    number = NUMBER.match(token)
    if number:
        whole, part, power = number[1], number[2] or "", number[3] or ""
        return whole + (part + "0" if part == "." else part) + (power + "0" if power and not power[-1].isdigit() else power)
    return CONSTANTS.get(token) or ("0" if token == "-" else json.dumps(token, ensure_ascii=False))


def repaired(text: str | None) -> str | None:
    """The object in ``text`` as valid JSON, or None."""
    fenced = FENCE.match(text or "")
    text = fenced[1] if fenced else text or ""
    out: list[str] = []
    stack: list[str] = []
    awaits = "start"  # start, key, colon, value, comma, end
    comma = False  # before the next key or element

    def close() -> None:
        nonlocal awaits, comma
        if awaits in ("colon", "value") and stack[-1] == "{":
            out.append(":null" if awaits == "colon" else "null")
        out.append("}" if stack.pop() == "{" else "]")
        awaits, comma = ("comma" if stack else "end"), False

    for m in TOKEN.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind is None:
            continue
        if awaits == "end":
            if token == ",":
                continue
            return None
        if awaits == "start":
            if token != "{":
                return None
            stack.append("{")
            out.append("{")
            awaits = "key"
            continue
        if token in ("}", "]"):
            opener = "{" if token == "}" else "["
            if opener in stack:
                while stack[-1] != opener:
                    close()
                close()
            continue
        if token == ",":
            if awaits in ("colon", "value") and stack[-1] == "{":
                out.append(":null" if awaits == "colon" else "null")
                awaits = "comma"
            if awaits == "comma":
                awaits, comma = ("key" if stack[-1] == "{" else "value"), True
            continue
        if token == ":":
            if awaits != "colon":
                return None
            out.append(":")
            awaits = "value"
            continue
        if awaits == "comma":  # it is missing
            awaits, comma = ("key" if stack[-1] == "{" else "value"), True
        if awaits == "colon":
            out.append(":")
            awaits = "value"
        if comma:
            out.append(",")
            comma = False
        if awaits == "key":
            if kind == "mark":
                return None
            out.append(string_of(token) if kind == "text" else json.dumps(token, ensure_ascii=False))
            awaits = "colon"
        elif kind == "mark":
            stack.append(token)
            out.append(token)
            awaits = "key" if token == "{" else "value"
        else:
            out.append(string_of(token) if kind == "text" else word_of(token))
            awaits = "comma"
    if awaits == "start":
        return None
    while stack:
        close()
    return "".join(out)


@F.arrow_udf(ArrayType(StringType()))
def repair(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``repaired`` of each text of an array, equal ones once; null where there is nothing to repair."""

    def each(of: list[str | None]) -> list[str | None]:
        made = {t: t and repaired(t) for t in set(of)}
        return [made[t] for t in of]

    for texts in batches:
        yield pa.array([of and each(of) for of in texts.to_pylist()], pa.list_(pa.string()))
