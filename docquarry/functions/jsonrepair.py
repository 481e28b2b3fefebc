"""Reads JSON that a language model wrote almost rightly."""

from __future__ import annotations

import json
import re

_FENCE = re.compile(r"```[a-zA-Z]*\s*(.*?)```", re.S)
_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})
_WORDS = {"True": "true", "False": "false", "None": "null", "NaN": "null", "undefined": "null", "Infinity": "null"}
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")
_BARE = re.compile(r"[A-Za-z_$][\w$-]*")


def _tokens(s: str):
    """Punctuation and values as JSON text; comments and dots left out, strings requoted."""
    i = 0
    while i < len(s):
        c = s[i]
        if c.isspace():
            i += 1
        elif s.startswith("//", i) or c == "#":
            i = s.find("\n", i) + 1 or len(s)
        elif s.startswith("/*", i):
            i = s.find("*/", i) + 2 if "*/" in s[i:] else len(s)
        elif c in "{}[]:,":
            yield c
            i += 1
        elif c in "\"'":
            j, out = i + 1, []
            while j < len(s) and s[j] != c:
                if s[j] == "\\" and j + 1 < len(s):
                    out.append("'" if s[j + 1] == "'" else s[j : j + 2])
                    j += 2
                else:
                    out.append({'"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(s[j], s[j]))
                    j += 1
            yield '"' + "".join(out) + '"'
            i = j + 1
        elif s.startswith("...", i):
            yield "null"
            i += 3
        elif m := _NUMBER.match(s, i):
            yield m[0]
            i = m.end()
        elif m := _BARE.match(s, i):
            word = _WORDS.get(m[0], m[0])
            yield word if word in ("true", "false", "null") else json.dumps(word)
            i = m.end()
        else:
            raise ValueError(f"unexpected {c!r} at {i}")


def _balanced(tokens: list[str]) -> str:
    """Without trailing commas, and with the brackets closed that were left open."""
    out: list[str] = []
    opened: list[str] = []
    for t in tokens:
        if t in "]}" and len(t) == 1:
            while out and out[-1] == ",":
                out.pop()
            if not opened:
                continue
            while opened and opened[-1] != t:
                out.append(opened.pop())
            if opened:
                out.append(opened.pop())
            if not opened:
                break
            continue
        if t in "[{" and len(t) == 1:
            opened.append("]" if t == "[" else "}")
        out.append(t)
    while out and out[-1] in (",", ":"):
        out.append("null") if out[-1] == ":" else out.pop()
    return "".join(out + opened[::-1])


def parse_json(text: str):
    """The value that text holds, after repairs if need be; ValueError if it can't be read."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("no JSON: the text is empty")
    m = _FENCE.search(text)
    body = (m[1] if m else text).strip()
    try:
        return json.loads(body)
    except ValueError:
        pass
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        raise ValueError(f"no JSON in {text[:100]!r}")
    try:
        return json.loads(_balanced(list(_tokens(body[start:].translate(_QUOTES)))))
    except ValueError as e:
        raise ValueError(f"can't be read as JSON: {e}") from e
