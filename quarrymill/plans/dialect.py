"""A small shim for metrics written for an engine with QUALIFY, strftime and any_value that skips nulls.

Works on tokens, so quoted text and identifiers are never touched. Everything else passes unchanged.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\w+|\s+|[^\w\s]")
_END = {"ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW"}
#: strftime directives and the patterns of date_format (fixed values).
_FORMAT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM"}


def _format(text: str) -> str:
    body = re.split(r"(%.)", text[1:-1])
    return "'" + "".join(_FORMAT.get(p, "") if p.startswith("%") else re.sub(r"[A-Za-z]+", r"''\g<0>''", p) for p in body) + "'"


def _level_end(tokens: list[str], at: int) -> int:
    """The first token after ``at`` that closes the level or begins a later clause."""
    depth = 0
    for k in range(at, len(tokens)):
        t = tokens[k]
        if t == "(":
            depth += 1
        elif t == ")":
            if depth == 0:
                return k
            depth -= 1
        elif depth == 0 and t.upper() in _END:
            return k
    return len(tokens)


def _level_start(tokens: list[str], at: int) -> int:
    """The SELECT that begins the level of ``at``."""
    depth = 0
    for k in range(at - 1, -1, -1):
        t = tokens[k]
        if t == ")":
            depth += 1
        elif t == "(":
            if depth == 0:
                break
            depth -= 1
        elif depth == 0 and t.upper() == "SELECT":
            return k
    return -1


def _qualify(tokens: list[str]) -> list[str]:
    for k, t in enumerate(tokens):
        if t.upper() != "QUALIFY":
            continue
        start, end = _level_start(tokens, k), _level_end(tokens, k + 1)
        if start < 0:
            return tokens
        body, depth, source = tokens[start + 1 : k], 0, len(tokens[start + 1 : k])
        for j, x in enumerate(body):
            depth += (x == "(") - (x == ")")
            if depth == 0 and x.upper() == "FROM":
                source = j
                break
        inner = ["SELECT", *body[:source], ", (", *tokens[k + 1 : end], ") AS __kept ", *body[source:]]
        whole = ["SELECT * EXCEPT (__kept) FROM (", *inner, ") AS __q WHERE __kept "]
        return _qualify([*tokens[:start], *whole, *tokens[end:]])
    return tokens


def translate(sql: str) -> str:
    tokens = _qualify(_TOKEN.findall(sql))
    out: list[str] = []
    calls: list[tuple[str, int]] = []
    for t in tokens:
        name = out[-1].lower() if out and t == "(" else ""
        if t == "(":
            calls.append((name, len(out)))
            if name == "strftime":
                out[-1] = "date_format"
        if t == ")" and calls:
            name, _ = calls.pop()
            if name == "any_value":
                out.append(", true")
        if t.startswith("'") and calls and calls[-1][0] == "strftime":
            t = _format(t)
        out.append(t)
    return "".join(out)
