"""JSON with comments, unquoted keys, single quotes and trailing commas."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<word>[A-Za-z_$][\w$]*)|(?P<other>[^\s"'A-Za-z_$/]+?(?=[\s"'A-Za-z_$/,:{}\[\]]|$)|.)""",
    re.S,
)


def parse(text: str):
    """Rewrites the tokens as plain JSON and loads that."""
    out: list[str] = []
    for m in _TOKEN.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind == "skip":
            continue
        if kind == "text" and token[0] == "'":
            token = json.dumps(re.sub(r"\\(.)", r"\1", token[1:-1]))
        if kind == "word" and token not in ("true", "false", "null"):
            token = json.dumps(token)
        if token in ("}", "]") and out and out[-1] == ",":
            out.pop()
        out.append(token)
    return json.loads("".join(_spaced(out)))


def _spaced(tokens: list[str]) -> list[str]:
    """Numbers may come in several tokens (1e5); those are joined without a space."""
    out: list[str] = []
    for t in tokens:
        if out and re.fullmatch(r'"[eE]\d*"', t) and re.search(r"\d$", out[-1]):
            t = t.strip('"')
        out.append(t)
    return out
