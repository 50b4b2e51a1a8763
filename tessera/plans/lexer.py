"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.errors import SyntaxProblem

_TOKEN = re.compile(
    r"""\s+|--[^\n]*
    |(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
    |(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<sign><>|!=|<=|>=|[=<>(),.;*+/-])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # string, number, word, sign or end
    text: str  # strings without their quotes
    at: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.text.upper() in words


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SyntaxProblem(f"unexpected {sql[at]!r} at {at}")
        if m.lastgroup:
            text = m.group()
            if m.lastgroup == "string":
                text = text[1:-1].replace(text[0] * 2, text[0])
            out.append(Token(m.lastgroup, text, at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]
