"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(ValueError):
    """A statement that can't be parsed, planned or applied."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name (quoted), number, string, mark, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "mark" else ""


_SCAN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^']|'')*')
    |(?P<name>"(?:[^"]|"")+"|`[^`]+`)
    |(?P<word>[A-Za-z_][A-Za-z_0-9$]*)
    |(?P<mark><>|!=|<=|>=|\|\||::|[-+*/%=<>(),.;?\[\]])""",
    re.VERBOSE | re.DOTALL,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            raise SqlError(f"unexpected character {text[at]!r} at {at}")
        kind, body = m.lastgroup, m.group()
        if kind == "string":
            body = body[1:-1].replace("''", "'")
        elif kind == "name":
            body = body[1:-1].replace('""', '"')
        if kind != "skip":
            out.append(Token(kind, body, at))
        at = m.end()
    return [*out, Token("end", "", at)]


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
