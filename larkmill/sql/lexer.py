"""Text to tokens."""

from __future__ import annotations

import re
from typing import NamedTuple

from larkmill.errors import SyntaxProblem


class Token(NamedTuple):
    kind: str  # word, quoted, int, float, text, op, end
    value: object
    at: int

    @property
    def upper(self) -> str:
        return self.value.upper() if self.kind == "word" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<float>\d+\.\d+)
      | (?P<int>\d+)
      | (?P<text>'(?:[^']|'')*')
      | (?P<quoted>"[^"]+"|`[^`]+`)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<op><=|>=|!=|<>|\|\||[-+*/%=<>(),.;:])""",
    re.X | re.S,
)


def tokens(text: str) -> list[Token]:
    """Comments are // to the end of the line and /* */; a quote in a text is doubled; names may be quoted by " or `."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"Unexpected character {text[at]!r} at {at}")
        kind, value = m.lastgroup, m.group()
        if kind == "float":
            out.append(Token(kind, float(value), at))
        elif kind == "int":
            out.append(Token(kind, int(value), at))
        elif kind == "text":
            out.append(Token(kind, value[1:-1].replace("''", "'"), at))
        elif kind == "quoted":
            out.append(Token(kind, value[1:-1], at))
        elif kind != "space":
            out.append(Token(kind, value, at))
        at = m.end()
    out.append(Token("end", "", at))
    return out
