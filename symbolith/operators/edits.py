"""Edits of Python source text by actions on byte spans, with an index of its tokens.

Actions are prepend, append, replace and remove. One sweep in the order of spans resolves them: what lies within a removed or
replaced span goes with it (of equal spans a removal goes before a replacement, else the first given stays), insertions at one place keep their order, appends
before prepends, and spans that overlap in part are an error. Everything else stays as it is written.
"""

from __future__ import annotations

import io
import tokenize
from bisect import bisect_left, bisect_right
from functools import cached_property

_TRIVIA = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}
_PAIRS = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """The tokens of a source that aren't white space or comments: text, start and end in bytes, and each bracket's partner."""

    def __init__(self, code: str, lines: list[int]):
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.partner: dict[int, int] = {}
        rows, opened = code.encode().splitlines(keepends=True), []
        at = lambda row, col: lines[row - 1] + (col if rows[row - 1].isascii() else len(rows[row - 1].decode()[:col].encode()))
        depth = 0  # of strings with expressions, whose parts are tokens of their own
        for t in tokenize.generate_tokens(io.StringIO(code, newline="").readline):
            inside = depth
            depth += (t.type == tokenize.FSTRING_START) - (t.type == tokenize.FSTRING_END)
            if t.type in _TRIVIA or inside and depth:
                continue
            if inside and not depth:  # one token from the first quote to the last
                self.end[-1] = at(*t.end)
                continue
            k = len(self.text)
            self.text.append(t.string)
            self.start.append(at(*t.start))
            self.end.append(at(*t.end))
            if t.type == tokenize.OP and t.string in _PAIRS.values():
                opened.append(k)
            elif t.type == tokenize.OP and t.string in _PAIRS:
                self.partner[k] = opened.pop()
                self.partner[self.partner[k]] = k

    def from_(self, place: int) -> int:
        """The first token that starts at a place or behind."""
        return bisect_left(self.start, place)

    def before(self, place: int) -> int:
        """The last token that ends at a place or before."""
        return bisect_right(self.end, place) - 1

    def around(self, start: int, end: int) -> tuple[int, int]:
        """A span with all pairs of parentheses that hold nothing but it: number of its first and of its last token."""
        first, last = self.from_(start), self.before(end)
        while self.text[first - 1 : first] == ["("] and self.partner.get(first - 1) == last + 1:
            first, last = first - 1, last + 1
        return first, last


class Text:
    """A source with the byte offsets of its lines, and edits to make."""

    def __init__(self, code: str):
        self.code, self.raw = code, code.encode()
        self.lines = [0]
        for line in self.raw.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.edits: list[tuple[int, int, bytes]] = []

    @cached_property
    def tokens(self) -> Tokens:
        return Tokens(self.code, self.lines)

    def at(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def start(self, node) -> int:
        return self.at(node.lineno, node.col_offset)

    def end(self, node) -> int:
        return self.at(node.end_lineno, node.end_col_offset)

    def edit(self, a: int, b: int, text: str) -> None:
        self.edits.append((a, b, text.encode()))

    def prepend(self, node, text: str) -> None:
        self.edit(self.start(node), self.start(node), text)

    def append(self, node, text: str) -> None:
        self.edits.append((self.end(node), self.end(node), text.encode(), -1))  # before what is put in front of the next

    def replace(self, node, text: str) -> None:
        self.edit(self.start(node), self.end(node), text)

    def remove(self, node) -> None:
        self.edit(self.start(node), self.end(node), "")

    def done(self) -> str:
        """The text after all edits."""
        out, done, outer = [], 0, (0, 0)
        # insertions stand before a span that begins at their place, outer spans before those inside
        order = lambda e: (e[0], e[1] > e[0], -e[1], e[3] if len(e) > 3 else 0, bool(e[2]))
        for a, b, text, *_ in sorted(self.edits, key=order):
            if a < done or a == b == done and outer[0] < a < outer[1]:
                if b <= outer[1] and outer[0] <= a:
                    continue  # goes with what is around it
                raise ValueError(f"edits overlap in part at byte {a}")
            out += [self.raw[done:a], text]
            done = b
            if b > a:
                outer = (a, b)
        return b"".join([*out, self.raw[done:]]).decode()
