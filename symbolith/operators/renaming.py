"""Source text in which each assignment's target has a name of its own, or hints stand in the blocks where they are in force; and back."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame

from .edits import Text
from .extract import Module
from .numbering import SIGN
from .rewrite import _rewritten

#: The value of a hint that was written into a block. A fixed value.
MARKER = "λ__LOWERED_HINT_MARKER__λ"
_NUMBER = re.compile(SIGN.encode() + rb"[0-9]+$")
_BEHIND = re.compile(rb";[ \t]*|\r?\n[ \t]*|\r[ \t]*")


def _marked(s: ast.AST) -> bool:
    return isinstance(s, ast.AnnAssign) and isinstance(s.value, ast.Name) and s.value.id == MARKER


def _stored(code: str):
    """Names and attributes that a source binds."""
    return (n for n in ast.walk(ast.parse(code)) if isinstance(n, (ast.Name, ast.Attribute)) and isinstance(n.ctx, ast.Store))


class Binder(Module):
    """A file's variables with the nodes that bind them (bound) and those of hints in front (fronts), by name and number; and the hints
    that come from outside a block (outer) with the statements that they are for."""

    def __init__(self, code: str, file: str = "x.py"):
        self.text, self.current = Text(code), None
        self.count: dict[str, int] = {}
        self.bound: list[tuple[str, int, ast.expr]] = []
        self.fronts: list[tuple[str, int, ast.expr]] = []
        self.outer: list[tuple[ast.stmt, str, str]] = []
        self.written: dict[tuple[str, str | None], str] = {}  # annotations as they stand in the source
        super().__init__(code, file)

    def statement(self, s: ast.stmt) -> None:
        before, self.current = self.current, s
        name = self.target(s.target) if isinstance(s, ast.AnnAssign) else None
        if name is not None and self.free(name):
            key, anno = self.qname(name), self.anno(s.annotation)
            self.written[key, anno] = self.text.raw[self.text.start(s.annotation) : self.text.end(s.annotation)].decode()
            in_class = bool(self.scope) and self.scope[-1][0] == "class"
            if _marked(s) or (s.value is None and not in_class):
                self.fronts.append((key, self.count.get(key, 0) + 1, s.target))
            if _marked(s):
                self.hints[-1][key] = [anno, False, False]
                self.current = before
                return
        super().statement(s)
        self.current = before

    def variable(self, name: str, anno, labelled, inferred) -> None:
        super().variable(name, anno, labelled, inferred)
        key = self.qname(name)
        self.count[key] = self.count.get(key, 0) + 1
        self.bound.append((key, self.count[key], self.node))
        if self.lowered and self.current is not None:
            self.outer.append((self.current, name, self.written[key, inferred]))


def numbered(code: str, file: str = "x.py") -> str:
    """code with targets named as qname_ssa names them. A hint takes the number of the assignment behind it, and keeps its name if there is
    none. Reads, globals and nonlocals stay. A source that binds a name with the sign already is an error."""
    if any(SIGN in (n.id if isinstance(n, ast.Name) else n.attr) for n in _stored(code)):
        raise ValueError(f"a name has {SIGN} in it")
    work = Binder(code, file)
    for key, k, node in work.bound + work.fronts:
        if k <= work.count.get(key, 0):
            at = work.text.end(node)
            work.text.edit(at, at, f"{SIGN}{k}")
    return work.text.done()


def plain(code: str) -> str:
    """What numbered was given."""
    text = Text(code)
    for node in _stored(code):
        a, b = text.start(node), text.end(node)
        if m := _NUMBER.search(text.raw, a, b):
            text.edit(m.start(), b, "")
    return text.done()


def lowered(code: str, file: str = "x.py") -> str:
    """code with a marked hint before each assignment whose hint comes from outside its block."""
    work = Binder(code, file)
    text = work.text
    for s, name, anno in work.outer:
        at = text.start(s)
        simple = isinstance(s, (ast.Assign, ast.AugAssign))
        end = "; " if simple else "\n" + text.raw[text.lines[s.lineno - 1] : at].decode()
        text.edit(at, at, f"{name}: {anno} = {MARKER}{end}")
    return text.done()


def unlowered(code: str) -> str:
    """What lowered was given; a marked hint that nothing follows in its block becomes `pass`."""
    text = Text(code)
    for s in ast.walk(ast.parse(code)):
        if _marked(s):
            a, b = text.start(s), text.end(s)
            behind = _BEHIND.match(text.raw, b)
            last = behind is None or (behind[0][:1] != b";" and behind.end() - text.lines[s.lineno] != s.col_offset)
            text.edit(a, b if last else behind.end(), "pass" if last else "")
    return text.done()


def numbered_sources(sources: DataFrame) -> DataFrame:
    """file, code and error; a file that can't be renamed keeps its code."""
    return _rewritten(sources, lambda file, code: numbered(code or "", file), "code")


def plain_sources(sources: DataFrame) -> DataFrame:
    return _rewritten(sources, lambda file, code: plain(code or ""), "code")


def lowered_sources(sources: DataFrame) -> DataFrame:
    return _rewritten(sources, lambda file, code: lowered(code or "", file), "code")


def unlowered_sources(sources: DataFrame) -> DataFrame:
    return _rewritten(sources, lambda file, code: unlowered(code or ""), "code")
