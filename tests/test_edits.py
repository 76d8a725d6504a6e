"""Edits of source text: no edit breaks code, whatever stands in annotations; the standard library loses its annotations and nothing else."""

import ast
import sysconfig
from pathlib import Path

import pytest

from symbolith.operators.edits import Text, Tokens
from symbolith.operators.rewrite import apply, strip
from symbolith.operators.rewrite import strip_sources

LIBRARY = sorted(p for p in Path(sysconfig.get_path("stdlib")).rglob("*.py") if "site-packages" not in p.parts and "lib2to3" not in p.parts)

CASES = [
    ("def f() -> (int): pass\n", "def f(): pass\n"),
    ("def f(a: (int)): pass\n", "def f(a): pass\n"),
    ("x: (int) = 3\n", "x = 3\n"),
    ("(x): int = 3\n", "(x) = 3\n"),
    ("class A:\n    x: (int)\n", "class A:\n    x = ...\n"),
    ("class A:\n    (x): int  # why\n", "class A:\n    (x) = ...  # why\n"),
    ("def f(\n    a: int = 1,  # one\n    *b: 'str', **c: (\n  int # two\n )\n) -> (\n    int\n):\n    return a\n", "def f(\n    a = 1,  # one\n    *b, **c\n):\n    return a\n"),
    ("x: \\\n  int = 3\n", "x = 3\n"),
    ("def f[T: (int, str)](a: T, /, b: dict[str, (int)] = {}) \\\n  -> lambda: 0: pass\n", "def f[T: (int, str)](a, /, b = {}): pass\n"),
    ("def f(a: 'x) -> y', b: {')': 1}[')']) -> ')': pass\n", "def f(a, b): pass\n"),
    ("def f(*args: *Ts, **kw: Unpack[K]) -> None: ...\n", "def f(*args, **kw): ...\n"),
    ("if 1:\n    x: int;\n", "if 1:\n    pass;\n"),
    ("def f():\n    x: int; y: str = f'{1:{2}} {\"a\"}'; z: int\n", "def f():\n    y = f'{1:{2}} {\"a\"}'; pass\n"),
    ("é = 1; ü: (\n int) = 'ß' # x\n", "é = 1; ü = 'ß' # x\n"),
    ("@d(lambda: 0)\nasync def f(a:int)->None:...\n", "@d(lambda: 0)\nasync def f(a):...\n"),
    ("match x:\n    case 1:\n        a: int\n    case _:\n        b: int = 2\n", "match x:\n    case 1:\n        pass\n    case _:\n        b = 2\n"),
    ("try:\n    a: int\nexcept* E:\n    b: int\nelse:\n    c: (int)\nfinally:\n    d: int\n", "try:\n    pass\nexcept* E:\n    pass\nelse:\n    pass\nfinally:\n    pass\n"),
    ("a[0]: int\nb.c: int = 1\n", "b.c = 1\n"),
    ("from typing import overload\n@overload\ndef f(a: int) -> int: ...\n@overload\ndef f(a: str) -> (str): ...\n", "from typing import overload\n@overload\ndef f(a): ...\n@overload\ndef f(a): ...\n"),
    ("x = 1\r\nclass A:\r\n\ty: int\r\n\tz: int = 2\r\n", "x = 1\r\nclass A:\r\n\ty = ...\r\n\tz = 2\r\n"),
]


@pytest.mark.parametrize("code,want", CASES)
def test_strip_keeps_code_whole(code, want):
    assert strip(code) == want


@pytest.mark.parametrize("code", ["def f():\n    x: int\n    def g():\n        nonlocal x\n", "def f(:\n"])
def test_what_does_not_compile_is_an_error(spark, code):
    with pytest.raises(SyntaxError):
        strip(code)
    row = strip_sources(spark.createDataFrame([("x.py", code)], "file string, code string")).first()
    assert row.code == code and row.error


class Bare(ast.NodeTransformer):
    """The tree that stripping must leave."""

    def visit_arg(self, node):
        node.annotation = None
        return node

    def function(self, node):
        self.generic_visit(node)
        node.returns = None
        return node

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_AnnAssign(self, node):
        self.generic_visit(node)
        return ast.Assign([node.target], node.value)

    def generic_visit(self, node):
        for field in ("body", "orelse", "finalbody"):
            body = getattr(node, field, None)
            if isinstance(body, list) and body:
                own = lambda s: isinstance(node, ast.ClassDef) and (isinstance(s.target, ast.Name) or isinstance(s.target, ast.Attribute) and isinstance(s.target.value, ast.Name) and s.target.value.id == "self")
                bare = [s for s in body if isinstance(s, ast.AnnAssign) and s.value is None]
                for s in bare:
                    if own(s):
                        s.value = ast.Constant(...)
                left = [s for s in body if s not in bare or own(s)]
                setattr(node, field, left or ([] if isinstance(node, ast.Module) else [ast.Pass()]))
        return super().generic_visit(node)


def _without_pass(tree):
    """Bodies without `pass` that stands beside others."""
    for node in ast.walk(tree):
        for field in ("body", "orelse", "finalbody"):
            body = getattr(node, field, None)
            if isinstance(body, list) and len(body) > 1:
                left = [s for s in body if not isinstance(s, ast.Pass)] or body[:1]
                setattr(node, field, left)
    return ast.dump(tree)


@pytest.mark.parametrize("part", range(4))
def test_the_standard_library_without_annotations(part):
    changed = 0
    for path in LIBRARY[part::4]:
        try:
            code = path.read_text(encoding="utf-8")
            compile(code, "x.py", "exec", dont_inherit=True)
        except (SyntaxError, ValueError):
            continue
        out = strip(code)
        changed += out != code
        if out != code:
            assert _without_pass(Bare().visit(ast.parse(code))) == _without_pass(ast.parse(out)), path
    assert changed > 5


def test_tokens_have_their_bytes():
    code = "é = f'{x!r:>{w}} ß' + (\n  'ü', [1])  # c\n"
    raw = code.encode()
    lines = [0]
    for line in raw.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    tokens = Tokens(code, lines)
    assert [raw[a:b].decode() for a, b in zip(tokens.start, tokens.end, strict=True)] == ["é", "=", "f'{x!r:>{w}} ß'", "+", "(", "'ü'", ",", "[", "1", "]", ")"]
    assert tokens.partner == {4: 10, 10: 4, 7: 9, 9: 7}


def _node(code, k=0):
    return ast.parse(code).body[k]


def test_actions_are_resolved_in_one_sweep():
    code = "a = f(x)\nb = 2\n"
    for order in (1, -1):
        text = Text(code)
        first, second = _node(code), _node(code, 1)
        actions = [lambda: text.prepend(first, "p; "), lambda: text.append(first, "; q"), lambda: text.replace(first.value.args[0], "y"), lambda: text.replace(second, "c = 3")]
        for action in actions[::order]:
            action()
        assert text.done() == "p; a = f(y); q\nc = 3\n"
    text = Text(code)  # what is inside a span that goes, goes with it
    text.replace(first.value.args[0], "y")
    text.prepend(first.value, "not ")
    text.remove(first)
    assert text.done() == "\nb = 2\n"
    text = Text(code)
    text.edit(0, 3, "z")
    text.edit(2, 5, "w")
    with pytest.raises(ValueError, match="overlap"):
        text.done()


APPLIED = [
    ("(x) = 3\n", {("VARIABLE", "xλ1"): "int"}, "(x): int = 3\n"),
    ("def f(a=(lambda: 0), *, b=(')')) : return a\n", {("CALLABLE_RETURN", "f"): "int", ("CALLABLE_PARAMETER", "f.b"): "str"}, "def f(a=(lambda: 0), *, b: str=(')')) -> int : return a\n"),
    ("def f(  # :\n): pass\n", {("CALLABLE_RETURN", "f"): "int"}, "def f(  # :\n) -> int: pass\n"),
    ("def f[T: (int, str)](a): pass\n", {("CALLABLE_RETURN", "f"): "T"}, "def f[T: (int, str)](a) -> T: pass\n"),
]


@pytest.mark.parametrize("code,annos,want", APPLIED)
def test_apply_beside_brackets(code, annos, want):
    assert apply(code, annos).removeprefix("from __future__ import annotations\n") == want


def test_apply_over_brackets():
    out = apply("def f() -> (\n    int  # old\n): pass\nx: (int) = 1\n", {("CALLABLE_RETURN", "f"): "str", ("VARIABLE", "xλ1"): "str"}, overwrite=True)
    assert out == "from __future__ import annotations\ndef f() -> (\n    str  # old\n): pass\nx: (str) = 1\n"
