import ast

import pytest

from symbolith.operators.extract import Module
from symbolith.operators.rewrite import apply, diff, strip


def variables(code, file="x.py"):
    return [(s[1], s[2]) for s in Module(code, file).symbols if s[0] == "VARIABLE"]


CASES = [
    ("a: int", []),
    ("a: int\na = 5", [("a", None)]),
    ('a: int\na: str = "x"', [("a", "builtins.str")]),
    ("import requests\nr: requests.models.Response = ...", [("r", "requests.models.Response")]),
    ("a: int\nb: list[str]\na, *b = f()", [("a", "builtins.int"), ("b", "builtins.list[builtins.str]")]),
    ("c: int\na, (b, c) = f()\nd: int\nd = 5", [("a", None), ("b", None), ("c", "builtins.int"), ("d", None)]),
    ('a: int = 5\na: bytes\na: str = "x"\na = 5', [("a", "builtins.int"), ("a", "builtins.str"), ("a", None)]),
    ("i: int\nfor i in f():\n    pass", [("i", "builtins.int")]),
    ("x: int\nwith f() as x:\n    pass", [("x", "builtins.int")]),
    ("class C:\n    foo = ...\n    foo2: int = ...", [("C.foo", None), ("C.foo2", "builtins.int")]),
    ("a: int\nif f():\n    a = 1\nelse:\n    a = 2", [("a", None), ("a", None)]),
    ("from typing import Callable\nfrom amod import A\na: Callable = f\nb: A = g", [("a", "typing.Callable"), ("b", "amod.A")]),
    ("grid[0], *box.sides[1:] = load()", []),
    ("a, (b, c), d = f()", [("a", None), ("d", None), ("b", None), ("c", None)]),
    ("a += 1\nfoo = ...", [("a", None)]),
    ("def f():\n    global a\n    a = 1\nx = lambda y: 1", [("x", None)]),
]


@pytest.mark.parametrize("code,expected", CASES)
def test_variables(code, expected):
    assert variables(code) == expected


def test_relative_import():
    assert variables("from .colour import Shade\nink: Shade = mix()", "draw/pen.py") == [("ink", "draw.colour.Shade")]


def test_functions_and_scopes():
    code = "class C:\n    def __init__(self, a: int, *args, b=1) -> None:\n        self.a: int = a\n    def m(self): ...\ndef outer() -> int:\n    def nested(a: int) -> str: ...\n"
    rows = [(s[0], s[1], s[2]) for s in Module(code).symbols]
    assert rows == [
        ("CALLABLE_RETURN", "C.__init__", "None"), ("CALLABLE_PARAMETER", "C.__init__.self", None), ("CALLABLE_PARAMETER", "C.__init__.a", "builtins.int"), ("CALLABLE_PARAMETER", "C.__init__.b", None),
        ("CALLABLE_RETURN", "C.m", None), ("CALLABLE_PARAMETER", "C.m.self", None), ("CALLABLE_RETURN", "outer", "builtins.int"), ("CALLABLE_RETURN", "outer.nested", "builtins.str"),
        ("CALLABLE_PARAMETER", "outer.nested.a", "builtins.int"), ("VARIABLE", "C.__init__.self.a", "builtins.int"),
    ]


def test_flags():
    code = "a = 1\ndef f():\n    def g():\n        a = 2\n    for i in x:\n        b = 1\n        b = 2\n    else:\n        c = 3\n    if y:\n        d = 1\ndef h():\n    global a\n    a = 3\n"
    flags = {s[1]: s[6:] for s in Module(code).symbols}  # loop, reassigned, nested, branching
    assert flags["f.g"] == (0, 0, 1, 0) and flags["f.g.a"] == (0, 0, 1, 0)
    assert flags["f.i"] == (1, 0, 0, 0) and flags["f.b"] == (1, 1, 0, 0) and flags["f.c"] == (1, 0, 0, 1) and flags["f.d"] == (0, 0, 0, 1)
    assert flags["a"][1] == 1


def test_strip():
    code = "def f(a: int, b: str = 'é') -> int:\n    x: int = 1\n    y: int\n    return x\nclass C:\n    a: int\ndef g():\n    z: str\n"
    out = strip(code)
    assert out == "def f(a, b = 'é'):\n    x = 1\n    return x\nclass C:\n    a = ...\ndef g():\n    pass\n"
    assert "a: int" in strip(code, parameters=False)


def test_apply_and_round_trip():
    code = '"""doc"""\ndef f(a, b=1):\n    x = a\n    for i in x: pass\n    p, q = x\n    return x\n'
    annos = {("CALLABLE_RETURN", "f"): "builtins.int", ("CALLABLE_PARAMETER", "f.a"): "builtins.str", ("VARIABLE", "f.xλ1"): "builtins.str", ("VARIABLE", "f.iλ1"): "builtins.int", ("VARIABLE", "f.qλ1"): "amod.A"}
    out = apply(code, annos)
    assert out == '"""doc"""\nfrom __future__ import annotations\nimport amod\ndef f(a: str, b=1) -> int:\n    x: str = a\n    i: int\n    for i in x: pass\n    q: amod.A; p, q = x\n    return x\n'
    assert apply(out, annos) == out  # nothing is overwritten
    assert ast.dump(ast.parse(strip(out).replace("from __future__ import annotations\nimport amod\n", ""))) == ast.dump(ast.parse(code))
    assert diff("a\nb\n", "a\nc\n").endswith(" a\n-b\n+c\n")
