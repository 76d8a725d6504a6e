"""Names in their scopes: what an annotation's names stand for, and bindings of the standard library as Python's own symbol tables have them."""

import ast
import symtable
import sysconfig
import time
from pathlib import Path

import pytest

from symbolith.operators import functions
from symbolith.operators.extract import Module
from symbolith.operators.scopes import FUNCTIONS, Scopes

LIBRARY = sorted(p for p in Path(sysconfig.get_path("stdlib")).rglob("*.py") if "site-packages" not in p.parts and "lib2to3" not in p.parts)


def annos(code, file="x.py"):
    return {s[1]: s[2] for s in Module(code, file).symbols if s[2] is not None}


CASES = [
    ("def g():\n    from bmod import A\n    y: A = 1\nfrom amod import A\nx: A = 1\n", {"x": "amod.A", "g.y": "bmod.A"}),
    ("def f():\n    class int: ...\n    a: int = 1\nb: int = 2\n", {"f.a": "f.int", "b": "builtins.int"}),
    ("x: tuple[()] = ()\ny: dict[str, tuple[()]] = {}\n", {"x": "builtins.tuple[()]", "y": "builtins.dict[builtins.str, builtins.tuple[()]]"}),
    ("class Outer:\n    class Inner: ...\n    a: Inner = 1\n    def m(self, p: Inner) -> 'Inner':\n        q: Inner = p\n", {"Outer.a": "Outer.Inner", "Outer.m.p": "Outer.Inner", "Outer.m": "'Inner'", "Outer.m.q": "Inner"}),
    ("class A:\n    str = 1\n    def m(self, a: str):\n        b: str = a\n", {"A.m.a": "A.str", "A.m.b": "builtins.str"}),
    ("def f():\n    class T: ...\n    def g(a: T): ...\n", {"f.g.a": "f.T"}),
    ("import a.b as c, d.e\nx: c.T = 1\ny: d.e.U = 2\n", {"x": "a.b.T", "y": "d.e.U"}),
    ("def f():\n    global T\n    from m import T\nx: T = 1\n", {"x": "m.T"}),
    ("def f():\n    T = 1\n    def g():\n        nonlocal T\n        import m as T\n        def h(a: T): ...\n    def k(a: T): ...\n", {"f.g.h.a": "m", "f.k.a": "m"}),
    ("try:\n    from fast import T\nexcept ImportError:\n    from slow import T\nx: T = 1\n", {"x": "slow.T"}),
    ("[int for int in y]\nx: int = 1\n", {"x": "builtins.int"}),
    ("[(str := z) for z in y]\nx: str = 1\n", {"x": "str"}),
    ("def f(int): \n    x: int = 1\n", {"f.x": "f.int"}),
    ("def f(int) -> int: ...\n", {"f": "builtins.int"}),
    ("def f[T](a: T) -> list[T]: ...\nx: T = 1\n", {"f.a": "T", "f": "builtins.list[T]", "x": "T"}),
    ("from typing import Annotated, Type, Callable\na: Annotated[int, Gt(5)] = 1\nb: Type[int] = int\nc: Callable[[int], str] = f\n", {"a": "typing.Annotated[builtins.int, Gt(5)]", "b": "typing.Type[int]", "c": "typing.Callable[[int], builtins.str]"}),
    ("a: int | None = 1\nb: 'int | x' = 2\nc: constr(min_length=1) = 3\n", {"a": "builtins.int | None", "b": "'int | x'", "c": "constr"}),
    ("with f() as int: pass\nx: int = 1\n", {"x": "int"}),
    ("try: pass\nexcept E as str: pass\nx: str = 1\n", {"x": "str"}),
    ("match y:\n    case {'a': int, **str}: pass\nx: int = 1\nz: str = 1\n", {"x": "int", "z": "str"}),
    ("f = lambda int: 0\nx: int = 1\n", {"x": "builtins.int"}),
]


@pytest.mark.parametrize("code,want", CASES)
def test_what_names_stand_for(code, want):
    assert annos(code) == want


@pytest.mark.parametrize("line,want", [("from . import T", "a.b.T"), ("from .. import T", "a.T"), ("from ..c import T", "a.c.T"), ("from .c.d import T", "a.b.c.d.T")])
def test_relative_imports_in_functions(line, want):
    assert annos(f"def f():\n    {line}\n    x: T = 1\n", "a/b/m.py") == {"f.x": want}


def _tables(table):
    """Module, class and function tables by kind, name and line; those of comprehensions and lambdas have names in <>."""
    yield table
    for child in table.get_children():
        yield from _tables(child)


def _own_names(table):
    return {s.get_name() for s in table.get_symbols() if s.is_local() or s.is_declared_global() and s.is_assigned() and table.get_type() == "module"}


@pytest.mark.parametrize("part", range(3))
def test_bindings_are_those_of_python(part):
    seen = 0
    for path in LIBRARY[part::3]:
        try:
            code = path.read_text(encoding="utf-8")
            tree, table = ast.parse(code), symtable.symtable(code, "x.py", "exec")
        except (SyntaxError, ValueError):
            continue
        if "type_params" in ast.dump(tree) and any(getattr(n, "type_params", None) for n in ast.walk(tree)):
            continue  # scopes of type parameters are tables of their own
        scopes = Scopes(tree)
        inlined = {n.id for c in ast.walk(tree) if isinstance(c, ast.comprehension) for n in ast.walk(c.target) if isinstance(n, ast.Name)}  # Python's tables count them to the function
        at = {}
        for node, scope in scopes.of.items():
            line = 0 if isinstance(node, ast.Module) else min([node.lineno, *(d.lineno for d in node.decorator_list)])
            at.setdefault((scope.kind, scope.path[-1] if scope.path else "top", line), []).append(scope)
        for t in _tables(table):
            kind = str(getattr(t.get_type(), "value", t.get_type()))
            if kind not in ("module", "class", "function") or t.get_name() in ("lambda", "listcomp", "setcomp", "dictcomp", "genexpr", "__annotate__"):
                continue
            found = at.get((kind, t.get_name(), t.get_lineno()), [])
            if len(found) != 1 or kind == "module":
                continue
            plain = lambda names: {n for n in names if not (n.startswith(("_", ".")) and "__" in n) and n[0] != "."}  # private names are others in the tables
            want, got = plain(s.get_name() for s in t.get_symbols() if s.is_local()), plain(found[0].names)
            annotated = {s.get_name() for s in t.get_symbols() if s.is_annotated() and not s.is_imported()}
            assert want - annotated - inlined <= got, (path, t.get_name(), t.get_lineno())
            assert got <= want | annotated | set(found[0].moved), (path, t.get_name(), t.get_lineno())
            seen += 1
    assert seen > 3000


def test_functions_are_found():
    tree = ast.parse("class A:\n    def f(self): ...\n")
    assert {type(n).__name__ for n in Scopes(tree).of} == {"Module", "ClassDef", "FunctionDef"} and FUNCTIONS


def test_many_globals_take_linear_time():
    def seconds(n):
        code = "def f():\n" + "".join(f"    global a{k}\n    a{k} = 1\n" for k in range(n))
        began = time.perf_counter()
        assert Module(code).symbols[0][1] == "f"
        return time.perf_counter() - began

    seconds(200)
    assert seconds(4000) < 1.5


def test_nodes_are_those_of_extraction():
    code = "import m\n[i for i in y]\ndef f(a, *b, **c):\n    global g\n    g = 1\n    d: int\n    d = 2\n    (e, self.h), k = m\n    with o as p.q: pass\nclass C:\n    r: str\n"
    nodes = {(c, q) for c, q, *_ in functions.node_rows(code)}
    extracted = {(s[0], s[1]) for s in Module(code).symbols}
    assert nodes - extracted == {("CALLABLE_PARAMETER", "f.b"), ("CALLABLE_PARAMETER", "f.c")} and extracted <= nodes
    assert [r[2:4] for r in functions.node_rows(code) if r[1] == "f.d"] == [(6, 4), (7, 4)]
