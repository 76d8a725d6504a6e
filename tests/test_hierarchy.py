"""Linearisations against Python's own, of classes that run and of classes as their sources declare them; voting over a hierarchy that is data."""

import argparse
import ast
import asyncio
import collections.abc
import email.message
import enum
import http.client
import json.decoder
import logging.handlers
import sys
import unittest.mock
from pathlib import Path

import pytest
from test_operators import GOLDEN, TYPES, agents, winner

from symbolith.operators import hierarchy, resolve
from symbolith.operators.hierarchy import c3

MODULES = [argparse, ast, asyncio, collections.abc, email.message, enum, http.client, json.decoder, logging.handlers, unittest.mock]


def name(c):
    return f"{c.__module__}.{c.__qualname__}"


def running():
    """Classes of this process by name; of names that several have, none. With all their ancestors."""
    found, todo = {}, [object]
    while todo:
        for c in type.__subclasses__(todo.pop()) if todo else ():
            if name(c) not in found or found[name(c)] is not c:
                found[name(c)] = c if name(c) not in found else None
                todo.append(c)
    good = {n: c for n, c in found.items() if c is not None and "<locals>" not in n}
    return {n: c for n, c in good.items() if all(b is object or good.get(name(b)) is b for b in c.__mro__)}


def test_linearisation_is_that_of_python(spark):
    classes = running()
    assert len(classes) > 800
    known = spark.createDataFrame([(n, [name(b) for b in c.__bases__]) for n, c in classes.items()], "cls string, bases array<string>").repartition(4)
    got = {}
    for r in hierarchy.linearised(known).collect():
        assert r.error is None
        got.setdefault(r.derived, {})[r.place] = r.base
    assert {n: [x[k] for k in range(len(x))] for n, x in got.items()} == {n: [name(b) for b in c.__mro__] for n, c in classes.items()}
    assert any(len(c.__bases__) > 1 and len(c.__mro__) > 6 for c in classes.values())


def test_hierarchy_of_sources(spark):
    top = Path(ast.__file__).parent
    files = [p for p in sorted(top.glob("*.py")) + sorted(p for d in ("asyncio", "collections", "email", "http", "importlib", "json", "logging", "unittest") for p in (top / d).rglob("*.py"))]
    rows = [(str(p.relative_to(top)), p.read_text(encoding="utf-8")) for p in files]
    classes = hierarchy.classes(spark.createDataFrame([*rows, ("bad.py", "class")], "file string, code string").repartition(4))
    known = classes.select("cls", "bases").unionByName(hierarchy.builtin_classes(spark)).dropDuplicates(["cls"])
    found = {}
    for r in hierarchy.linearised(known).collect():
        found.setdefault(r.derived, {})[r.place] = r.base
    same = other = 0
    for n, c in running().items():
        if c.__module__ not in sys.modules or n not in found or c.__module__ == "builtins" or any(b.__module__ in ("typing", "abc", "_io") for b in c.__mro__):
            continue
        want = [name(b) for b in c.__mro__]
        got = [found[n][k] for k in range(len(found[n]))] if None not in found[n] else None
        same, other = same + (got == want), other + (got != want)
    assert same > 300 and other < 0.1 * same, (same, other)  # others: bases that are bound at run time, or under another module's name


def test_names_of_bases():
    code = "import a.b as c\nfrom . import d\nclass X(c.Y, Generic[T], metaclass=M):\n    class Z(d.W): ...\n    class V(Z): ...\nclass U(X.Z, *rest, make()): ...\nclass T: ...\n"
    assert hierarchy.class_rows(code, "p/m.py") == [
        ("p.m.X", ["a.b.Y", "Generic"], 3), ("p.m.U", ["p.m.X.Z", "make()"], 6), ("p.m.T", [hierarchy.OBJECT], 7), ("p.m.X.Z", ["p.d.W"], 4), ("p.m.X.V", ["p.m.X.Z"], 5),
    ]
    assert hierarchy.module_of("a/b/__init__.py") == "a.b" and hierarchy.module_of("x.pyi") == "x"


def test_errors_of_their_own(spark):
    rows = [("A", ["B"]), ("B", ["A"]), ("C", ["A"]), ("X", ["O"]), ("Y", ["O"]), ("P", ["X", "Y"]), ("Q", ["Y", "X"]), ("R", ["P", "Q"]), ("S", ["X", "X"]), ("T", ["unknown"]), ("E", [])]
    found = hierarchy.linearised(spark.createDataFrame(rows, "cls string, bases array<string>")).collect()
    errors = {r.derived: r.error for r in found if r.error}
    assert set(errors) == {"A", "B", "C", "R", "S"} and "itself" in errors["C"] and "order of the bases of R" in errors["R"] and "twice" in errors["S"]
    of = lambda n: [r.base for r in sorted((r for r in found if r.derived == n), key=lambda r: r.place)]
    assert of("P") == ["P", "X", "Y", "O", hierarchy.OBJECT] and of("T") == ["T", "unknown", hierarchy.OBJECT] and of("E") == ["E", hierarchy.OBJECT]
    with pytest.raises(ValueError, match="itself"):
        c3("A", {"A": ["B"], "B": ["A"]})


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    store = hierarchy.stored
    monkeypatch.setattr(hierarchy, "stored", lambda df, n: rounds.append(n) or store(df, n))
    edges = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(100)], "derived string, base string")
    assert hierarchy.ancestors(edges).count() == 100 * 101 // 2
    assert len(rounds) <= 9


def test_subtypes(spark):
    h = hierarchy.linearised(hierarchy.builtin_classes(spark))
    pairs = spark.createDataFrame([("builtins.bool", "builtins.int"), ("builtins.int", "builtins.bool"), ("builtins.int", "builtins.int"), ("x.Y", "builtins.int")], "derived string, base string")
    got = {(r.derived, r.base): r.subtype for r in hierarchy.subtypes(h, pairs).collect()}
    assert got == {("builtins.bool", "builtins.int"): True, ("builtins.int", "builtins.bool"): False, ("builtins.int", "builtins.int"): True, ("x.Y", "builtins.int"): None}


def test_voting_over_a_table_of_types(spark):
    """The same winners as with lists, beside a hundred thousand types that nobody predicts, which never become part of the plan."""
    up = resolve.closure(None, TYPES)
    many = spark.range(100_000).selectExpr("concat('T', id) as derived", "explode(array(concat('T', id), concat('T', id div 10), 'object')) as base", "0 as place").dropDuplicates(["derived", "base"])
    table = spark.createDataFrame([(t, a, k) for t, chain in up.items() for k, a in enumerate(chain)], "derived string, base string, place int").unionByName(many)
    found = resolve.voting(agents(spark, [c for c, _ in GOLDEN]), table, "g", "topn")
    assert [r.anno for r in found.orderBy("file").collect()] == [w for _, w in GOLDEN] == [winner(c) for c, _ in GOLDEN]
    assert "T999" not in found._jdf.queryExecution().toString()
