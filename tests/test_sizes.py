"""What keeps the queries over source trees in bounds when the trees grow."""

import re

import pytest

from symbolith.operators import edits, rewrite
from symbolith.plans import registry, source_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q37_diff", "q38_declared_predictor", "q41_apply_with_imports", "q42_apply_stubs", "q49_lowered_hints"])
def test_what_comes_of_files_is_never_broadcast(spark, name):
    """Spark guesses the size of rows that Python functions give from the bytes that these read; at 90,000 files it still sent all through the driver."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_stubs_need_one_walk_and_no_tokens(monkeypatch):
    walks = []
    real = rewrite.Applier.__init__
    monkeypatch.setattr(rewrite.Applier, "__init__", lambda self, *a: (walks.append(a), real(self, *a))[1])
    monkeypatch.setattr(edits, "Tokens", None)
    fill = lambda text: text.replace("NAME", "7")
    assert rewrite.apply_stub(fill(source_queries._LARGE), fill(source_queries._STUB)) == fill(source_queries._STUBBED)
    assert len(walks) == 1


HARD = [
    "def f(a, b=(1, 2)): return a\nx = 1\n", "def f(a=')', b='('): return a\n(x) = 1\n", "def f(a, # )\n b): return a\nx \\\n = 1\n", "def f[T: (int, str)](a: T, b=((1))): return a\nx=1\n",
    "def f(\n a,\n b=(lambda: (0))\n): return a\n( (x) ) = y = 1\n", "async def f(a, b: dict[str, int] = (3)): return a\nx\t= 2\n", "global_ = 1\ndef f(a, b):\n    global x\n    x = 1\nx = 2\n",
    "class f:\n    x = 1\n    def f(a, b):\n        @g(')')\n        def h(c): return (c)\n",
]


@pytest.mark.parametrize("code", HARD)
@pytest.mark.parametrize("overwrite", [False, True])
def test_brackets_are_counted_as_tokens_have_them(monkeypatch, code, overwrite):
    annos = {("CALLABLE_RETURN", q): "a.b" for q in ("f", "f.f", "f.f.h")} | {("VARIABLE", q): "int" for q in ("xλ1", "f.xλ1")} | {("CALLABLE_PARAMETER", "f.b"): "str"}
    got = rewrite.apply(code, annos, overwrite=overwrite)
    assert got != code
    monkeypatch.setattr(rewrite, "_HIDING", re.compile(b""))
    monkeypatch.setattr(rewrite, "_ASSIGNED", re.compile(b"(?!)"))
    assert rewrite.apply(code, annos, overwrite=overwrite) == got


def test_annotations_need_no_tokens(monkeypatch):
    monkeypatch.setattr(edits, "Tokens", None)
    annos = {("VARIABLE", "C7.sizeλ1"): "builtins.int", ("CALLABLE_RETURN", "C7.run"): "os.PathLike", ("CALLABLE_PARAMETER", "C7.run.deep"): "builtins.bool", ("CALLABLE_PARAMETER", "C7.run.inner.x"): "amod.T7", ("VARIABLE", "C7.run.aλ1"): "builtins.int"}
    head = "from __future__ import annotations\nimport amod\n"
    assert rewrite.apply(source_queries._LARGE.replace("NAME", "7"), annos) == head + source_queries._SIZED.replace("NAME", "7")
