"""Documents, function frames, collections and rewriting of odd sources."""

import random

import pytest
from pyspark.sql import functions as F

from symbolith.operators import align, documents, functions, resolve, rewrite
from symbolith.sources import scans, sinks


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_cursor_documents(spark):
    slots = spark.createDataFrame([("x.py", 1, "f.a"), ("x.py", 2, "f.b"), ("x.py", 3, "g.a")], "file string, ord long, name string")
    found = spark.createDataFrame([("x.py", 1, "f.a", "int"), ("x.py", 2, "g.a", "str")], "file string, ord long, name string, anno string")
    text = documents.cursor_documents(slots, found).first()
    assert text.document == '{"f":[{"category":"arg","name":"a","type":["int"]}],"g":[{"category":"arg","name":"a","type":["str"]}]}'


def test_cursor_against_a_plain_search():
    r = random.Random(1)
    for _ in range(500):
        slots, found = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        want, cursor = [], 0
        for name in slots:
            at = next((k for k in range(cursor, len(found)) if found[k] == name), -1)
            cursor = at + 1 if at >= 0 else cursor
            want.append(at)
        assert align.greedy_cursor(slots, found) == want
    assert align.greedy_cursor(["z"] * 200_000, ["a"] * 200_000) == [-1] * 200_000  # no scan for each miss


def test_literals(spark):
    cases = [("[None, 'a']", [None, "a"]), ("('a',)", ["a"]), ("()", []), ("['it\\'s', \"b\", r'c']", ["it's", "b", "c"]), (" ['\\u00e9' 'x'] ", ["éx"]), ("[1]", None), ("{'a'}", None), ("['a'", None), ("f()", None), ("'a'", None), ("", None), (None, None), ("[" * 5000, None)]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", documents.string_list(F.col("t")).alias("l")).orderBy("k").collect()
    assert [r.l for r in got] == [w for _, w in cases]


def test_frames(spark):
    code = "class C:\n    def m(self, a: int, b=1) -> str:\n        if a: return b\n        return 'x'\ndef g(*args, **kw) -> None:\n    return kw\nasync def h(q: Any): pass\n"
    sources = spark.createDataFrame([("x.py", code), ("bad.py", "def"), ("none.py", None)], "file string, code string")
    found = functions.function_frame(sources)
    assert [(r.cls_name, r.func_name, r.arg_names, r.arg_types, r.return_expr, r.arg_names_len) for r in found.orderBy("ord").collect()] == [
        ("C", "m", ["self", "a", "b"], [None, "int", None], ["b", "'x'"], 3), (None, "g", [], [], ["kw"], 0), (None, "h", ["q"], ["Any"], [], 1),
    ]
    assert [(r.arg_name, r.arg_type) for r in functions.argument_frame(found).orderBy("pos").collect()] == [("a", "int"), ("b", None)]
    assert [r.func_name for r in functions.return_frame(found).collect()] == ["m"]
    nodes = {(r.category, r.qname): (r.line, r.col) for r in functions.node_frame(sources).collect()}
    assert nodes["CALLABLE_PARAMETER", "g.args"] == (5, 7) and nodes["CALLABLE_PARAMETER", "g.kw"] == (5, 15) and nodes["CALLABLE_RETURN", "C.m"] == (2, 4)


def test_functions_and_collections_on_disk(spark, tmp_path):
    sources = spark.createDataFrame([("x.py", "def f(a): return 1, 'q\"r'\n")], "file string, code string")
    frame = functions.function_frame(sources)
    for name, df in (("some", frame), ("none", frame.filter("false").coalesce(1))):
        sinks.write_functions(df, f"{tmp_path}/{name}")
        back = spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/{name}")
        assert "arg_names_len" in back.columns and back.count() == df.count()
    assert spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/some").first().return_expr == '["(1, \'q\\"r\')"]'
    symbols = spark.createDataFrame([("x.py", "VARIABLE", "a", "aλ1", None), ("y.py", "VARIABLE", "é", "éλ1", "int")], "file string, category string, qname string, qname_ssa string, anno string")
    sinks.write_collection(symbols, f"{tmp_path}/c")
    back = sinks.read_collection(spark, f"{tmp_path}/c")
    assert rows(back) == rows(symbols) and sinks.updated(back, symbols).count() == 4
    with pytest.raises(ValueError):
        sinks.updated(symbols, symbols.drop("anno"))


def test_crawl_and_vocabulary(spark, tmp_path):
    for path, text in {"a/p/x.py": b"x = 1\n", "a/p/sub/y.py": b"\xff", "b/q/z.py": b"#", "b/loose.py": b"#"}.items():
        (tmp_path / "r" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / path).write_bytes(text)
    got = {(r.author, r.project, r.file, r.error) for r in scans.crawl(spark, f"{tmp_path}/r").collect()}
    assert got == {("a", "p", "x.py", None), ("a", "p", "sub/y.py", "not UTF-8"), ("b", "q", "z.py", None)}
    (tmp_path / "types.csv").write_text("n,type\n9,str\n8,int\n")
    assert rows(scans.type_vocabulary(spark, f"{tmp_path}/types.csv")) == ["('int', 1)", "('str', 0)"]


def test_rows_by_rank_and_provenance(spark):
    df = spark.createDataFrame([("a", 1, "int"), ("b", 1, None), ("a", 2, "Any")], "provenance string, topn int, original_annotation string")
    assert {k: v.count() for k, v in documents.by_rank(df, 3).items()} == {1: 2, 2: 1, 3: 0}
    assert {r.provenance: len(r["rows"]) for r in documents.by_provenance(df).collect()} == {"a": 2, "b": 1}
    assert documents.without_ignored(df, lambda c: c == "Any").count() == 2
    assert documents.display_sample(df, "provenance", n=2).count() == 2
    lists = spark.createDataFrame([("['a', \"b\"]",), ("[]",), ("no",), (None,)], "t string")
    assert [r[0] for r in lists.select(documents.string_list(F.col("t"))).collect()] == [["a", "b"], [], None, None]


def test_closure_of_a_cycle_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "type string, parent string")
    with pytest.raises(Exception):
        resolve.subtype_closure(edges).collect()


ODD = [
    "pass\n\x0cdef f(a):\n    pass\n", "s = '\u2028'\ndef f(a,  # c: d\n  b=lambda: 0) :\n    return s\n", '"""d"""; x = 1\n', "#!/bin/sh\n# -*- coding: utf-8 -*-\nimport os; x = 1\n",
    "def f(a):\r\n    x = a\r\n    return x\r\n", "@dec(lambda: 1)\nasync def f(a, /, b=(1), *c, d: int = 2, **e): x = 1; y, z = x\n", "from __future__ import division\nx = 1", "x = 1",
    "def f[T: (int, str)]():\n    x = 1\n", "for x, y in a: z = 1\nwith a as x: y = 1\n", "global x\nx = 1\n", "if 1: x = 1\nelse: x = 2; y = 3\n", "class f:\n  x = a = 1\n  def f(self): self.x = 1\n", '"""d"""',
]


@pytest.mark.parametrize("code", ODD)
@pytest.mark.parametrize("overwrite", [False, True])
def test_applied_source_compiles(code, overwrite):
    annos = {}
    for scope in ("", "f.", "f.f."):
        annos |= {("VARIABLE", f"{scope}{v}λ{k}"): "amod.sub.A" for v in ("x", "y", "z", "a", "self.x") for k in (1, 2)}
        annos |= {("CALLABLE_PARAMETER", f"{scope}f.{p}"): "typing.List['q.T']" for p in "abcd"} | {("CALLABLE_RETURN", f"{scope}f"): "builtins.int"}
    compile(code, "x.py", "exec")
    out = rewrite.apply(code, annos, overwrite=overwrite)
    compile(out, "x.py", "exec")
    assert ("import amod.sub" in out) == ("amod.sub.A" in out) and out.count("def f(") == code.count("def f(")
    if not overwrite:
        assert rewrite.apply(out, annos) == out or "x, y" in code or "as x" in code


def test_imports_that_are_there():
    annos = {("VARIABLE", "xλ1"): "a.b.C", ("VARIABLE", "yλ1"): "os.path.P", ("VARIABLE", "zλ1"): "m.N"}
    out = rewrite.apply("import os\nfrom k import m\nimport a.b\nx = 1\ny = 1\nz = 1\n", annos)
    assert out.startswith("from __future__ import annotations\nimport os.path\nimport os\n") and "import m" not in out.replace("k import m", "")
    assert rewrite.apply("x = 1\n", annos, imports=False) == "from __future__ import annotations\nx: a.b.C = 1\n"


def test_stubs_go_by_signature():
    code = "def f(a, b): return a\nclass C:\n    def f(self, *a): pass\nv = 1\n"
    stub = "import m\nfrom t import T, U\ndef f(a: T, c: int) -> U: ...\nclass C:\n    def f(self, *a) -> m.N: ...\nv: T\n"
    assert rewrite.apply_stub(code, stub) == "from __future__ import annotations\nimport m\nfrom t import T\ndef f(a, b): return a\nclass C:\n    def f(self, *a) -> m.N: pass\nv: T = 1\n"
    assert rewrite.apply_stub("v: int = 1\n", "v: str\n") == "from __future__ import annotations\nv: str = 1\n"
