"""Queries over source trees on disk and over programs of many shapes, both written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare, extract, rewrite
from ..session import shared_dir, table
from ..sources import runs, scans, sinks
from .registry import query

#: Where a customer's file lies: names that begin with _ or a dot, blanks, signs of URLs, nested folders; every eleventh is empty.
_PLACE = """CASE c_custkey % 6 WHEN 0 THEN 'p' || c_custkey || '/__init__.py' WHEN 1 THEN 'p/_' || c_custkey || '.py' WHEN 2 THEN '_p/.d/' || c_custkey || '.py'
WHEN 3 THEN 'p/a b%20' || c_custkey || '.py' WHEN 4 THEN 'p/q/' || c_custkey || '.pyi' ELSE 'p/' || c_custkey || '.txt' END"""
_TEXT = "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'x = \"\"\"' || c_name || ' é\"\"\"' || chr(10) END"


@query(f"""SELECT 'a' || c_nationkey || '/' || place AS file, text AS code, CAST(NULL AS VARCHAR) AS error
FROM (SELECT c_nationkey, c_custkey, {_PLACE} AS place, {_TEXT} AS text FROM customer) WHERE place LIKE '%.py' OR place LIKE '%.pyi'""")
def q67_source_scan(spark, d):
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    files = table(spark, d, "customer").select(F.concat(F.lit("a"), "c_nationkey", F.lit("/"), F.expr(_PLACE)).alias("file"), F.expr(_TEXT).alias("code"))
    sinks.write_sources(files, root)
    return scans.sources(spark, root, stubs=True)


#: Programs of different shapes, NAME being a customer's number and TEXT its name: the program, its symbols' annotations (category, qname, anno), and the
#: program without annotations. What they state is worked out by hand.
V, P, R = "VARIABLE", "CALLABLE_PARAMETER", "CALLABLE_RETURN"
SHAPES: list[tuple[str, list[tuple[str, str, str | None]], str]] = [
    ("def gNAME():\n    from bmod import A\n    y: A = 1\nfrom amod import A\nx: A = 'TEXT'\n", [(R, "gNAME", None), (V, "gNAME.y", "bmod.A"), (V, "x", "amod.A")],
     "def gNAME():\n    from bmod import A\n    y = 1\nfrom amod import A\nx = 'TEXT'\n"),
    ("def f():\n    class int: ...\n    a: int = NAME\nb: int = NAME  # TEXT\n", [(R, "f", None), (V, "f.a", "f.int"), (V, "b", "builtins.int")],
     "def f():\n    class int: ...\n    a = NAME\nb = NAME  # TEXT\n"),
    ("def fNAME() -> (\n    int  # TEXT\n): pass\n", [(R, "fNAME", "builtins.int")], "def fNAME(): pass\n"),
    ("class ONAME:\n    class Inner: ...\n    a: Inner = 1\n    def m(self, p: Inner): ...\n", [(V, "ONAME.a", "ONAME.Inner"), (R, "ONAME.m", None), (P, "ONAME.m.self", None), (P, "ONAME.m.p", "ONAME.Inner")],
     "class ONAME:\n    class Inner: ...\n    a = 1\n    def m(self, p): ...\n"),
    ("x: tuple[()] = ()\n(y): (dict[str, int]) = {'TEXT': NAME}\n", [(V, "x", "builtins.tuple[()]"), (V, "y", "builtins.dict[builtins.str, builtins.int]")], "x = ()\n(y) = {'TEXT': NAME}\n"),
    ("from typing import overload\n@overload\ndef fNAME(a: int) -> int: ...\n@overload\ndef fNAME(b: str) -> (str): ...\n",
     [(R, "fNAME", "builtins.int"), (P, "fNAME.a", "builtins.int"), (R, "fNAME", "builtins.str"), (P, "fNAME.b", "builtins.str")],
     "from typing import overload\n@overload\ndef fNAME(a): ...\n@overload\ndef fNAME(b): ...\n"),
    ("match NAME:\n    case [int, *rest]:\n        a: int = rest\n    case _:\n        b: str\n", [(V, "a", "int")], "match NAME:\n    case [int, *rest]:\n        a = rest\n    case _:\n        pass\n"),
    ("class C:\n    size: (int)\n    text: 'TEXT' = None\n    def get(self) -> 'C': ...\n", [(V, "C.size", "builtins.int"), (V, "C.text", "'TEXT'"), (R, "C.get", "'C'"), (P, "C.get.self", None)],
     "class C:\n    size = ...\n    text = None\n    def get(self): ...\n"),
    ("import a.b as c, d.e\nxNAME: c.T = 1\ny: d.e.U | None = 2\n", [(V, "xNAME", "a.b.T"), (V, "y", "d.e.U | None")], "import a.b as c, d.e\nxNAME = 1\ny = 2\n"),
    ("def f(a: int, /, *args: str, k: 'x) -> y' = NAME, **kw: bytes): return a\n", [(R, "f", None), (P, "f.a", "builtins.int"), (P, "f.k", "'x) -> y'")], "def f(a, /, *args, k = NAME, **kw): return a\n"),
    ("async def runNAME(q: list[str]) -> dict[str, bytes]:\n    async with q as w: ...\n    async for i in w: ...\n",
     [(R, "runNAME", "builtins.dict[builtins.str, builtins.bytes]"), (P, "runNAME.q", "builtins.list[builtins.str]"), (V, "runNAME.w", None), (V, "runNAME.i", None)],
     "async def runNAME(q):\n    async with q as w: ...\n    async for i in w: ...\n"),
    ("def f():\n    global total\n    total: int\n    total = NAME\ntotal = 0\n", [(R, "f", None), (V, "total", None)], "def f():\n    global total\n    total = NAME\ntotal = 0\n"),
    ("if NAME:\n    v: int\n    v = 1\nelse:\n    v: str = 'TEXT'\n", [(V, "v", None), (V, "v", "builtins.str")], "if NAME:\n    v = 1\nelse:\n    v = 'TEXT'\n"),
    ("try:\n    from fast import T\nexcept ImportError:\n    from slow import T\ndef f(a: T) -> T: ...\n", [(R, "f", "slow.T"), (P, "f.a", "slow.T")], "try:\n    from fast import T\nexcept ImportError:\n    from slow import T\ndef f(a): ...\n"),
    ("def fNAME[T: (int, str)](a: T) -> list[T]: ...\n", [(R, "fNAME", "builtins.list[T]"), (P, "fNAME.a", "T")], "def fNAME[T: (int, str)](a): ...\n"),
    ("from typing import Annotated, Callable\na: Annotated[int, Gt(NAME)] = 1\nb: Callable[[int], str] = f\n", [(V, "a", "typing.Annotated[builtins.int, Gt(NAME)]"), (V, "b", "typing.Callable[[int], builtins.str]")],
     "from typing import Annotated, Callable\na = 1\nb = f\n"),
    ("total: int; count: int = NAME; last: str\n", [(V, "count", "builtins.int")], "count = NAME; pass\n"),
    ("x: \\\n  int = NAME\nfor k in [int for int in x]: y: int = k\n", [(V, "x", "builtins.int"), (V, "k", None), (V, "y", "builtins.int")], "x = NAME\nfor k in [int for int in x]: y = k\n"),
    ("class A:\n    str = 'TEXT'\n    def m(self, a: str):\n        b: str = a\n        self.c: int\n", [(V, "A.str", None), (R, "A.m", None), (P, "A.m.self", None), (P, "A.m.a", "A.str"), (V, "A.m.b", "builtins.str")],
     "class A:\n    str = 'TEXT'\n    def m(self, a):\n        b = a\n"),
    ("def outer():\n    T = 1\n    def inner():\n        nonlocal T\n        import mNAME as T\n        def last(a: T): ...\n", [(R, "outer", None), (R, "outer.inner", None), (R, "outer.inner.last", None), (P, "outer.inner.last.a", "mNAME"), (V, "outer.T", None)],
     "def outer():\n    T = 1\n    def inner():\n        nonlocal T\n        import mNAME as T\n        def last(a): ...\n"),
    ("é: int = NAME; ü: (\n  str) = 'ß TEXT'  # ok\n", [(V, "é", "builtins.int"), (V, "ü", "builtins.str")], "é = NAME; ü = 'ß TEXT'  # ok\n"),
    ("a[NAME]: int\nb.c: int = 1\nself.d: str = 'TEXT'\n", [(V, "self.d", "builtins.str")], "b.c = 1\nself.d = 'TEXT'\n"),
]


def _text_sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled_sql(text: str) -> str:
    return f"replace(replace({_text_sql(text)}, 'NAME', cast(c_custkey AS varchar)), 'TEXT', c_name)"


def _shapes(spark, d):
    """A program for each customer; the shape goes by its number."""
    texts = F.array(*(F.lit(code) for code, _, _ in SHAPES))
    code = F.replace(F.replace(F.get(texts, (F.col("c_custkey") % len(SHAPES)).cast("int")), F.lit("NAME"), F.col("c_custkey").cast("string")), F.lit("TEXT"), F.col("c_name"))
    files = table(spark, d, "customer").select(F.concat(F.lit("d/c"), "c_custkey", F.lit(".py")).alias("file"), code.alias("code"))
    return files.repartition(spark.sparkContext.defaultParallelism)


_SYMBOLS = " UNION ALL ".join(
    f"SELECT {k} AS k, '{c}' AS category, {_text_sql(q)} AS qname, {_text_sql(a) if a is not None else 'NULL'} AS anno" for k, (_, symbols, _) in enumerate(SHAPES) for c, q, a in symbols
)


@query(f"""SELECT 'd/c' || c_custkey || '.py' AS file, category, replace(qname, 'NAME', cast(c_custkey AS varchar)) AS qname, replace(replace(anno, 'NAME', cast(c_custkey AS varchar)), 'TEXT', c_name) AS anno
FROM customer JOIN ({_SYMBOLS}) ON k = c_custkey % {len(SHAPES)}""")
def q68_scoped_annotations(spark, d):
    return extract.annotated_symbols(_shapes(spark, d)).select("file", "category", "qname", "anno")


@query(f"""SELECT 'd/c' || c_custkey || '.py' AS file, CASE c_custkey % {len(SHAPES)} {' '.join(f'WHEN {k} THEN {_filled_sql(bare)}' for k, (_, _, bare) in enumerate(SHAPES))} END AS code, CAST(NULL AS VARCHAR) AS error FROM customer""")
def q69_strip_shapes(spark, d):
    return rewrite.strip_sources(_shapes(spark, d))


_RUN = "SELECT 'f' || o_orderkey % 5 AS file, 'VARIABLE' AS category, 'x' || o_orderkey AS qname, 'x' || o_orderkey AS qname_ssa, o_orderstatus AS anno, o_orderpriority AS method, 1 AS topn, 'a.' || o_custkey % 40 AS project FROM orders"


@query(f"""WITH r AS ({_RUN}) SELECT file, category, qname, qname_ssa, CASE WHEN project LIKE '%7' THEN 'again' ELSE anno END AS anno, method, topn, 'm' AS tool, 'CALLABLE_RETURN,VARIABLE' AS removed, 'VARIABLE' AS inferred, project FROM r""")
def q74_output_by_project(spark, d):
    """Projects of even numbers are there first; then all are written, of which those are skipped, and at last some replace theirs."""
    root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    o, n = table(spark, d, "orders"), F.col("o_custkey") % 40
    name = F.concat(F.lit("x"), "o_orderkey")
    rows = o.select(
        F.concat(F.lit("f"), F.col("o_orderkey") % 5).alias("file"), F.lit("VARIABLE").alias("category"), name.alias("qname"), name.alias("qname_ssa"), F.col("o_orderstatus").alias("anno"),
        F.col("o_orderpriority").alias("method"), F.lit(1).alias("topn"), F.concat(F.lit("a."), n).alias("project"),
    )
    run = runs.of_run(rows, "m", ["VARIABLE", "CALLABLE_RETURN"], ["VARIABLE"])
    even = F.substring_index("project", ".", -1).cast("int") % 2 == 0
    runs.write_run(run.filter(even), root, runs.ERROR)
    runs.write_run(run.withColumn("anno", F.when(even, "lost").otherwise(F.col("anno"))), root, runs.SKIP)
    runs.write_run(run.filter(F.col("project").endswith("7")).withColumn("anno", F.lit("again")), root, runs.REPLACE)
    return runs.read_run(spark, root)


@query("""SELECT o_orderpriority AS method, 'f' AS file, 'x' || o_orderkey AS qname_ssa, o_orderstatus AS anno_gt, CASE WHEN o_orderkey % 3 > 0 THEN 'F' END AS anno_ta, CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS score,
0 AS loop, 1 AS reassigned, 0 AS nested, 1 AS builtin, 3 AS ctxt_category FROM orders""")
def q75_training_ledger(spark, d):
    """Three batches, each of which is appended twice."""
    root = f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    key = [F.lit("f").alias("file"), F.lit("VARIABLE").alias("category"), F.concat(F.lit("x"), "o_orderkey").alias("qname"), F.concat(F.lit("x"), "o_orderkey").alias("qname_ssa")]
    o = table(spark, d, "orders")
    truth = o.select(*key, F.col("o_orderstatus").alias("anno"))
    for k in (0, 1, 2, 1, 0, 2):
        flags = [F.lit(v).alias(c) for c, v in (("loop", 0), ("reassigned", 1), ("nested", 0), ("builtin", 1), ("ctxt_category", 3))]
        context = o.filter(F.col("o_orderkey") % 3 == k).select(*key, F.when(F.col("o_orderkey") % 3 > 0, "F").alias("anno"), F.col("o_orderpriority").alias("method"), *flags)
        runs.append_once(compare.training_rows(truth, context), root, f"part-{k}")
    return runs.training_set(spark, root)


@query("""SELECT 'p' || c_nationkey AS project, 'm/' || c_custkey || '.py' AS file, CASE c_custkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'error' ELSE 'warning' END AS level,
CASE c_custkey % 4 WHEN 0 THEN 'invalid syntax (<unknown>, line 2)' WHEN 1 THEN 'can''t read ' || c_name ELSE 'line 2: no symbol in a[' || c_custkey || '] = ''' || c_name || '''' END AS message FROM customer WHERE c_custkey % 4 < 3""")
def q76_messages(spark, d):
    """Extraction of files of which some can't be read, some aren't Python, and some bind what is no symbol; one pass writes symbols and messages."""
    k, name = F.col("c_custkey"), F.col("c_name")
    code = F.when(k % 4 == 0, "x = 1\ndef (").when(k % 4 == 2, F.concat(F.lit("x: int = 1\na["), k, F.lit("] = '"), name, F.lit("'\n"))).when(k % 4 == 3, "y = 2\n")
    files = table(spark, d, "customer").select(
        F.concat(F.lit("p"), "c_nationkey").alias("project"), F.concat(F.lit("m/"), k, F.lit(".py")).alias("file"), code.alias("code"), F.when(k % 4 == 1, F.concat(F.lit("can't read "), name)).alias("error")
    )
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    told = runs.write_logged(extract.logged_symbols(files), path, extract.SYMBOL_COLUMNS)
    found = runs.messages(spark, path)
    return found.filter(F.lit(told["failure"] + told["warning"]) > 0)
