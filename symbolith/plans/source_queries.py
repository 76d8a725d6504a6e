"""Queries of the source-tree operators, over small programs written from the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, extract, functions, predict, renaming, rewrite
from ..session import table
from .registry import query

_TYPE = "CASE c_nationkey % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'str' ELSE 'bytes' END"
_ROWS = f"""r AS (SELECT 'c' || cast(c_custkey AS varchar) || '.py' AS file, {_TYPE} AS t, 'f' || cast(c_custkey AS varchar) AS f FROM customer),
s AS (SELECT file, 'CALLABLE_RETURN' AS category, f AS qname, f AS qname_ssa, 'builtins.' || t AS anno FROM r
UNION ALL SELECT file, 'CALLABLE_PARAMETER', f || '.a', f || '.a', 'builtins.int' FROM r UNION ALL SELECT file, 'CALLABLE_PARAMETER', f || '.b', f || '.b', NULL FROM r
UNION ALL SELECT file, 'VARIABLE', f || '.v', f || '.vλ1', 'builtins.' || t FROM r UNION ALL SELECT file, 'VARIABLE', f || '.v', f || '.vλ2', NULL FROM r)"""
_CODE = "'def ' || f || '(a: int, b) -> ' || t || ':' || chr(10) || '    v: ' || t || ' = a' || chr(10) || '    for _ in b:' || chr(10) || '        v = 2' || chr(10)"
_BARE = "'def ' || f || '(a, b):' || chr(10) || '    v = a' || chr(10) || '    for _ in b:' || chr(10) || '        v = 2' || chr(10)"


def _tree(files: DataFrame) -> DataFrame:
    """Files in several partitions, as a scan of a source tree has them: the table they are made from is one small file."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism)


def programs(spark, d) -> DataFrame:
    n = F.col("c_nationkey") % 3
    t = F.when(n == 0, "int").when(n == 1, "str").otherwise("bytes")
    key = F.col("c_custkey").cast("string")
    code = F.concat(F.lit("def f"), key, F.lit("(a: int, b) -> "), t, F.lit(":\n    v: "), t, F.lit(" = a\n    for _ in b:\n        v = 2\n"))
    return _tree(table(spark, d, "customer").select(F.concat(F.lit("c"), key, F.lit(".py")).alias("file"), code.alias("code")))


@query(f"WITH {_ROWS} SELECT * FROM s UNION ALL SELECT file, 'VARIABLE', f || '._', f || '._λ1', NULL FROM r")
def q33_extraction(spark, d):
    return extract.annotated_symbols(programs(spark, d)).drop("ord")


@query(f"""WITH {_ROWS} SELECT file, qname_ssa, CASE WHEN right(qname_ssa, 2) = 'λ2' THEN 1 ELSE 0 END AS loop, CASE WHEN right(qname_ssa, 2) = 'λ2' THEN 1 ELSE 0 END AS reassigned, 0 AS nested,
CASE WHEN anno IS NULL THEN 0 ELSE 1 END AS builtin, 0 AS branching, CASE category WHEN 'VARIABLE' THEN 3 WHEN 'CALLABLE_PARAMETER' THEN 2 ELSE 1 END AS ctxt_category FROM s
UNION ALL SELECT file, f || '._λ1', 1, 0, 0, 0, 0, 3 FROM r""")
def q34_context_vectors(spark, d):
    return extract.context_vectors(programs(spark, d)).select("file", "qname_ssa", "loop", "reassigned", "nested", "builtin", "branching", "ctxt_category")


@query(f"WITH {_ROWS} SELECT file, {_BARE} AS code FROM r")
def q35_strip(spark, d):
    return rewrite.strip_sources(programs(spark, d)).select("file", "code")


@query(f"WITH {_ROWS} SELECT file, 'from __future__ import annotations' || chr(10) || {_CODE} AS code FROM r")
def q36_apply(spark, d):
    code = programs(spark, d)
    return rewrite.apply_predictions(rewrite.strip_sources(code), extract.annotated_symbols(code)).select("file", "code")


@query(f"""WITH {_ROWS} SELECT file, '--- ' || file || chr(10) || '+++ ' || file || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || '-def ' || f || '(a: int, b) -> ' || t || ':' || chr(10) || '-    v: ' || t || ' = a' || chr(10)
|| '+def ' || f || '(a, b):' || chr(10) || '+    v = a' || chr(10) || '     for _ in b:' || chr(10) AS code FROM r""")
def q37_diff(spark, d):
    code = programs(spark, d)
    return rewrite.source_diff(code, rewrite.strip_sources(code)).select("file", "code")


@query(f"WITH {_ROWS} SELECT file, category, qname, qname_ssa, anno, 'declared' AS method, 1 AS topn FROM (SELECT * FROM s UNION ALL SELECT file, 'VARIABLE', f || '._', f || '._λ1', NULL FROM r)")
def q38_declared_predictor(spark, d):
    code = programs(spark, d)
    return predict.factory("declared")(code).predict(rewrite.strip_sources(code))


@query("""SELECT cast(conv_id AS varchar) AS file, turn AS ord, role AS name, CASE WHEN role <> 'system' THEN role || cast(turn AS varchar) END AS anno FROM conversations""")
def q39_cursor_match(spark, d):
    slots = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("ord"), F.col("role").alias("name"))
    # of system there is no prediction: its slots get none and leave the cursor where it is
    return align.cursor_match(slots, slots.filter("name <> 'system'").withColumn("anno", F.concat("name", F.col("ord").cast("string"))))


@query("""WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
SELECT cast(a.conv_id AS varchar) AS file, a.turn AS ord, a.role AS qname, a.n, CASE WHEN b.conv_id IS NOT NULL THEN 't' || cast(b.turn AS varchar) END AS anno
FROM n a LEFT JOIN (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE turn > 1) b ON a.conv_id = b.conv_id AND a.role = b.role AND a.n = b.n""")
def q40_nth_occurrence(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("ord"), F.col("role").alias("qname"))
    annos = rows.filter("ord > 1").withColumn("anno", F.concat(F.lit("t"), F.col("ord").cast("string")))
    return align.nth_with_nth(rows, annos).select("file", "ord", "qname", "n", "anno")


#: A program with an import, a class, a method, a function inside it, a branch, a with and a tuple; NAME is the customer's number.
_LARGE = (
    "import os\nclass CNAME:\n    size = NAME\n    def run(self, path, *rest, deep=False):\n        def inner(x):\n            return x\n        if deep:\n            a, b = inner(1), 2\n"
    "        with open(path) as f:\n            self.text = f.read()\n        return os.fspath(path)\n"
)
_SIZED = _LARGE.replace("size = NAME", "size: int = NAME").replace("inner(x):", "inner(x: amod.TNAME):").replace("deep=False):", "deep: bool=False) -> os.PathLike:").replace("            a, b =", "            a: int; a, b =")
_STUB = "from typing import Sequence, Mapping\nclass CNAME:\n    size: int\n    def run(self, path: Sequence[str], *rest, deep: bool) -> str: ...\n    def other(self) -> Mapping: ...\n"
_STUBBED = "from __future__ import annotations\nfrom typing import Sequence\n" + _LARGE.replace("size = NAME", "size: int = NAME").replace("path, *rest, deep=False):", "path: Sequence[str], *rest, deep: bool=False) -> str:")


def _filled(text: str):
    return F.replace(F.lit(text), F.lit("NAME"), F.col("c_custkey").cast("string"))


def _filled_sql(text: str) -> str:
    return "replace('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "', 'NAME', cast(c_custkey AS varchar))"


def _programs(spark, d, text: str) -> DataFrame:
    return _tree(table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("file"), _filled(text).alias("code")))


@query(f"SELECT 'c' || cast(c_custkey AS varchar) || '.py' AS file, {_filled_sql('from __future__ import annotations' + chr(10) + 'import amod' + chr(10) + _SIZED)} AS code FROM customer")
def q41_apply_with_imports(spark, d):
    code = _programs(spark, d, _LARGE)
    annos = [("VARIABLE", "CNAME.sizeλ1", "builtins.int"), ("CALLABLE_RETURN", "CNAME.run", "os.PathLike"), ("CALLABLE_PARAMETER", "CNAME.run.deep", "builtins.bool"), ("CALLABLE_PARAMETER", "CNAME.run.inner.x", "amod.TNAME"), ("VARIABLE", "CNAME.run.aλ1", "builtins.int")]
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), _filled(q).alias("qname_ssa"), _filled(a).alias("anno")) for c, q, a in annos))).alias("a")
    best = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("file"), one).select("file", "a.*")
    return rewrite.apply_predictions(code, best).select("file", "code")


@query(f"SELECT 'c' || cast(c_custkey AS varchar) || '.py' AS file, {_filled_sql(_STUBBED)} AS code FROM customer")
def q42_apply_stubs(spark, d):
    stubs = _programs(spark, d, _STUB).withColumn("file", F.concat("file", F.lit("i")))
    return rewrite.apply_stubs(_programs(spark, d, _LARGE), stubs).select("file", "code")


@query("""SELECT 'c' || cast(c_custkey AS varchar) || '.py' AS file, f.* FROM (SELECT unnest([
{'cls_name': 'C', 'func_name': 'run', 'arg_names': 'self,path,deep', 'n_types': 0, 'returned': 'os.fspath(path)', 'ord': 0},
{'cls_name': NULL, 'func_name': 'inner', 'arg_names': 'x', 'n_types': 1, 'returned': 'x', 'ord': 1}]) AS f), customer""")
def q43_function_frame(spark, d):
    found = functions.function_frame(_programs(spark, d, _LARGE.replace("inner(x)", "inner(x: int)")))
    return found.select(
        "file", F.substring("cls_name", 1, 1).alias("cls_name"), "func_name", F.array_join("arg_names", ",").alias("arg_names"),
        F.size(F.array_compact("arg_types")).alias("n_types"), F.array_join("return_expr", ",").alias("returned"), "ord",
    )


@query(f"""WITH t AS (SELECT unnest([{{'c': 'VARIABLE', 'q': 'C.size', 'l': 3}}, {{'c': 'CALLABLE_RETURN', 'q': 'C.run', 'l': 4}}, {{'c': 'CALLABLE_PARAMETER', 'q': 'C.run.self', 'l': 4}}, {{'c': 'CALLABLE_PARAMETER', 'q': 'C.run.path', 'l': 4}},
{{'c': 'CALLABLE_PARAMETER', 'q': 'C.run.rest', 'l': 4}}, {{'c': 'CALLABLE_PARAMETER', 'q': 'C.run.deep', 'l': 4}}, {{'c': 'CALLABLE_RETURN', 'q': 'C.run.inner', 'l': 5}}, {{'c': 'CALLABLE_PARAMETER', 'q': 'C.run.inner.x', 'l': 5}},
{{'c': 'VARIABLE', 'q': 'C.run.a', 'l': 8}}, {{'c': 'VARIABLE', 'q': 'C.run.b', 'l': 8}}, {{'c': 'VARIABLE', 'q': 'C.run.f', 'l': 9}}, {{'c': 'VARIABLE', 'q': 'C.run.self.text', 'l': 10}}]) AS t)
SELECT 'c' || cast(c_custkey AS varchar) || '.py' AS file, t.c AS category, replace(t.q, 'C.', 'C' || cast(c_custkey AS varchar) || '.') AS qname, CASE WHEN t.l = 4 AND t.q LIKE '%.rest' THEN 'tuple' END AS anno FROM t, customer""")
def q44_typed_nodes(spark, d):
    code = _programs(spark, d, _LARGE)
    nodes = functions.node_frame(code)
    types = code.select("file", F.lit(4).cast("long").alias("line"), F.lit(_LARGE.split("\n")[3].index("rest")).cast("long").alias("col"), F.lit("tuple").alias("anno"))
    return functions.typed_nodes(nodes, types).drop("ord")


_NUMBERED = _LARGE.replace("size =", "sizeλ1 =").replace("a, b =", "aλ1, bλ1 =").replace("as f:", "as fλ1:").replace("self.text =", "self.textλ1 =")


@query(f"SELECT 'c' || cast(c_custkey AS varchar) || '.py' AS file, {_filled_sql(_NUMBERED)} AS code FROM customer")
def q48_numbered_names(spark, d):
    return renaming.numbered_sources(_programs(spark, d, _LARGE)).select("file", "code")


#: A hint that two branches and a loop are under, one of them with a hint of its own.
_HINTED = "v: int\nif NAME:\n    v = 1\nelse:\n    v: str = '2'\n    v = '3'\nfor v in ():\n    v += NAME\n"
_LOWERED = _HINTED.replace("    v = 1", f"    v: int = {renaming.MARKER}; v = 1").replace("    v +=", f"    v: int = {renaming.MARKER}; v +=")


@query(f"SELECT 'c' || cast(c_custkey AS varchar) || '.py' AS file, {_filled_sql(_LOWERED)} AS code, {_filled_sql(_HINTED)} AS back FROM customer")
def q49_lowered_hints(spark, d):
    there = renaming.lowered_sources(_programs(spark, d, _HINTED))
    back = renaming.plain_sources(renaming.unlowered_sources(renaming.numbered_sources(there)))
    return there.select("file", "code").join(back.select("file", F.col("code").alias("back")).hint("merge"), "file")


def _argument_types(file: str, code: str):
    """A tool for the query below: a parameter without a default is an int. It fails on files whose number ends in 7."""
    import ast

    if file.endswith("7.py"):
        raise ValueError(file)
    for node in ast.walk(ast.parse(code)):
        if isinstance(node, ast.FunctionDef):
            for p in node.args.args:
                yield "CALLABLE_PARAMETER", f"{node.name}.{p.arg}", f"{node.name}.{p.arg}", "int", 1


@query("""SELECT 'c' || k || '.py' AS file, CASE WHEN k LIKE '%7' THEN NULL ELSE 'f' || k || '.' || p END AS qname, CASE WHEN k LIKE '%7' THEN 'ValueError: c' || k || '.py' END AS error
FROM (SELECT cast(c_custkey AS varchar) AS k FROM customer), (SELECT unnest(['a', 'b']) AS p) WHERE NOT (k LIKE '%7' AND p = 'b')""")
def q50_inference_per_file(spark, d):
    return predict.per_file(programs(spark, d), _argument_types, "ints").select("file", "qname", "error")
