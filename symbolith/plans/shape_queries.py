"""Queries of scalar functions, row filters, matches and unions, and of all forms of hints. Inputs are written from key columns, and the
SQL states results by the same keys, not by the patterns that the functions use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align, compare, documents, extract, resolve, select
from ..session import table
from ..sources import scans, sinks
from .registry import query
from .source_queries import _LARGE, _programs
from .views import AGENTS, BASE, PRED, agents, base, pred

def _k():
    return F.col("o_orderkey")


def _file(key: str):
    return F.concat(F.lit("c"), F.col(key).cast("string"), F.lit(".py"))


@query("""SELECT o_orderkey, repeat('.', cast(o_orderkey % 3 AS bigint)) || CASE WHEN o_orderkey % 2 = 0 THEN 'pkg.sub' ELSE '' END AS module, o_orderstatus AS target,
CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus ELSE 'f.' || o_orderstatus END AS inner_name, 'g.' || o_orderstatus AS full_name, CASE WHEN o_orderkey % 2 = 0 THEN 'a.py/b.pyi' ELSE 'a.py/b.txt' END AS stub FROM orders""")
def q52_name_parts(spark, d):
    name = F.concat(F.repeat(F.lit("."), (_k() % 3).cast("int")), F.when(_k() % 2 == 0, "pkg.sub.").otherwise(""), "o_orderstatus")
    scope = F.when(_k() % 4 == 0, "").when(_k() % 4 == 1, "f").when(_k() % 4 == 2, "e.f").otherwise("ff")
    parts = S.module_and_target(name)
    return table(spark, d, "orders").select(
        "o_orderkey", parts["module"].alias("module"), parts["target"].alias("target"), S.within_scope(scope, F.concat(F.lit("f."), "o_orderstatus")).alias("inner_name"),
        S.qualified(F.lit("g"), F.col("o_orderstatus")).alias("full_name"), S.stub_path(F.when(_k() % 2 == 0, "a.py/b.py").otherwise("a.py/b.txt")).alias("stub"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN '.a' ELSE 'text' END AS picked, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 4 = 0 THEN '.a' WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 1 THEN o_orderstatus
WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 = 1 THEN '.c' END AS nth, CASE WHEN o_orderkey % 3 < 2 THEN '.a' ELSE '-' END AS first_or, 'm+' || o_orderstatus AS methods FROM orders""")
def q53_candidates(spark, d):
    found = F.when(_k() % 3 == 0, F.array(F.lit(".a"), "o_orderstatus")).when(_k() % 3 == 1, F.array(F.lit(".a"), F.lit(".c"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select(
        "o_orderkey", S.pick_qualified(found, F.lit("text")).alias("picked"), S.nth(found, (_k() % 4).cast("int")).alias("nth"), S.nth(found, 0, "-").alias("first_or"),
        S.joined_methods(F.array(F.lit("m"), "o_orderstatus")).alias("methods"),
    )


@query("""SELECT o_orderkey, o_orderstatus || ' x' AS args, 'y +  ' || o_orderstatus AS returned, CASE o_orderkey % 3 WHEN 0 THEN 'typing.Any' WHEN 1 THEN 'typing.Any' ELSE o_orderstatus END AS anno,
CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS named, CASE WHEN o_orderkey % 2 = 0 THEN 'a,' || o_orderstatus END AS listed, round(exp(-cast(o_orderkey % 8 AS double)), 6) AS p FROM orders""")
def q54_texts_of_functions(spark, d):
    one = F.col("o_orderstatus")
    listed = F.when(_k() % 2 == 0, F.concat(F.lit("['a', \""), one, F.lit('"]'))).otherwise("not a list")
    return table(spark, d, "orders").select(
        "o_orderkey", S.arguments_text(F.array(F.lit("self"), one, F.lit("x"))).alias("args"), S.returns_text(F.array(F.lit("self.y + self"), one)).alias("returned"),
        S.known_or_any(F.when(_k() % 3 == 0, "%UNK%").when(_k() % 3 == 1, "%UNKNOWN%").otherwise(one)).alias("anno"), S.other_to_null(F.when(_k() % 2 == 0, one).otherwise("other")).alias("named"),
        F.array_join(documents.string_list(listed), ",").alias("listed"), F.round(S.probability(-(_k() % 8).cast("double")), 6).alias("p"),
    )


@query("""SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber % 3 > 0 GROUP BY 1, 2""")
def q55_usable_returns(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "None").when(F.col("l_returnflag") == "A", "Any").otherwise("int")
    n = F.col("l_linenumber") % 3
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", kind.alias("return_type"), F.array_repeat(F.lit("x"), n.cast("int")).alias("return_expr"))
    return select.with_hints(select.usable_returns(rows), "return_expr").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))


@query("""SELECT '/c' || cast(o_custkey AS varchar) || '.py' AS provenance, string_agg(cast(o_orderkey AS varchar), ',' ORDER BY o_orderkey) AS orders
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) GROUP BY 1""")
def q56_provenance(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/"), _file("o_custkey")).alias("provenance"))
    files = table(spark, d, "customer").filter("c_nationkey < 10").select(_file("c_custkey").alias("file"))
    grouped = documents.by_provenance(select.from_files(rows, files))
    return grouped.select("provenance", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("orders"))


@query("""SELECT o_orderkey, cast(l_linenumber AS varchar) || '/' || cast(l_partkey AS varchar) AS first FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_linestatus = 'F') l
ON o_orderkey = l_orderkey AND n = 1""")
def q57_first_match(spark, d):
    right = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    found = align.first_match(table(spark, d, "orders").select("o_orderkey"), right, ["o_orderkey"], "l_linenumber", "l_partkey", "l_suppkey")
    return found.select("o_orderkey", F.concat(F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("first"))


@query("SELECT l_orderkey, l_returnflag, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q58_conflicting_keys(spark, d):
    return select.conflicts(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey", "l_returnflag"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = l_linestatus THEN 1 ELSE 2 END AS n_values FROM lineitem")
def q59_values_of_a_row(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return compare.single_values(rows, ["l_returnflag", "l_linestatus"]).drop("l_returnflag", "l_linestatus")


@query(f"""WITH {BASE}, {PRED}, u AS (SELECT file, category, qname, qname_ssa, anno FROM base UNION ALL SELECT file, category, qname, qname_ssa, anno FROM pred)
SELECT category, anno, count(*) AS n FROM u WHERE anno IS NULL OR anno <> 'N' GROUP BY 1, 2""")
def q60_updated_collection(spark, d):
    every = sinks.updated(base(spark, d), pred(spark, d))
    return documents.without_ignored(every, lambda a: a == "N", "anno").groupBy("category", "anno").agg(F.count("*").alias("n"))


@query(f"""WITH {AGENTS} SELECT o_orderkey AS k, CASE WHEN t.k IS NULL THEN NULL ELSE t.anno END AS anno, CASE WHEN t.k IS NULL THEN 'static' WHEN t.anno IS NULL THEN 'static' ELSE t.agent END AS method
FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY anno IS NULL, topn, p, s) AS n FROM agents WHERE agent = 'static') t ON o_orderkey = t.k AND t.n = 1""")
def q61_restored_symbols(spark, d):
    best = resolve.delegation(agents(spark, d).filter("agent = 'static'"), "topn", "p", "s", keys=["k"])
    return resolve.restored(best, table(spark, d, "orders").select(_k().alias("k")), ["k"], "static")


#: Every form in which a name can get a hint, and one that gives no row.
_FORMS = (
    "class K:\n    a: int\n    b = ...\n    c: str = ''\nd: bytes\nd, e = b'', 1\nf: int = NAME\ng = f\ng += 1\nfor h in ():\n    pass\nwith open('x') as i:\n    i.j = 2\n"
    "def m(self):\n    self.k: float = 1.0\n    self.k, n = 2.0, 3\n"
)
_FOUND = [
    ("K.aλ1", "builtins.int"), ("K.bλ1", None), ("K.cλ1", "builtins.str"), ("dλ1", "builtins.bytes"), ("eλ1", None), ("fλ1", "builtins.int"), ("gλ1", None), ("gλ2", None), ("hλ1", None),
    ("iλ1", None), ("m.self.kλ1", "builtins.float"), ("m.self.kλ2", None), ("m.nλ1", None),
]


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


@query(f"SELECT 'c' || cast(c_custkey AS varchar) || '.py' AS file, qname_ssa, anno FROM customer, (VALUES {_values(_FOUND)}) v(qname_ssa, anno)")
def q62_hint_forms(spark, d):
    return extract.annotated_symbols(_programs(spark, d, _FORMS)).filter("category = 'VARIABLE'").select("file", "qname_ssa", "anno")


#: nested, branching and loop of the larger program's names; NAME stands in the class's own.
_FLAGS = [
    ("C.run", 0, 0), ("C.run.self", 0, 0), ("C.run.path", 0, 0), ("C.run.deep", 0, 0), ("C.run.inner", 1, 0), ("C.run.inner.x", 1, 0), ("C.sizeλ1", 0, 0), ("C.run.aλ1", 0, 1), ("C.run.bλ1", 0, 1),
    ("C.run.fλ1", 0, 0), ("C.run.self.textλ1", 0, 0),
]


@query(f"""SELECT 'c' || cast(c_custkey AS varchar) || '.py' AS file, 'C' || cast(c_custkey AS varchar) || substr(q, 2) AS qname_ssa, nested, branching FROM customer, (VALUES {_values(_FLAGS)}) v(q, nested, branching)""")
def q63_nested_and_branching(spark, d):
    return extract.context_vectors(_programs(spark, d, _LARGE)).select("file", "qname_ssa", "nested", "branching")


@query("""SELECT 'a' || cast(o_custkey % 7 AS varchar) AS author, 'p' || cast(o_custkey AS varchar) AS project, count(DISTINCT o_orderkey) AS files FROM orders WHERE o_custkey % 7 > 0 GROUP BY 1, 2""")
def q64_projects(spark, d):
    author = F.when(F.col("o_custkey") % 7 == 0, ".git").otherwise(F.concat(F.lit("a"), (F.col("o_custkey") % 7).cast("string")))
    path = F.concat_ws("/", author, F.concat(F.lit("p"), F.col("o_custkey").cast("string")), F.lit("src"), F.concat(_k().cast("string"), F.lit(".py")))
    return scans.projects(table(spark, d, "orders").select(path.alias("file"))).select("author", "project", F.size("files").cast("long").alias("files"))


@query("""SELECT o_orderkey, 'a' || cast(o_custkey AS varchar) AS author, 'r' || o_orderstatus AS repo FROM orders""")
def q65_author_and_repo(spark, d):
    key = scans.author_and_repo(F.concat(F.lit("a"), F.col("o_custkey").cast("string"), F.lit("__r"), F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", key["author"].alias("author"), key["repo"].alias("repo"))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS count FROM orders GROUP BY 1")
def q66_tallies(spark, d):
    return sinks.tallies(table(spark, d, "orders").select(F.when(_k() % 5 == 0, "broken").alias("error")))
