"""Queries of conflict resolution over a hierarchy that is data, of resolvers, and of linearisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, resolve, resolvers
from ..session import table
from .registry import _LABELS, query
from .views import AGENTS, agents

#: Suppliers are below their nations, those below their regions: three levels of types under object.
_DEEP = """WITH t AS (SELECT l_orderkey AS k, CASE l_suppkey % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'dynamic' ELSE 'probabilistic' END AS agent,
  CASE l_partkey % 4 WHEN 0 THEN 's' || s_suppkey % 4 || '.' || n_nationkey WHEN 1 THEN 'n' || n_nationkey WHEN 2 THEN 'r' || n_regionkey END AS anno,
  CASE l_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS level, 'n' || n_nationkey AS n1, 'r' || n_regionkey AS r1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey % 4 < 3),
x AS (SELECT k, anno, level, min(n) AS n, min(CASE WHEN level > 2 THEN n1 END) AS n1, min(CASE WHEN level > 1 THEN r1 END) AS r1 FROM t GROUP BY k, anno, level),
s AS (SELECT x.*, (SELECT count(DISTINCT agent) FROM t WHERE t.k = x.k AND (t.anno = x.anno OR (t.level = 3 AND t.n1 = x.anno) OR (t.level > 1 AND t.r1 = x.anno))) AS ins FROM x),
p AS (SELECT a.k, a.anno, b.anno AS sub FROM s a JOIN s b ON a.k = b.k AND (b.n1 = a.anno OR b.r1 = a.anno)),
"""


def _deep_sql(rule: str) -> str:
    """Levels are labelled from the lowest on, for each target without it; l3, l2 and l1 hold (k, target, anno, label)."""
    label = lambda pro, con, ins: f"CAST({_LABELS[rule].format(pro=pro, con=con, direct=f'(2 * {ins} - 3)')} AS INT)"

    def level(n: int, below: str) -> str:
        done = f"""(SELECT d.k, d.target, p.anno, count(*) FILTER (d.label = 1) AS pro, count(*) FILTER (d.label = -1) AS con FROM ({below}) d JOIN p ON p.k = d.k AND p.sub = d.anno GROUP BY 1, 2, 3)"""
        return f"""l{n} AS (SELECT t.k, t.anno AS target, o.anno, {label('coalesce(g.pro, 0)', 'coalesce(g.con, 0)', 'o.ins')} AS label
  FROM s t JOIN s o ON t.k = o.k AND t.anno <> o.anno AND o.level = {n} LEFT JOIN {done} g ON g.k = t.k AND g.target = t.anno AND g.anno = o.anno)"""

    three = f"l3 AS (SELECT t.k, t.anno AS target, o.anno, {label('0', '0', 'o.ins')} AS label FROM s t JOIN s o ON t.k = o.k AND t.anno <> o.anno AND o.level = 3)"
    return _DEEP + f"""{three}, {level(2, 'SELECT * FROM l3')}, {level(1, 'SELECT * FROM l3 UNION ALL SELECT * FROM l2')},
l AS (SELECT l.*, p.sub IS NOT NULL AS below FROM (SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1) l LEFT JOIN p ON p.k = l.k AND p.anno = l.target AND p.sub = l.anno),
g AS (SELECT k, target, count(*) FILTER (label = CASE WHEN below THEN 1 ELSE -1 END) AS pro, count(*) FILTER (label = CASE WHEN below THEN -1 ELSE 1 END) AS con FROM l GROUP BY 1, 2),
c AS (SELECT s.*, {label('coalesce(g.pro, 0)', 'coalesce(g.con, 0)', 's.ins')} AS label FROM s LEFT JOIN g ON g.k = s.k AND g.target = s.anno),
w AS (SELECT * FROM (SELECT *, max(ins) OVER (PARTITION BY k) AS most FROM c WHERE label = 1) WHERE ins = most),
v AS (SELECT k, string_agg(anno, ' | ' ORDER BY n) AS anno FROM w GROUP BY k),
m AS (SELECT t.k, string_agg(DISTINCT agent, '+' ORDER BY agent) AS method FROM t LEFT JOIN v ON v.k = t.k WHERE v.k IS NULL OR EXISTS (SELECT 1 FROM w WHERE w.k = t.k AND w.anno = t.anno) GROUP BY t.k)
SELECT m.k, v.anno, m.method, 1 AS topn FROM m LEFT JOIN v ON v.k = m.k"""


def _deep(rule: str):
    def run(spark, d):
        s, n, i = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "lineitem")
        places = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
            "s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey") % 4, F.lit("."), "n_nationkey").alias("s"), F.concat(F.lit("n"), "n_nationkey").alias("n"), F.concat(F.lit("r"), "n_regionkey").alias("r")
        )
        chain = F.array("s", "n", "r", F.lit(hierarchy.OBJECT))
        one = places.select(F.explode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.slice(chain, k + 1, 4))).alias("up"))
        types = one.select(F.col("up")[0].alias("derived"), F.posexplode("up").alias("place", "base")).distinct()
        kind = F.col("l_partkey") % 4
        anno = F.when(kind == 0, F.col("s")).when(kind == 1, F.col("n")).when(kind == 2, F.col("r"))
        agent = F.col("l_suppkey") % 3
        said = i.join(places, i["l_suppkey"] == places["s_suppkey"]).select(
            F.col("l_orderkey").alias("k"), F.when(agent == 0, "static").when(agent == 1, "dynamic").otherwise("probabilistic").alias("agent"), anno.alias("anno"), "l_linenumber", "l_partkey", "l_suppkey"
        )
        return resolve.voting(said, types, "l_linenumber", "l_partkey", "l_suppkey", keys=["k"], rule=rule).select("k", "anno", "method", "topn")

    run.__name__ = f"q70_deep_voting_{rule.lower()}"
    return run


for _rule in ("SF", "CF"):
    query(_deep_sql(_rule))(_deep(_rule))


@query("""WITH s AS (SELECT 's' || s_suppkey AS d, s_nationkey AS n, (s_nationkey + s_suppkey) % 25 AS m FROM supplier),
r AS (SELECT s.*, a.n_regionkey AS rn, b.n_regionkey AS rm FROM s JOIN nation a ON a.n_nationkey = n JOIN nation b ON b.n_nationkey = m),
l AS (SELECT d, CASE WHEN n = m THEN [d, 'n' || n, 'r' || rn, 'builtins.object'] WHEN rn = rm THEN [d, 'n' || n, 'n' || m, 'r' || rn, 'builtins.object'] ELSE [d, 'n' || n, 'r' || rn, 'n' || m, 'r' || rm, 'builtins.object'] END AS up FROM r
UNION ALL SELECT 'n' || n_nationkey, ['n' || n_nationkey, 'r' || n_regionkey, 'builtins.object'] FROM nation UNION ALL SELECT 'r' || r_regionkey, ['r' || r_regionkey, 'builtins.object'] FROM region)
SELECT d AS derived, up[i] AS base, (i - 1)::INT AS place FROM l, (SELECT unnest(range(1, 7)) AS i) WHERE i <= len(up)""")
def q71_linearisation(spark, d):
    """Suppliers inherit from two nations, which may share their region: diamonds."""
    first, second = F.col("s_nationkey"), (F.col("s_nationkey") + F.col("s_suppkey")) % 25
    named = lambda c: F.concat(F.lit("n"), c.cast("string"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("cls"), F.array_distinct(F.array(named(first), named(second))).alias("bases"))
    n = table(spark, d, "nation").select(named(F.col("n_nationkey")).alias("cls"), F.array(F.concat(F.lit("r"), "n_regionkey")).alias("bases"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("cls"), F.expr("cast(array() as array<string>)").alias("bases"))
    return hierarchy.linearised(s.unionByName(n).unionByName(r)).select("derived", "base", "place")


@query(f"""WITH {AGENTS}, b AS (SELECT k, agent, anno, row_number() OVER (PARTITION BY k, agent ORDER BY topn, p, s) AS n FROM agents WHERE anno IS NOT NULL),
g AS (SELECT k, count(*) AS votes, count(DISTINCT anno) AS kinds, min(anno) AS anno, string_agg(agent, '+' ORDER BY CASE agent WHEN 'static' THEN 0 WHEN 'dynamic' THEN 1 ELSE 2 END) AS method FROM b WHERE n = 1 GROUP BY k),
e AS (SELECT k, string_agg(agent, '+' ORDER BY CASE agent WHEN 'static' THEN 0 WHEN 'dynamic' THEN 1 ELSE 2 END) AS method FROM (SELECT DISTINCT k, agent FROM agents) GROUP BY k)
SELECT o_orderkey AS k, CASE WHEN votes > 1 AND kinds = 1 THEN g.anno END AS anno, coalesce(CASE WHEN votes > 1 AND kinds = 1 THEN g.method END, e.method, '') AS method
FROM orders LEFT JOIN g ON g.k = o_orderkey LEFT JOIN e ON e.k = o_orderkey""")
def q72_symbol_resolver(spark, d):
    said = agents(spark, d).withColumn("method", F.col("agent"))
    return resolvers.by_symbol(resolvers.Agreement(), said, table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), ties=("p", "s"), keys=["k"])


class _Longest:
    """A resolver of tables for the query below: the first of the static annotations by name, of symbols that have one."""

    def forward(self, agents):
        found = agents["static"].filter("anno is not null")
        return found.groupBy("k").agg(F.min("anno").alias("anno")).withColumn("method", F.lit("longest"))


@query(f"""WITH {AGENTS} SELECT o_orderkey AS k, min(CASE WHEN agent = 'static' THEN anno END) AS anno, CASE WHEN min(CASE WHEN agent = 'static' THEN anno END) IS NULL THEN 'static+dynamic' ELSE 'longest' END AS method
FROM orders LEFT JOIN agents ON k = o_orderkey GROUP BY 1""")
def q73_table_resolver(spark, d):
    said = agents(spark, d).withColumn("method", F.col("agent"))
    own = {a: said.filter(F.col("agent") == a).drop("agent") for a in ("static", "dynamic")}
    return resolvers.by_table(_Longest(), own, table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), keys=["k"])
