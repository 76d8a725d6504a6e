"""Symbol-shaped views of the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def _key(orderkey: str) -> list:
    k = F.pmod(F.col(orderkey), F.lit(3))
    name = F.concat(F.lit("s"), F.col(orderkey).cast("string"))
    return [
        F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string"), F.lit(".py")).alias("file"),
        F.when(k == 0, "VARIABLE").when(k == 1, "CALLABLE_RETURN").otherwise("CALLABLE_PARAMETER").alias("category"),
        name.alias("qname"), name.alias("qname_ssa"),
    ]


def base(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.col("o_orderstatus")
    file, category, *names = _key("o_orderkey")
    other = F.when(F.col("o_orderkey") % 7 == 0, "t").otherwise("")  # every seventh symbol has a name that nothing predicts
    names = [F.concat(other, n).alias(k) for n, k in zip(names, ("qname", "qname_ssa"), strict=True)]
    return o.select(file, category, *names, F.when(status == "F", "A").when(status == "O", "N").alias("anno"), F.col("o_orderkey").alias("ord"))


def pred(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_discount")  # noqa: E741
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *_key("l_orderkey"), F.when(F.col("l_discount") > 0.02, F.col("l_returnflag")).alias("anno"),
        F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("topn"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
    )


def agents(spark: SparkSession, d: str) -> DataFrame:
    a, t = F.col("l_suppkey") % 3, F.col("l_partkey") % 5
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.when(a == 0, "static").when(a == 1, "dynamic").otherwise("probabilistic").alias("agent"),
        F.when(t == 0, "bool").when(t == 1, "int").when(t == 2, "str").when(t == 3, "float").alias("anno"),
        F.col("l_linenumber").alias("topn"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
    )


_KEY_SQL = """'c' || cast({c} % 50 as varchar) || '.py' AS file,
  CASE {o} % 3 WHEN 0 THEN 'VARIABLE' WHEN 1 THEN 'CALLABLE_RETURN' ELSE 'CALLABLE_PARAMETER' END AS category,
  's' || cast({o} as varchar) AS qname, 's' || cast({o} as varchar) AS qname_ssa"""

BASE = f"""base AS (SELECT file, category, other || qname AS qname, other || qname_ssa AS qname_ssa, anno, ord FROM (SELECT {_KEY_SQL.format(c='o_custkey', o='o_orderkey')},
  CASE WHEN o_orderkey % 7 = 0 THEN 't' ELSE '' END AS other, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' END AS anno, o_orderkey AS ord FROM orders))"""
PRED = f"""pred AS (SELECT {_KEY_SQL.format(c='o_custkey', o='l_orderkey')},
  CASE WHEN l_discount > 0.02 THEN l_returnflag END AS anno, l_linestatus AS method, l_linenumber AS topn, l_partkey AS p, l_suppkey AS s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
AGENTS = """agents AS (SELECT l_orderkey AS k, CASE l_suppkey % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'dynamic' ELSE 'probabilistic' END AS agent,
  CASE l_partkey % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' WHEN 2 THEN 'str' WHEN 3 THEN 'float' END AS anno,
  l_linenumber AS topn, l_partkey AS p, l_suppkey AS s FROM lineitem)"""
TOP = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, category, qname_ssa ORDER BY topn, p, s) AS n FROM pred) WHERE n = 1)"""
