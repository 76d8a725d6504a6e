"""Conflict resolution between predictors: delegation by priority, and voting over the subtype relation.

Agents are rows of one table (keys, agent, anno, topn, order), so alignment needs one shuffle by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SELECT_KEY
from .hierarchy import OBJECT, up_lists

#: Types of a dict of ancestors that are sent to all tasks; more are joined.
SMALL = 10_000
STATIC, DYNAMIC, PROBABILISTIC = "static", "dynamic", "probabilistic"
DEFAULT_ORDER = (STATIC, DYNAMIC, PROBABILISTIC)


def _rank(order: tuple[str, ...]) -> Column:
    rank = F.lit(len(order))
    for k, agent in enumerate(order):
        rank = F.when(F.col("agent") == agent, k).otherwise(rank)
    return rank


def delegation(predictions: DataFrame, *ties, order: tuple[str, ...] = DEFAULT_ORDER, keys: list[str] = SELECT_KEY, methods: Column | None = None) -> DataFrame:
    """Per symbol the annotation of the first agent in order that has one; symbols with nulls only stay, unresolved, with
    the agents that have any row joined by + as their method. One shuffle, and beside it one row that says which agents there are, of the
    agents' column alone."""
    said = predictions.filter(F.col("agent").isin(*order))
    w = Window.partitionBy(*keys).orderBy(F.col("anno").isNull(), _rank(order), *ties)
    best = said.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    if methods is None:
        there = said.agg(*(F.max(F.col("agent") == a).alias(f"__a{k}") for k, a in enumerate(order)))
        best = best.crossJoin(F.broadcast(there))  # one row
        methods = F.concat_ws("+", *(F.when(F.col(f"__a{k}"), a) for k, a in enumerate(order)))
    return best.withColumn("method", F.when(F.col("anno").isNull(), methods).otherwise(F.col("agent"))).select(*keys, "anno", "method")


def restored(resolved: DataFrame, reference: DataFrame, keys: list[str] = SELECT_KEY, method: str = "") -> DataFrame:
    """All symbols of reference; those that resolved lacks get no annotation and the given method."""
    return reference.select(*keys).distinct().join(resolved, keys, "left").withColumn("method", F.coalesce("method", F.lit(method)))


def closure(spark, edges: dict[str, list[str]]) -> dict[str, list[str]]:
    """Per type its ancestors, itself first, along declared parents; `object` is the last of all. A declared hierarchy is small:
    it is code, not data."""
    del spark
    out: dict[str, list[str]] = {}

    def of(t: str, seen: tuple[str, ...] = ()) -> list[str]:
        if t in seen:
            raise ValueError(f"{t} is its own ancestor")
        if t not in out:
            found = [t]
            for parent in edges.get(t, []):
                found += [a for a in of(parent, (*seen, t)) if a not in found and a != "object"]
            out[t] = found + (["object"] if t != "object" else [])
        return out[t]

    for t in [*edges, *(p for ps in edges.values() for p in ps)]:
        of(t)
    return out


def subtype_closure(edges: DataFrame) -> DataFrame:
    """The reflexive and transitive closure of edges (type, parent) as (derived, base, distance), by a recursive query. A cycle
    is an error: the recursion passes its limit of levels."""
    return edges.sparkSession.sql(
        """
      WITH RECURSIVE up(derived, base, distance) AS (
        SELECT t, t, 0 FROM (SELECT type AS t FROM {edges} UNION SELECT parent FROM {edges})
        UNION ALL
        SELECT up.derived, e.parent, up.distance + 1 FROM up JOIN {edges} e ON e.type = up.base)
      SELECT derived, base, min(distance) AS distance FROM up GROUP BY derived, base""",
        edges=edges,
    )


def _sign(x: str) -> str:
    return f"cast(signum({x}) as int)"


#: Rules that turn pro, con and direct support (in minus out) into a label: 1 in, -1 out, 0 undecided.
RULES = {
    "SF": f"if({{pro}} <> {{con}}, {_sign('{pro} - {con}')}, {_sign('{direct}')})",
    "OF": f"if({{direct}} <> 0, {_sign('{direct}')}, {_sign('{pro} - {con}')})",
    "Majority": _sign("{direct}"),
    "CF": _sign(f"{_sign('{direct}')} + {_sign('{pro} - {con}')}"),
}


def _lists(spark, ancestors: dict[str, list[str]] | DataFrame) -> DataFrame:
    """type and up, its ancestors, itself first. What the driver holds as a dict may travel whole, up to SMALL types."""
    if isinstance(ancestors, DataFrame):
        return up_lists(ancestors)
    lists = spark.createDataFrame(sorted(ancestors.items()), "type string, up array<string>")
    return F.broadcast(lists) if len(ancestors) <= SMALL else lists


def voting(predictions: DataFrame, ancestors: dict[str, list[str]] | DataFrame, *order, rule: str = "SF", keys: list[str] = SELECT_KEY, n_agents: int = 3) -> DataFrame:
    """Subtype voting. An agent supports a type if it predicts a subtype of it. For each predicted type as the target, the other types are
    labelled from the most derived on, each by the support of its own defenders (labelled in) and attackers, and the target
    last: types below it defend it, others attack it. Targets labelled in are candidates; the candidates with the most
    supporting agents win, joined by ` | ` in order of first prediction. Method: the agents that predicted a winner. Without a candidate
    the symbol stays unresolved. ancestors: lists by type, or a frame derived, base, place of any size (hierarchy.linearised), which is
    joined by type; a type that isn't in it is below object alone."""
    root = F.lit("object") if isinstance(ancestors, dict) else F.lit(OBJECT)
    named = predictions.filter(F.col("anno").isNotNull()).join(_lists(predictions.sparkSession, ancestors).withColumnRenamed("type", "anno"), "anno", "left")
    below = F.coalesce("up", F.array("anno", root))
    one = named.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    item = F.struct("n", "agent", "anno", below.alias("up"), F.size(below).alias("depth"))
    grouped = one.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("p"))
    kinds = F.expr("transform(array_distinct(p.anno), a -> filter(p, x -> x.anno = a)[0])")
    supported = F.expr(f"transform(kinds, k -> named_struct('anno', k.anno, 'up', k.up, 'depth', k.depth, 'ins', size(array_distinct(filter(p, x -> array_contains(x.up, k.anno)).agent)), 'agents', {n_agents}))")
    label = RULES[rule]

    def labelled(graph: str, node: str, attack: str) -> str:
        """The label of node given those of graph's nodes so far: an array of (anno, up, label)."""
        defend = f"filter({graph}, g -> array_contains(g.up, {node}.anno) and g.anno <> {node}.anno)"
        attackers = f"filter({graph}, g -> not array_contains(g.up, {node}.anno))" if attack else f"filter({graph}, g -> false)"
        count = lambda of, sign: f"size(filter({of}, g -> g.label = {sign}))"
        pro = f"({count(defend, 1)} + {count(attackers, -1)})"
        con = f"({count(attackers, 1)} + {count(defend, -1)})"
        direct = f"(2 * {node}.ins - {node}.agents)"
        return label.format(pro=pro, con=con, direct=direct)

    empty = "cast(array() as array<struct<anno:string,up:array<string>,label:int>>)"
    add = f"concat(g0, array(named_struct('anno', k.anno, 'up', k.up, 'label', {labelled('g0', 'k', '')})))"
    others = f"aggregate(array_sort(filter(kinds, k -> k.anno <> t.anno), (a, b) -> int(b.depth - a.depth)), {empty}, (g0, k) -> {add})"
    target = f"transform(transform(kinds, t -> named_struct('t', t, 'g', {others})), z -> named_struct('anno', z.t.anno, 'ins', z.t.ins, 'label', {labelled('z.g', 'z.t', 'yes')}))"
    decided = (
        grouped.withColumn("kinds", kinds)
        .withColumn("kinds", supported)
        .withColumn("c", F.expr(f"filter({target}, c -> c.label = 1)"))
        .withColumn("won", F.expr("transform(filter(c, x -> x.ins = array_max(c.ins)), x -> x.anno)"))
    )
    return decided.select(
        *keys,
        F.nullif(F.array_join("won", " | "), F.lit("")).alias("anno"),
        F.expr("array_join(array_sort(array_distinct(filter(p, x -> size(won) = 0 or array_contains(won, x.anno)).agent)), '+')").alias("method"),
        F.lit(1).alias("topn"),
    )


def coherent(graph: Column) -> Column:
    """Whether each argument that is labelled in has no more con than pro, and each that is out no more pro than con. graph: an array of
    (label, pro, con), labels as in RULES; an empty one is coherent."""
    return F.forall(graph, lambda g: F.when(g["label"] == 1, g["pro"] >= g["con"]).when(g["label"] == -1, g["pro"] <= g["con"]).otherwise(True))


def coherent_by(graph: Column, c: int) -> Column:
    """Whether arguments in have more than c pro above con, those out less than c, and undecided ones at most c either way: all of
    them, not only those behind the last undecided one."""
    lead = lambda g: g["pro"] - g["con"]
    return F.forall(graph, lambda g: F.when(g["label"] == 1, lead(g) > c).when(g["label"] == -1, lead(g) < c).otherwise(F.abs(lead(g)) <= c))
