"""Queries over the symbol-shaped views, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align, compare, documents, numbering, resolve, select
from ..session import table
from .views import AGENTS, BASE, PRED, TOP, agents, base, pred

TYPES = {"bool": ["int"], "int": [], "str": [], "float": []}
_KEYS = ["file", "category", "qname", "qname_ssa"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with the SQL of its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _best(spark, d, keys=_KEYS):
    """The best prediction of each symbol, dealt by the keys that it is joined by next; qname follows from qname_ssa."""
    return select.first_per(pred(spark, d), keys, "topn", "p", "s")


@query(f"WITH {PRED}, {TOP} SELECT file, category, qname, qname_ssa, anno FROM best")
def q01_top_predictions(spark, d):
    return select.top_predictions(pred(spark, d), "p", "s").select(*_KEYS, "anno")


@query(f"""WITH {BASE}, {PRED}, {TOP} SELECT CASE WHEN b.file IS NULL THEN 'right_only' WHEN t.file IS NULL THEN 'left_only' ELSE 'both' END AS presence, count(*) AS n
FROM base b FULL OUTER JOIN best t ON b.file = t.file AND b.category = t.category AND b.qname = t.qname AND b.qname_ssa = t.qname_ssa GROUP BY 1""")
def q02_symbol_commonality_counts(spark, d):
    return compare.bucket_counts(compare.symbol_commonality(base(spark, d).drop("ord"), _best(spark, d).select(*_KEYS, "anno")), "presence")


_BUCKETS = f"""WITH {BASE}, {PRED}, {TOP} SELECT CASE WHEN t.anno IS NULL THEN 'missing' WHEN b.anno IS NULL THEN 'no_gt' WHEN t.anno = b.anno THEN 'exact' ELSE 'differing' END AS bucket, count(*) AS n
FROM base b LEFT JOIN best t ON b.file = t.file AND b.category = t.category AND b.qname = t.qname AND b.qname_ssa = t.qname_ssa GROUP BY 1"""


@query(_BUCKETS)
def q03_annotation_buckets(spark, d):
    return compare.bucket_counts(compare.annotation_commonality(base(spark, d), _best(spark, d)), "bucket")


@query(f"""WITH {BASE}, {PRED} SELECT p.method, count(*) AS n, sum(CASE WHEN p.anno IS NULL THEN -1 WHEN p.anno = b.anno THEN 1 ELSE 0 END) AS score
FROM (SELECT * FROM base WHERE anno IS NOT NULL) b RIGHT JOIN pred p ON b.file = p.file AND b.category = p.category AND b.qname = p.qname AND b.qname_ssa = p.qname_ssa GROUP BY 1""")
def q04_training_scores(spark, d):
    context = pred(spark, d).select(*_KEYS, "anno", "method", *(F.lit(0).alias(c) for c in ("loop", "reassigned", "nested", "builtin", "ctxt_category")))
    rows = compare.training_rows(base(spark, d), context)
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("SELECT conv_id, turn, role || 'λ' || cast(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS varchar) AS qname_ssa FROM conversations")
def q05_numbering(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.lit("VARIABLE").alias("category"), F.col("role").alias("qname"), "turn")
    return numbering.number(c, "turn").select(F.col("file").alias("conv_id"), "turn", "qname_ssa")


@query(f"""WITH {PRED} SELECT file, category, qname, topn, p, s, CASE WHEN category = 'VARIABLE' THEN qname || 'λ' || cast(row_number() OVER (PARTITION BY file, category, qname, topn ORDER BY p, s) AS varchar) ELSE qname END AS qname_ssa FROM pred""")
def q06_numbering_with_ranks(spark, d):
    rows = pred(spark, d).drop("qname_ssa").withColumn("ord", F.struct("p", "s"))
    return numbering.number(rows).select("file", "category", "qname", "topn", "p", "s", "qname_ssa")


@query(f"WITH {AGENTS} SELECT agent AS repository, avg(CASE WHEN anno IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END) AS coverage FROM agents GROUP BY 1")
def q07_coverage(spark, d):
    return compare.statistic(agents(spark, d).withColumnRenamed("agent", "repository"), "coverage")


@query(f"""WITH {BASE}, {PRED} SELECT p.method AS repository, avg(CASE WHEN coalesce(b.anno, '-') = coalesce(p.anno, '-') THEN 1.0e0 ELSE 0.0e0 END) AS accuracy
FROM pred p JOIN base b ON b.file = p.file AND b.category = p.category AND b.qname_ssa = p.qname_ssa GROUP BY 1""")
def q08_accuracy(spark, d):
    truth = base(spark, d).select("file", "category", "qname_ssa", F.col("anno").alias("anno_gt"))
    return compare.statistic(pred(spark, d).join(truth, ["file", "category", "qname_ssa"]).withColumnRenamed("method", "repository"), "accuracy")


@query(f"""WITH {BASE}, {PRED}, {TOP} SELECT coalesce(b.file, t.file) AS file, coalesce(b.category, t.category) AS category, coalesce(b.qname, t.qname) AS qname, coalesce(b.qname_ssa, t.qname_ssa) AS qname_ssa,
 b.anno AS anno_x, t.anno AS anno_y, CASE WHEN b.file IS NULL THEN 'right_only' WHEN t.file IS NULL THEN 'left_only' ELSE 'both' END AS presence
FROM base b FULL OUTER JOIN best t ON b.file = t.file AND b.category = t.category AND b.qname = t.qname AND b.qname_ssa = t.qname_ssa""")
def q09_symbol_commonality(spark, d):
    return compare.symbol_commonality(base(spark, d).drop("ord"), _best(spark, d).select(*_KEYS, "anno"))


@query("""SELECT cast(l_orderkey AS varchar) AS path, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1
HAVING count(DISTINCT l_returnflag) < (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def q10_tree_equality(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_returnflag").alias("root"))
    return compare.differing_trees(files)


@query(f"""WITH {BASE}, {PRED}, u AS (SELECT file, category, qname_ssa, anno, 0 AS r, 0 AS topn, 0 AS p, 0 AS s FROM base UNION ALL SELECT file, category, qname_ssa, anno, 1, topn, p, s FROM pred)
SELECT file, category, qname_ssa, anno FROM (SELECT *, row_number() OVER (PARTITION BY file, category, qname_ssa ORDER BY r, topn, p, s) AS n FROM u) WHERE n = 1""")
def q11_first_source_wins(spark, d):
    keys = ["file", "category", "qname_ssa"]
    frames = [base(spark, d).select(*keys, "anno"), pred(spark, d).select(*keys, "anno", "topn", "p", "s")]
    return select.first_source_wins(frames, keys, "topn", "p", "s").select(*keys, "anno")


@query(f"WITH {AGENTS} SELECT k, agent, anno FROM (SELECT *, count(*) OVER (PARTITION BY k, agent) AS n FROM agents) WHERE n = 1")
def q12_unique_only(spark, d):
    return select.unique_only(agents(spark, d), ["k", "agent"]).select("k", "agent", "anno")


@query(f"""WITH {AGENTS}, c AS (SELECT k, anno, count(*) AS votes, string_agg(DISTINCT agent, '+' ORDER BY agent) AS method FROM agents WHERE anno IS NOT NULL GROUP BY k, anno)
SELECT k, anno, votes, method FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM c WHERE votes > 1) WHERE n = 1""")
def q13_frequency_vote(spark, d):
    return select.frequency_vote(agents(spark, d), ["k"], method="agent").select("k", "anno", "votes", F.col("agent").alias("method"))


@query("""WITH o AS (SELECT c_custkey AS k, o_orderpriority AS anno, o_totalprice AS logprob, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY logprob DESC, anno DESC) AS n FROM o WHERE o_orderkey IS NOT NULL)
SELECT c.k, i AS topn, coalesce(r.anno, 'typing.Any') AS anno, coalesce(r.logprob, -1000.0e0) AS logprob
FROM (SELECT DISTINCT k FROM o) c CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) LEFT JOIN r ON r.k = c.k AND r.n = i""")
def q14_top_of_distribution(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("anno"), F.col("o_totalprice").alias("logprob"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    best = c.join(select.best_of(o, ["k"], 3), "k", "left").withColumn("best", F.coalesce("best", select.top_of_distribution(F.expr("cast(array() as array<struct<anno:string,logprob:double>>)"), 3)))
    return select.ranked(best, "best", "e").select("k", "topn", "e.anno", "e.logprob")


@query(f"WITH {PRED} SELECT file, qname_ssa, topn, p, s, 1.0e0 / pow(2.0e0, topn) AS probability FROM pred WHERE anno IS NOT NULL")
def q15_rank_probability(spark, d):
    return pred(spark, d).filter("anno is not null").select("file", "qname_ssa", "topn", "p", "s", select.rank_probability(F.col("topn")).alias("probability"))


@query(f"WITH {BASE} SELECT file, category, qname, anno, 'gt' AS method, 1 AS topn FROM base WHERE category IN ('VARIABLE', 'CALLABLE_RETURN')")
def q16_category_filter(spark, d):
    rows = select.of_categories(base(spark, d), ["VARIABLE", "CALLABLE_RETURN"])
    return rows.select("file", "category", "qname", "anno", F.lit("gt").alias("method"), F.lit(1).alias("topn"))


@query("""SELECT conv_id, turn, role AS arg_name, CASE turn % 4 WHEN 0 THEN 'Any' WHEN 1 THEN 'None' WHEN 2 THEN 'int' END AS arg_type FROM conversations
WHERE role <> 'system' AND coalesce(CASE turn % 4 WHEN 0 THEN 'Any' WHEN 1 THEN 'None' WHEN 2 THEN 'int' END, '') NOT IN ('Any', 'None')""")
def q17_usable_arguments(spark, d):
    t = F.col("turn") % 4
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "self").otherwise(F.col("role")).alias("arg_name"), F.when(t == 0, "Any").when(t == 1, "None").when(t == 2, "int").alias("arg_type"))
    return select.usable_arguments(rows)


@query(f"""WITH {BASE}, {PRED}, {TOP} SELECT b.file, b.category, b.qname_ssa, t.anno FROM best t RIGHT JOIN base b ON b.file = t.file AND b.category = t.category AND b.qname_ssa = t.qname_ssa
UNION ALL SELECT t.file, t.category, t.qname_ssa, t.anno FROM best t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.file = t.file AND b.category = t.category AND b.qname_ssa = t.qname_ssa)""")
def q18_baseline_alignment(spark, d):
    keys = ["file", "category", "qname_ssa"]
    return align.merged_with_baseline(_best(spark, d, keys).select(*keys, "anno"), base(spark, d).select(*keys, "anno"), "anno").select(*keys, "anno")


@query("""SELECT cast(conv_id AS varchar) AS file, 'f' || cast(conv_id % 3 AS varchar) AS function, string_agg(role || ':' || CASE WHEN turn % 3 = 0 THEN '?' ELSE 'int' END, ',' ORDER BY turn) AS parameters FROM conversations GROUP BY 1, 2""")
def q19_functions_with_parameters(spark, d):
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("file"), F.lit("CALLABLE_PARAMETER").alias("category"),
        F.concat(F.lit("f"), (F.col("conv_id") % 3).cast("string"), F.lit("."), "role").alias("qname"),
        F.when(F.col("turn") % 3 != 0, "int").alias("anno"), F.col("turn").alias("ord"),
    )
    return align.functions_with_parameters(rows)


@query("""WITH p AS (SELECT split_part(u, '/', 1) AS author, split_part(u, '/', 2) AS project, regexp_replace(regexp_replace(u, '^[^/]*/', ''), '^[^/]*/', '') AS file FROM
(SELECT regexp_replace(url, '^https?://', '') AS u, page_id FROM pages) WHERE page_id % 3 <> 0)
SELECT author, project, string_agg(DISTINCT file, ';' ORDER BY file) AS files FROM p GROUP BY 1, 2""")
def q20_split_paths(spark, d):
    from ..sources.scans import split_rows

    path = F.concat(F.lit('"'), F.when(F.col("page_id") % 2 == 0, "repos/").otherwise(""), F.regexp_replace("url", "^https?://", ""), F.lit('"'))
    rows = table(spark, d, "pages").select(F.when(F.col("page_id") % 3 == 0, "train").otherwise("test").alias("split"), path.alias("filepath"))
    return split_rows(rows).select("author", "project", F.array_join("files", ";").alias("files"))


_DELEGATION = f"""WITH {AGENTS} SELECT k, anno, CASE WHEN anno IS NULL THEN '{{all}}' ELSE agent END AS method FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY anno IS NULL,
 CASE agent WHEN '{{a}}' THEN 0 WHEN '{{b}}' THEN 1 ELSE 2 END, topn, p, s) AS n FROM agents) WHERE n = 1"""


@query(_DELEGATION.format(all="static+dynamic+probabilistic", a="static", b="dynamic"))
def q21_delegation(spark, d):
    return resolve.delegation(agents(spark, d), "topn", "p", "s", keys=["k"])


@query(_DELEGATION.format(all="probabilistic+dynamic+static", a="probabilistic", b="dynamic"))
def q22_delegation_reversed(spark, d):
    return resolve.delegation(agents(spark, d), "topn", "p", "s", keys=["k"], order=resolve.DEFAULT_ORDER[::-1])


@query("""WITH RECURSIVE e AS (SELECT n_name AS type, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'object' FROM region),
up(derived, base, distance) AS (SELECT t, t, 0 FROM (SELECT type AS t FROM e UNION SELECT parent FROM e) UNION ALL SELECT up.derived, e.parent, up.distance + 1 FROM up JOIN e ON e.type = up.base)
SELECT derived, base, min(distance) AS distance FROM up GROUP BY 1, 2""")
def q23_subtype_closure(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("type"), F.col("r_name").alias("parent"))
    return resolve.subtype_closure(edges.unionByName(r.select(F.col("r_name").alias("type"), F.lit("object").alias("parent"))))


def _voted(rule):
    def run(spark, d):
        found = resolve.voting(agents(spark, d), resolve.closure(spark, TYPES), "topn", "p", "s", keys=["k"], rule=rule)
        return found.select("k", "anno", "method", "topn")

    run.__name__ = f"q24_voting_{rule.lower()}"
    return run


#: Labels by each rule, of pro, con and direct support.
_LABELS = {
    "SF": "CASE WHEN {pro} <> {con} THEN sign({pro} - {con}) ELSE sign({direct}) END",
    "OF": "CASE WHEN {direct} <> 0 THEN sign({direct}) ELSE sign({pro} - {con}) END",
    "Majority": "sign({direct})",
    "CF": "sign(sign({direct}) + sign({pro} - {con}))",
}


def _voting_sql(rule: str) -> str:
    """Two levels, unrolled: bool is below int, other types are below none. a: the label of a type by itself; l: of a type o while t is
    the target, when bool defends int; c: of the target, which types below it defend and others attack."""
    label = lambda pro, con, direct: _LABELS[rule].format(pro=pro, con=con, direct=direct)
    return f"""WITH {AGENTS}, t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY topn, p, s) AS n FROM agents WHERE anno IS NOT NULL),
up AS (SELECT k, agent, anno AS base FROM t UNION SELECT k, agent, 'int' FROM t WHERE anno = 'bool'),
s AS (SELECT t.k, t.anno, min(t.n) AS n, (SELECT count(DISTINCT agent) FROM up WHERE up.k = t.k AND up.base = t.anno) AS ins FROM t GROUP BY t.k, t.anno),
a AS (SELECT *, {label("0", "0", "(2 * ins - 3)")} AS alone FROM s),
l AS (SELECT t.k, t.anno AS target, o.anno, CASE WHEN o.anno = 'int' AND b.k IS NOT NULL AND t.anno NOT IN ('int', 'bool')
  THEN {label("(b.alone = 1)::int", "(b.alone = -1)::int", "(2 * o.ins - 3)")} ELSE o.alone END AS label, t.anno = 'int' AND o.anno = 'bool' AS below
  FROM a t JOIN a o ON t.k = o.k AND t.anno <> o.anno LEFT JOIN a b ON b.k = t.k AND b.anno = 'bool'),
g AS (SELECT k, target, count(*) FILTER (label = CASE WHEN below THEN 1 ELSE -1 END) AS pro, count(*) FILTER (label = CASE WHEN below THEN -1 ELSE 1 END) AS con FROM l GROUP BY 1, 2),
c AS (SELECT a.*, {label("coalesce(g.pro, 0)", "coalesce(g.con, 0)", "(2 * a.ins - 3)")} AS label FROM a LEFT JOIN g ON g.k = a.k AND g.target = a.anno),
w AS (SELECT * FROM (SELECT *, max(ins) OVER (PARTITION BY k) AS most FROM c WHERE label = 1) WHERE ins = most),
v AS (SELECT k, string_agg(anno, ' | ' ORDER BY n) AS anno FROM w GROUP BY k),
m AS (SELECT t.k, string_agg(DISTINCT agent, '+' ORDER BY agent) AS method FROM t LEFT JOIN v ON v.k = t.k WHERE v.k IS NULL OR EXISTS (SELECT 1 FROM w WHERE w.k = t.k AND w.anno = t.anno) GROUP BY t.k)
SELECT m.k, v.anno, m.method, 1 AS topn FROM m LEFT JOIN v ON v.k = m.k"""


for _rule in resolve.RULES:
    query(_voting_sql(_rule))(_voted(_rule))


@query("SELECT page_id, CASE WHEN contains(url, '.') THEN regexp_extract(url, '^(.*)\\.([^.]*)$', 1) ELSE '' END AS function, CASE WHEN contains(url, '.') THEN regexp_extract(url, '^(.*)\\.([^.]*)$', 2) ELSE '' END AS arg FROM pages")
def q26_function_and_argument(spark, d):
    return table(spark, d, "pages").select("page_id", S.function_of(F.col("url")).alias("function"), S.argument_of(F.col("url")).alias("arg"))


@query("SELECT o_orderkey, regexp_replace('builtins.' || o_orderstatus || '.<locals>.' || o_orderpriority, '^builtins\\.', '') AS a, replace('builtins.' || o_orderstatus || '.<locals>.' || o_orderpriority, '.<locals>.', '.') AS b FROM orders")
def q27_name_cleaning(spark, d):
    name = F.concat(F.lit("builtins."), "o_orderstatus", F.lit(".<locals>."), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", S.without_builtins_prefix(name).alias("a"), S.without_locals(name).alias("b"))


@query("SELECT o_orderkey, nullif(regexp_extract('Callable[[int], ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Dict[str, int]' END || ']', ', ([^\\]]+)\\]$', 1), '') AS ret FROM orders")
def q28_callable_return(spark, d):
    inner = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("Dict[str, int]")
    return table(spark, d, "orders").select("o_orderkey", S.callable_return(F.concat(F.lit("Callable[[int], "), inner, F.lit("]"))).alias("ret"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN l_returnflag || '.' || l_linestatus ELSE 'C' || cast(l_linenumber AS varchar) || '.' || l_returnflag || '.' || l_linestatus END AS qname FROM lineitem""")
def q29_scope_names(spark, d):
    n = F.col("l_linenumber")
    two = F.concat("l_returnflag", F.lit(","), "l_linestatus")
    scope = F.when(n == 1, "global@global").when(n == 2, F.concat(two, F.lit("@global"))).otherwise(F.concat(two, F.lit("@C"), n.cast("string")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.scope_to_qname(scope).alias("qname"))


@query(f"WITH {AGENTS} SELECT k, p, s, topn, CASE WHEN anno IN ('bool', 'int', 'str', 'float') THEN 1 ELSE 0 END AS builtin FROM agents")
def q30_builtin_flag(spark, d):
    return agents(spark, d).select("k", "p", "s", "topn", S.is_builtin(F.col("anno")).alias("builtin"))


_SCOPES = """s AS (SELECT 'c' || cast(conv_id AS varchar) || '.py' AS file, role AS scope, CASE turn % 3 WHEN 0 THEN 'arg' WHEN 1 THEN 'return' ELSE 'local' END AS category, 'n' || cast(turn AS varchar) AS name, turn FROM conversations)"""


def _scope_rows(spark, d):
    """file, scope, category, name, topn, anno, two ranks a name."""
    kind = F.when(F.col("turn") % 3 == 0, "arg").when(F.col("turn") % 3 == 1, "return").otherwise("local")
    types = F.array(F.when(F.col("turn") % 2 == 0, "int").otherwise("str"), F.lit("bytes"))
    rows = table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".py")).alias("file"), F.col("role").alias("scope"), kind.alias("category"),
        F.concat(F.lit("n"), F.col("turn").cast("string")).alias("name"), F.posexplode(types).alias("pos", "anno"),
    )
    return rows.select("file", "scope", "category", "name", (F.col("pos") + 1).alias("topn"), "anno")


@query(f"""WITH {_SCOPES} SELECT file, scope, category, name, t.topn, CASE WHEN t.topn = 2 THEN 'bytes' WHEN turn % 2 = 0 THEN 'int' ELSE 'str' END AS anno FROM s, (SELECT unnest([1, 2]) AS topn) t""")
def q31_nested_documents(spark, d):
    whole = documents.nested_documents(_scope_rows(spark, d))  # to documents and back
    from ..sources.scans import scopes_of

    return scopes_of(whole.select(F.concat(F.lit("{"), F.to_json(F.map_from_arrays(F.array("file"), F.array(F.lit(0)))).substr(F.lit(2), F.length("file") + 3), "document", F.lit("}")).alias("value")))


@query(f"""WITH {_SCOPES}, r AS (SELECT file, scope, category AS c, name, t.topn, CASE WHEN t.topn = 2 THEN 'bytes' WHEN turn % 2 = 0 THEN 'int' ELSE 'str' END AS anno FROM s, (SELECT unnest([1, 2]) AS topn) t)
SELECT file, 'CALLABLE_PARAMETER' AS category, scope || '.' || name AS qname, topn, anno FROM r WHERE c = 'arg' UNION ALL SELECT file, 'CALLABLE_RETURN', scope, topn, anno FROM r WHERE c = 'return'
UNION ALL SELECT file, 'VARIABLE', scope || '.' || name, topn, anno FROM r WHERE c = 'local' UNION ALL SELECT file, 'VARIABLE', scope || '.self.' || name, topn, anno FROM r WHERE c = 'local'
UNION ALL SELECT DISTINCT file, 'CALLABLE_PARAMETER', scope || '.self', 1, CAST(NULL AS varchar) FROM r WHERE scope = 'user'""")
def q45_scope_annotations(spark, d):
    return documents.scope_annotations(_scope_rows(spark, d).withColumn("method", F.col("scope") == "user"))


@query(f"WITH {AGENTS} SELECT k, anno, CASE WHEN anno IS NULL THEN 'static+probabilistic' ELSE agent END AS method FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY anno IS NULL, agent <> 'static', topn, p, s) AS n FROM agents WHERE agent <> 'dynamic') WHERE n = 1")
def q46_delegation_of_those_present(spark, d):
    return resolve.delegation(agents(spark, d).filter("agent <> 'dynamic'"), "topn", "p", "s", keys=["k"])


@query("""SELECT o_custkey, i AS topn, CASE WHEN i <= n THEN a[i] END AS anno, CASE WHEN i <= n THEN p[i] END AS price FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS a, list(o_totalprice ORDER BY o_orderkey) AS p, count(*) AS n FROM orders GROUP BY 1), (SELECT unnest(range(1, 200)) AS i) WHERE i <= n""")
def q47_batchify(spark, d):
    item = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")))
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(item.alias("l")).select("o_custkey", F.col("l.o_orderstatus").alias("anno"), F.col("l.o_totalprice").alias("price"))
    return documents.batchify(lists, "anno", "price")


@query(f"""WITH {BASE}, {PRED}, h AS (SELECT p.method, b.qname_ssa, min(CASE WHEN p.anno = b.anno THEN p.topn END) AS best FROM pred p JOIN base b ON b.file = p.file AND b.category = p.category AND b.qname_ssa = p.qname_ssa WHERE b.anno IS NOT NULL GROUP BY 1, 2)
SELECT method, count(*) AS n, count(*) FILTER (best <= 1) AS hit_1, count(*) FILTER (best <= 3) AS hit_3, count(*) FILTER (best <= 5) AS hit_5 FROM h GROUP BY 1""")
def q32_hits_at_k(spark, d):
    truth = base(spark, d).filter("anno is not null").select("file", "category", "qname_ssa", F.col("anno").alias("anno_gt"))
    best = pred(spark, d).join(truth, ["file", "category", "qname_ssa"]).groupBy("method", "qname_ssa").agg(F.min(F.when(F.col("anno") == F.col("anno_gt"), F.col("topn"))).alias("best"))
    return best.groupBy("method").agg(F.count("*").alias("n"), *(F.count_if(F.col("best") <= k).alias(f"hit_{k}") for k in (1, 3, 5)))


@query("""SELECT o_custkey AS id, bool_and(CASE WHEN label = 1 THEN pro >= con WHEN label = -1 THEN pro <= con ELSE true END) AS coherent,
bool_and(CASE WHEN label = 1 THEN pro - con > 1 WHEN label = -1 THEN pro - con < 1 ELSE abs(pro - con) <= 1 END) AS by_one
FROM (SELECT o_custkey, cast(o_orderkey % 3 - 1 AS integer) AS label, cast(o_orderkey % 5 AS integer) AS pro, cast(o_custkey % 4 AS integer) AS con FROM orders) GROUP BY 1""")
def q51_coherence(spark, d):
    o = table(spark, d, "orders")
    item = F.struct((F.col("o_orderkey") % 3 - 1).cast("int").alias("label"), (F.col("o_orderkey") % 5).cast("int").alias("pro"), (F.col("o_custkey") % 4).cast("int").alias("con"))
    graph = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(item).alias("g"))
    return graph.select("id", resolve.coherent(F.col("g")).alias("coherent"), resolve.coherent_by(F.col("g"), 1).alias("by_one"))
