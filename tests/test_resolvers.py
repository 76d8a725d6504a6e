"""Resolvers, checks inside plans, bounded top-n, and what plans shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from symbolith.operators import align, resolve, resolvers, select
from symbolith.plans import registry, resolve_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
KEY = "file string, category string, qname_ssa string"


def reference(spark, n=6):
    return spark.createDataFrame([("f", "VARIABLE", f"x{k}") for k in range(n)], KEY)


def said(spark, rows):
    return spark.createDataFrame([("f", "VARIABLE", *r) for r in rows], f"{KEY}, agent string, anno string, method string, topn int")


ROWS = [("x0", "static", "int", "mypy", 1), ("x0", "dynamic", "str", "trace", 1), ("x1", "dynamic", None, "trace", 1), ("x1", "probabilistic", "bytes", "model", 2), ("x1", "probabilistic", "bool", "model", 1),
        ("x2", "static", None, "mypy", 1), ("x2", "probabilistic", None, "model", 1), ("x9", "static", "int", "mypy", 1), ("x3", "other", "int", "o", 1)]


def test_symbols_come_one_by_one(spark):
    got = {r.qname_ssa: (r.anno, r.method) for r in resolvers.by_symbol(resolvers.FirstOf(), said(spark, ROWS), reference(spark)).collect()}
    assert got == {"x0": ("int", "static"), "x1": ("bool", "probabilistic"), "x2": (None, "mypy+model"), **{f"x{k}": (None, "") for k in (3, 4, 5)}}


def test_a_resolver_without_answers(spark):
    class Silent:
        def forward(self, symbol, predictions):
            return None

    got = {r.qname_ssa: (r.anno, r.method) for r in resolvers.by_symbol(Silent(), said(spark, ROWS), reference(spark)).collect()}
    assert got == {"x0": (None, "mypy+trace"), "x1": (None, "trace+model"), "x2": (None, "mypy+model"), **{f"x{k}": (None, "") for k in (3, 4, 5)}}


def test_the_reference_has_each_symbol_once(spark):
    with pytest.raises(Exception, match="stands twice in the reference"):
        resolvers.by_symbol(resolvers.FirstOf(), said(spark, ROWS), reference(spark).union(reference(spark, 1))).collect()
    with pytest.raises(Exception, match="more than once: f, VARIABLE, x0"):
        resolvers.by_table(Nothing(), {"static": said(spark, ROWS).drop("agent")}, reference(spark).union(reference(spark, 1))).collect()


def test_delegation_is_a_resolver(spark):
    agents = [(f"x{k}", a, (None, "int", "str")[(k * 7 + i * 3 + t) % 3], a, t) for k in range(90) for i, a in enumerate(resolve.DEFAULT_ORDER) for t in range(1, 1 + (k + i) % 4)]
    rows = said(spark, agents)
    one = {r.qname_ssa: (r.anno, r.method if r.anno else None) for r in resolve.delegation(rows, "topn").collect()}
    other = {r.qname_ssa: (r.anno, r.method if r.anno else None) for r in resolvers.by_symbol(resolvers.FirstOf(), rows, reference(spark, 90)).collect()}
    assert one == {k: v for k, v in other.items() if k in one} and len(one) > 60 and len(other) == 90


def test_a_hot_symbol_streams(spark):
    """A symbol with very many predictions isn't gathered: the resolver may stop at the first."""
    many = spark.range(200_000).select(F.lit("f").alias("file"), F.lit("VARIABLE").alias("category"), F.lit("x1").alias("qname_ssa"), F.lit("static").alias("agent"), F.concat(F.lit("t"), "id").alias("anno"), F.lit("m").alias("method"), F.col("id").cast("int").alias("topn"))
    got = {r.qname_ssa: r.anno for r in resolvers.by_symbol(resolvers.FirstOf(), many, reference(spark, 3)).collect()}
    assert got == {"x0": None, "x1": "t0", "x2": None}


class Nothing:
    def forward(self, agents):
        assert all(set(df.columns) == {"file", "category", "qname_ssa", "anno", "method", "topn"} for df in agents.values())
        return next(iter(agents.values())).filter("false")


class Static:
    def forward(self, agents):
        return agents["static"].filter("anno is not null").withColumn("method", F.lit("mine"))


def test_tables_at_once(spark):
    own = {a: said(spark, ROWS).filter(F.col("agent") == a).drop("agent") for a in ("static", "dynamic")}
    got = {r.qname_ssa: (r.anno, r.method) for r in resolvers.by_table(Static(), own, reference(spark)).collect()}
    assert got == {"x0": ("int", "mine"), **{f"x{k}": (None, "static+dynamic") for k in range(1, 6)}}
    assert {r.anno for r in resolvers.by_table(Nothing(), own, reference(spark)).collect()} == {None}
    assert resolvers.tagged(own).select("agent").distinct().count() == 2


def jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"g{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_strict_alignment_is_checked_in_the_plan(spark):
    predictions = spark.createDataFrame([("f", "VARIABLE", "x0", "int"), ("f", "VARIABLE", "x9", "str")], f"{KEY}, anno string")
    baseline = reference(spark, 2).withColumn("anno", F.lit("gone")).withColumn("ord", F.lit(1))
    found = align.merged_with_baseline(predictions, baseline, "anno", strict=True)
    assert found.columns == ["file", "category", "qname_ssa", "ord", "anno"]
    assert {r.qname_ssa: (r.anno, r.ord) for r in found.collect()} == {"x0": ("int", 1), "x1": (None, 1), "x9": ("str", None)}
    twice = predictions.union(predictions.limit(1))
    assert jobs(spark, lambda: align.merged_with_baseline(twice, baseline, "anno", strict=True)) == 0  # no job of its own
    with pytest.raises(Exception, match="more than once: f, VARIABLE, x0"):
        align.merged_with_baseline(twice, baseline, "anno", strict=True).collect()
    assert align.merged_with_baseline(twice, baseline, "anno").count() == 3


def test_unique_among_some_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (None, "b"), (2, "c")], "k int, v string")
    assert select.assert_unique(df, ["k"], F.col("v").isNotNull()).count() == 4
    with pytest.raises(Exception, match="more than once: 1"):
        select.assert_unique(df, ["k"]).collect()


def test_best_of_a_hot_key_keeps_n_rows_a_task(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.concat(F.lit("t"), F.col("id") % 1000).alias("anno"), (-(F.col("id") % 5000)).cast("double").alias("logprob"))
    best = select.best_of(df, ["k"], 3)
    hot = best.filter("k = 0").first().best
    assert [(b.anno, b.logprob) for b in hot] == [("t0", 0.0), ("t0", 0.0), ("t0", 0.0)] or len(hot) == 3
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before the shuffle and behind it
    few = spark.createDataFrame([(1, None, 0.5), (1, "%UNK%", 0.9), (2, "a", None)], "k int, anno string, logprob double")
    got = {r.k: [(b.anno, b.logprob) for b in r.best] for r in select.best_of(few, ["k"], 3).collect()}
    assert got == {1: [("typing.Any", 0.9), (None, 0.5), ("typing.Any", -1000.0)], 2: [("a", None), ("typing.Any", -1000.0), ("typing.Any", -1000.0)]}


@pytest.fixture
def planned(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def of(name):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        return len(re.findall(r"Exchange hashpartitioning", plan)), len(re.findall(r"FileScan", plan))

    yield of
    for c, v in before.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("name,exchanges,scans", [("q09_symbol_commonality", 4, 3), ("q03_annotation_buckets", 5, 3), ("q18_baseline_alignment", 4, 3), ("q21_delegation", 1, 2)])
def test_shuffles_and_scans(planned, name, exchanges, scans):
    """The best prediction is dealt once, by the keys of its join; alignment reads each side once; delegation shuffles its rows once."""
    assert planned(name) == (exchanges, scans)
