import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symbolith import schemas
from symbolith.functions import scalars as S
from symbolith.operators import align, compare, extract, resolve, rewrite, select
from symbolith.sources import runs, scans, sinks
from symbolith.streaming.labelling import label_stream

# The four golden cases state what voting decides in general: equal votes, a subtype's support, mutual attack, support from below. Fixed values.
TYPES = {"bool": ["int"], "int": [], "str": [], "float": [], "bytes": [], "bytearray": [], "IntSub": ["int"], "StrSub": ["str"]}
GOLDEN = [
    ((("str",), ("str",), ("int",)), "str"),
    ((("bool",), ("int",), ("int", "str")), "int"),
    ((("IntSub",), ("bool",), ("float",)), "IntSub | bool | float"),  # each is attacked by types that lack support, so all are in
    ((("IntSub",), ("int",), ("float",)), "int"),
]


def agents(spark, cases):
    rows = [(f"f{i}", "VARIABLE", "x", name, p, g, k) for i, case in enumerate(cases) for g, (name, ps) in enumerate(zip(resolve.DEFAULT_ORDER, case)) for k, p in enumerate(ps, 1)]
    return spark.createDataFrame(rows, "file string, category string, qname_ssa string, agent string, anno string, g int, topn int")


def winner(case, rule="SF"):
    """Voting in plain Python, from its definition."""
    up = resolve.closure(None, TYPES)
    said = [p for ps in case for p in ps if p]
    kinds = list(dict.fromkeys(said))
    ins = {k: sum(any(k in up.get(p, [p]) for p in ps if p) for ps in case) for k in kinds}
    sign = lambda x: (x > 0) - (x < 0)

    def label(k, defend, attack):
        pro = sum(x == 1 for x in defend) + sum(x == -1 for x in attack)
        con = sum(x == 1 for x in attack) + sum(x == -1 for x in defend)
        direct = 2 * ins[k] - 3
        return {"SF": sign(pro - con) or sign(direct), "OF": sign(direct) or sign(pro - con), "Majority": sign(direct), "CF": sign(sign(direct) + sign(pro - con))}[rule]

    good = []
    for t in kinds:
        done = {}
        for k in sorted((k for k in kinds if k != t), key=lambda k: -len(up[k])):
            done[k] = label(k, [v for g, v in done.items() if k in up[g]], [])
        if label(t, [v for g, v in done.items() if t in up[g]], [v for g, v in done.items() if t not in up[g]]) == 1:
            good.append(t)
    most = max((ins[t] for t in good), default=0)
    return " | ".join(t for t in good if ins[t] == most) or None


def test_voting_golden(spark):
    found = resolve.voting(agents(spark, [c for c, _ in GOLDEN]), resolve.closure(None, TYPES), "g", "topn").orderBy("file").collect()
    assert [r.anno for r in found] == [w for _, w in GOLDEN] == [winner(c) for c, _ in GOLDEN]


@pytest.mark.parametrize("rule", sorted(resolve.RULES))
def test_voting_against_plain_python(spark, rule):
    one = st.lists(st.sampled_from(sorted(TYPES)), max_size=3, unique=True)

    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.tuples(one, one, one).filter(lambda c: any(c)), min_size=20, max_size=40))
    def check(cases):
        found = {r.file: r.anno for r in resolve.voting(agents(spark, cases), resolve.closure(None, TYPES), "g", "topn", rule=rule).collect()}
        assert found == {f"f{i}": winner(c, rule) for i, c in enumerate(cases)}

    check()


def test_delegation(spark):
    rows = [("a", "s", None, 1), ("b", "s", "int", 1), ("c", "s", None, 1), ("a", "p", None, 1), ("b", "p", "bool", 1), ("c", "p", "str", 1), ("c", "p", "bytes", 2)]
    d = spark.createDataFrame(rows, "q string, agent string, anno string, topn int")
    run = lambda order: {r.q: (r.anno, r.method) for r in resolve.delegation(d, "topn", order=order, keys=["q"]).collect()}
    assert run(("s", "p")) == {"a": (None, "s+p"), "b": ("int", "s"), "c": ("str", "p")}
    assert run(("p", "s")) == {"a": (None, "p+s"), "b": ("bool", "p"), "c": ("str", "p")}


def test_cursor():
    assert align.greedy_cursor(["a", "b", "a", "c"], ["a", "x", "a", "c"]) == [0, -1, 2, 3]


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first().v
    assert v(S.module_and_target(F.lit("..pkg.mod.X"))) == ("..pkg.mod", "X")
    assert v(S.pick_qualified(F.array(F.lit(".a"), F.lit("b.c")), F.lit("t"))) == "b.c"
    assert v(S.within_scope(F.lit("C"), F.lit("C.x"))) == "x" and v(S.within_scope(F.lit(""), F.lit("C.x"))) == "C.x"
    assert v(S.scope_to_qname(F.lit("f,g@C"))) == "C.f.g" and v(S.scope_to_qname(F.lit("global@global"))) == ""
    assert v(S.arguments_text(F.array(F.lit("self"), F.lit("a"), F.lit("b")))) == "a b"
    assert v(S.returns_text(F.array(F.lit("self.x"), F.lit("y")))) == "x y"
    assert v(S.nth(F.array(F.lit("a")), 3, "")) == "" and v(S.nth(F.array(F.lit("a")), 3)) is None
    assert [v(S.is_builtin(F.lit(x))) for x in ("typing.Optional[int]", "amod.A", "int | None", "builtins.int", None)] == [1, 0, 0, 1, 0]
    assert v(S.stub_path(F.lit("a/x.py"))) == "a/x.pyi" and v(S.qualified(F.lit("a"), F.lit("b"))) == "a.b"
    assert v(S.probability(F.lit(0.0))) == 1.0 and v(S.other_to_null(F.lit("other"))) is None and S.workers() >= 1


def test_accuracy_counts_null_and_dash_as_equal(spark):
    d = spark.createDataFrame([("r", None, "-"), ("r", None, None), ("r", "a", "b"), ("r", "a", "a")], "repository string, anno_gt string, anno string")
    assert compare.statistic(d, "accuracy").first().accuracy == 0.75


def test_filters(spark):
    d = spark.createDataFrame([("self", "int"), ("a", None), ("b", "Any"), ("c", "int")], "arg_name string, arg_type string")
    assert [r.arg_name for r in select.usable_arguments(d).orderBy("arg_name").collect()] == ["a", "c"]
    r = spark.createDataFrame([("nan", ["x"]), ("int", []), (None, ["x"]), ("int", ["x"])], "return_type string, return_expr array<string>")
    assert select.usable_returns(r).count() == 2
    with pytest.raises(ValueError):
        select.check_inferable({"VARIABLE"}, set())


def test_schema_check(spark):
    good = spark.createDataFrame([("f", "VARIABLE", "q", "q", None, "m", 1)], schemas.PREDICTIONS)
    assert schemas.assert_schema(good, schemas.PREDICTIONS, values=True) is good
    with pytest.raises(ValueError, match="topn is below 1"):
        schemas.assert_schema(good.withColumn("topn", F.lit(0)), schemas.PREDICTIONS, values=True)
    with pytest.raises(ValueError, match="anno"):
        schemas.assert_schema(good.drop("anno"), schemas.PREDICTIONS)


def test_source_trees(spark, tmp_path):
    (tmp_path / "p/q").mkdir(parents=True)
    (tmp_path / "p/q/x.py").write_text("a: int = 1\n")
    (tmp_path / "p/bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "p/broken.py").write_text("def (")
    found = scans.sources(spark, str(tmp_path))
    assert {(r.file, r.error is None) for r in found.collect()} == {("p/q/x.py", True), ("p/bad.py", False), ("p/broken.py", True)}
    rows = extract.symbols(found.filter("error is null")).collect()
    assert [(r.file, r.anno, r.error is None) for r in rows if r.file == "p/q/x.py"] == [("p/q/x.py", "builtins.int", True)]
    assert [r.error is None for r in rows if r.file == "p/broken.py"] == [False]
    subset = spark.createDataFrame([("p/q/x.py",), ("gone.py",)], "file string")
    assert scans.sources(spark, str(tmp_path), subset=subset).count() == 1
    sinks.write_sources(rewrite.strip_sources(found.filter("error is null")), str(tmp_path / "out"))
    assert (tmp_path / "out/p/q/x.py").read_text() == "a = 1\n"


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text('test,"""repos/a/b/c/d.py"""\ntrain,repos/a/b/e.py\ntest,repos/a/b/f.py\n')
    assert [tuple(r) for r in scans.split_file(spark, str(tmp_path / "s.csv")).collect()] == [("a", "b", ["c/d.py", "f.py"])]
    with gzip.open(tmp_path / "p.json.gz", "wt") as out:
        out.write(json.dumps([{"name": "x", "provenance": "/a.py", "predicted_annotation_logprob_dist": [{"anno": "int", "logprob": -0.1}]}, {"name": "y"}]) + "\n")
    assert sorted(r.name for r in scans.graph_predictions(spark, str(tmp_path / "p.json.gz")).collect()) == ["x", "y"]
    (tmp_path / "d.json").write_text(json.dumps({"f.py": {"g@global": [{"category": "arg", "name": "a", "type": ["int", None]}]}}))
    assert sorted((r.topn, r.anno) for r in scans.inferred_scopes(spark, str(tmp_path / "d.json")).collect()) == [(1, "int"), (2, None)]
    rows = spark.createDataFrame([("f", "VARIABLE", "q", "q", "None", "m", 1), ("f", "VARIABLE", "r", "r", None, "m", 1)], schemas.PREDICTIONS)
    sinks.write_predictions(rows.select(*reversed(rows.columns)), str(tmp_path / "csv"), "csv")
    assert sorted(map(tuple, scans.predictions(spark, str(tmp_path / "csv")).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_label_stream(spark, tmp_path):
    context = spark.createDataFrame([("f", "VARIABLE", "q", "q", "int", "q", 0, 0, 0, 1, 0, 3, "m")], "file string, category string, qname string, qname_ssa string, anno string, simple_name string, loop int, reassigned int, nested int, builtin int, branching int, ctxt_category int, method string")
    context.write.parquet(str(tmp_path / "in"))
    truth = spark.createDataFrame([("f", "VARIABLE", "q", "q", "int")], schemas.ANNOTATED)
    for _ in range(2):  # what is labelled once isn't again
        label_stream(spark, str(tmp_path / "in"), truth, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [r.score for r in runs.training_set(spark, str(tmp_path / "out")).collect()] == [1]


def test_cursor_match_of_one_table_with_itself_can_be_counted(spark):
    rows = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("g", 1, "a")], "file string, ord long, name string")
    found = align.cursor_match(rows, rows.filter("name = 'a'").withColumn("anno", F.lit("int")))
    assert found.count() == 3
    assert sorted((r.file, r.ord, r.anno) for r in found.collect()) == [("f", 1, "int"), ("f", 2, None), ("g", 1, "int")]


def test_layouts(spark, tmp_path):
    assert scans.layout("/d/Many-Types-4-Py-Dataset/") == scans.MANYTYPES and scans.layout("/d/Better-types-4-py-dataset") == scans.BETTERTYPES
    assert scans.layout("/d/mine") == scans.PROJECT
    (tmp_path / "repos/test/a__b/c").mkdir(parents=True)
    (tmp_path / "repos/test/a__b/c/x.py").write_text("a = 1\n")
    assert [tuple(r) for r in scans.test_folder(spark, str(tmp_path)).collect()] == [("a", "b", ["c/x.py"])]
