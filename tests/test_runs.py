"""Output by run and project, training batches that count once whatever fails, messages and tallies of the pass that did the work."""

import pytest
from pyspark.sql import functions as F
from test_resolvers import jobs

from symbolith import cli, schemas
from symbolith.operators import extract
from symbolith.sources import runs, scans
from symbolith.streaming import labelling


def predictions(spark, n=60, anno="int", projects=("a.p", "a.q", "b/c")):
    rows = spark.range(n).select(
        F.concat(F.lit("f"), F.col("id") % 5).alias("file"), F.lit("VARIABLE").alias("category"), F.concat(F.lit("x"), "id").alias("qname"), F.concat(F.lit("x"), "id").alias("qname_ssa"),
        F.lit(anno).alias("anno"), F.lit("m").alias("method"), F.lit(1).alias("topn"), F.get(F.array(*map(F.lit, projects)), (F.col("id") % len(projects)).cast("int")).alias("project"),
    )
    return runs.of_run(rows, "mypy", ["VARIABLE", "CALLABLE_RETURN"], ["VARIABLE"])


def annos(spark, root):
    return {(r.project, r.anno): r["count"] for r in runs.read_run(spark, root).groupBy("project", "anno").count().collect()}


def test_policies_by_project(spark, tmp_path):
    root = str(tmp_path / "out")
    runs.write_run(predictions(spark, projects=("a.p", "b/c")), root)
    assert annos(spark, root) == {("a.p", "int"): 30, ("b/c", "int"): 30}
    runs.write_run(predictions(spark, anno="str"), root, runs.SKIP)  # only the project that isn't there
    assert annos(spark, root) == {("a.p", "int"): 30, ("b/c", "int"): 30, ("a.q", "str"): 20}
    with pytest.raises(Exception, match="there are results already: mypy CALLABLE_RETURN,VARIABLE VARIABLE a.p"):
        runs.write_run(predictions(spark, anno="bytes", projects=("new", "a.p")), root, runs.ERROR)
    assert annos(spark, root) == {("a.p", "int"): 30, ("b/c", "int"): 30, ("a.q", "str"): 20}  # and nothing of it is published
    runs.write_run(predictions(spark, anno="bool", projects=("a.p",)), root, runs.REPLACE)
    runs.write_run(predictions(spark, anno="float", projects=("new",)), root, runs.ERROR)
    assert annos(spark, root) == {("a.p", "bool"): 60, ("b/c", "int"): 30, ("a.q", "str"): 20, ("new", "float"): 60}
    assert runs.read_run(spark, root, "other").count() == 0 and runs.read_run(spark, root, "mypy", ["VARIABLE", "CALLABLE_RETURN"]).count() == 170
    with pytest.raises(ValueError):
        runs.write_run(predictions(spark), root, "sometimes")


def test_runs_are_apart(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = predictions(spark, projects=("a.p",))
    runs.write_run(rows, root)
    runs.write_run(runs.of_run(rows.drop(*runs.RUN[:-1]), "mypy", ["VARIABLE"], ["VARIABLE"]), root, runs.ERROR)
    assert runs.read_run(spark, root).count() == 120 and runs.done(spark, root).count() == 2
    left = runs.pending(predictions(spark, projects=("a.p", "z")), root)
    assert {r.project for r in left.select("project").collect()} == {"z"}
    assert runs.run_name("mypy", ["A", "B"], ["C"]) == "mypy@[A,B]+[C]"
    with pytest.raises(ValueError, match="not removed"):
        runs.of_run(rows, "mypy", ["VARIABLE"], ["CALLABLE_RETURN"])


def training(spark, n, anno="int"):
    return spark.range(n).select(F.lit("m").alias("method"), F.lit("f").alias("file"), F.concat(F.lit("x"), "id").alias("qname_ssa"), F.lit(anno).alias("anno_gt"), F.lit(anno).alias("anno_ta"), *(F.lit(0).alias(c) for c in ("score", "loop", "reassigned", "nested", "builtin", "ctxt_category")))


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert runs.training_set(spark, root).count() == 0
    assert runs.append_once(training(spark, 5), root, "one") and not runs.append_once(training(spark, 7), root, "one")
    assert runs.training_set(spark, root).count() == 5
    real = runs.publish

    def fails(*_):
        raise OSError("lost between write and entry")

    monkeypatch.setattr(runs, "publish", fails)
    with pytest.raises(OSError):
        runs.append_once(training(spark, 9), root, "two")
    assert runs.training_set(spark, root).count() == 5  # written, but it doesn't count
    monkeypatch.setattr(runs, "publish", real)
    assert runs.append_once(training(spark, 9), root, "two")
    assert runs.training_set(spark, root).count() == 14 and runs.ledger(spark, root) == ["one", "two"]
    with pytest.raises(ValueError):
        runs.append_once(training(spark, 1), root, "../x")
    with pytest.raises(Exception, match="exist"):  # of two that publish at once one fails
        runs.publish(spark, root, "two")


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_stream_that_fails_around_its_commit(spark, tmp_path, monkeypatch, when):
    """The batch is written, the process is lost before or behind its entry in the ledger, and the stream starts again from its checkpoint."""
    context = spark.createDataFrame([("f", "VARIABLE", f"q{k}", f"q{k}", "int", "q", 0, 0, 0, 1, 0, 3, "m") for k in range(3)], "file string, category string, qname string, qname_ssa string, anno string, simple_name string, loop int, reassigned int, nested int, builtin int, branching int, ctxt_category int, method string")
    context.write.parquet(str(tmp_path / "in"))
    truth = spark.createDataFrame([("f", "VARIABLE", f"q{k}", f"q{k}", "int") for k in range(3)], schemas.ANNOTATED)
    run = lambda: labelling.label_stream(spark, str(tmp_path / "in"), truth, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(90)
    real = runs.publish

    def lost(*args):
        if when == "after":
            real(*args)
        raise OSError("lost")

    monkeypatch.setattr(runs, "publish", lost)
    with pytest.raises(Exception, match="lost"):
        run()
    assert runs.training_set(spark, str(tmp_path / "out")).count() == (3 if when == "after" else 0)
    monkeypatch.setattr(runs, "publish", real)
    run()
    run()
    assert runs.training_set(spark, str(tmp_path / "out")).count() == 3


SOURCES = [("p", "a.py", "a[0] = 1\nx: int = 2\nfoo = ...\n", None), ("p", "b.py", "def (\n", None), ("q", "c.py", "y = 1\n", None), ("q", "d.py", None, "not UTF-8"), ("q", "pkg/e.py", "from .m import T\nz: T = 1\nb.c: int = 3\n", None)]


def test_messages_come_from_the_pass_that_extracts(spark, tmp_path):
    sources = spark.createDataFrame(SOURCES, "project string, file string, code string, error string").repartition(3)
    path = str(tmp_path / "log")
    told = {}
    assert jobs(spark, lambda: told.update(runs.write_logged(extract.logged_symbols(sources), path, extract.SYMBOL_COLUMNS))) <= 3
    assert told == {"success": 3, "failure": 2, "warning": 3, "skip": 0} and sum(told.values()) == spark.read.parquet(path).count()
    assert sorted((r.project, r.file, r.level, r.message) for r in runs.messages(spark, path).collect()) == [
        ("p", "a.py", "warning", "line 1: no symbol in a[0] = 1"), ("p", "a.py", "warning", "line 3: no symbol in foo = ..."), ("p", "b.py", "error", "invalid syntax (<unknown>, line 1)"),
        ("q", "d.py", "error", "not UTF-8"), ("q", "pkg/e.py", "warning", "line 3: no symbol in b.c: int = 3"),
    ]
    assert {(r.file, r.qname_ssa, r.anno) for r in runs.results(spark, path).collect()} == {("a.py", "xλ1", "builtins.int"), ("c.py", "yλ1", None), ("pkg/e.py", "zλ1", "pkg.m.T")}
    assert {r.project: (r.errors, r.warnings) for r in runs.summary(spark, path).collect()} == {"p": (1, 2), "q": (1, 1)}


def test_four_states(spark):
    df = spark.createDataFrame([("e", "w", True), (None, "w", True), (None, None, True), (None, None, False), (None, None, None)], "error string, warning string, there boolean")
    rows, tally = runs.tallied(df.withColumn("state", runs.state(skipped=F.col("there"))))
    assert [r.state for r in rows.collect()] == ["failure", "warning", "skip", "success", "success"]
    assert tally.get == {"success": 2, "failure": 1, "warning": 1, "skip": 1}


def test_command_line(spark, tmp_path, capsys):
    top = tmp_path / scans.MANYTYPES
    for name, code in (("me/p/__init__.py", "def f(a: int) -> str: ...\n"), ("me/q/m.py", "x: (int) = 1\n"), ("me/q/bad.py", "def (")):
        path = top / "repos" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(code)
    out = str(tmp_path / "out")
    assert cli.main(["infer", str(top), str(top), out]) == 0
    got = {(r.project, r.file, r.qname_ssa, r.anno) for r in runs.read_run(spark, out).collect()}
    assert got == {("me.p", "__init__.py", "f", "builtins.str"), ("me.p", "__init__.py", "f.a", "builtins.int"), ("me.q", "m.py", "xλ1", "builtins.int")}
    (top / "repos/me/q/m.py").write_text("x: str = 1\n")
    cli.main(["infer", str(top), str(top), out])
    assert {(r.project, r.file, r.qname_ssa, r.anno) for r in runs.read_run(spark, out).collect()} == got  # skipped
    cli.main(["infer", str(top), str(top), out, "--overwrite", "--infer", "VARIABLE", "--remove", "VARIABLE"])
    assert {(r.qname_ssa, r.anno) for r in runs.read_run(spark, out, removed=["VARIABLE"]).collect()} == {("xλ1", "builtins.str")}
    cli.main(["dataset", str(top / "repos"), str(tmp_path / "data")])
    assert "1 failure" in capsys.readouterr().out
    cli.main(["hintdiff", str(top / "repos/me/p"), str(top / "repos/me/p"), "--statistic", "accuracy"])
    assert "1.0" in capsys.readouterr().out
    for k, agent in enumerate(("static", "dynamic", "probabilistic")):
        spark.createDataFrame([("f", "VARIABLE", "q", "q", "int" if k else "str", agent, 1)], schemas.PREDICTIONS).write.option("header", "true").csv(str(tmp_path / agent))
    for resolver, want in (("delegation", "str"), ("agreement", None), ("majority", "int")):
        cli.main(["icr", *(str(tmp_path / x) for x in ("static", "dynamic", "probabilistic")), str(tmp_path / resolver), "--resolver", resolver])
        assert [r.anno for r in spark.read.parquet(str(tmp_path / resolver)).collect()] == [want]
    context = spark.createDataFrame([("f", "VARIABLE", "q", "q", "int", "q", 0, 0, 0, 1, 0, 3, "m")], "file string, category string, qname string, qname_ssa string, anno string, simple_name string, loop int, reassigned int, nested int, builtin int, branching int, ctxt_category int, method string")
    context.write.parquet(str(tmp_path / "context"))
    spark.createDataFrame([("f", "VARIABLE", "q", "q", "int")], schemas.ANNOTATED).write.option("header", "true").csv(str(tmp_path / "truth"))
    for _ in range(2):
        cli.main(["logregr", str(tmp_path / "truth"), str(tmp_path / "context"), str(tmp_path / "train"), "--batch", "b1"])
    assert "is there already" in capsys.readouterr().out
    assert [r.score for r in runs.training_set(spark, str(tmp_path / "train")).collect()] == [1]
