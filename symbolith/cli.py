"""Command line over source trees and tables: dataset, context, strip, infer, icr, logregr, harness, hintdiff, annotate and srcdiff."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import compare, extract, predict, resolve, resolvers, rewrite, select
from .schemas import CATEGORIES
from .session import local_session
from .sources import runs, scans, sinks

_KINDS = {"VARIABLE": "variables", "CALLABLE_PARAMETER": "parameters", "CALLABLE_RETURN": "returns"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("symbolith", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "dataset": ["root", "out"], "context": ["root", "out"], "strip": ["root", "out"], "infer": ["dataset", "annotated", "out"], "harness": ["truth", "inferred"], "srcdiff": ["left", "right"],
        "hintdiff": ["truth", "inferred"], "icr": ["static", "dynamic", "probabilistic", "out"], "logregr": ["truth", "context", "out"], "annotate": ["root", "predictions", "out"],
    }.items():
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
        one.add_argument("--overwrite", action="store_true")
        if name == "infer":
            one.add_argument("--tool", default="declared", choices=["declared"])
            one.add_argument("--remove", nargs="+", choices=CATEGORIES, default=list(CATEGORIES))
            one.add_argument("--infer", nargs="+", choices=CATEGORIES, default=list(CATEGORIES))
        if name == "icr":
            one.add_argument("--resolver", default="delegation", choices=["delegation", "agreement", *(r.lower() for r in resolve.RULES)])
            one.add_argument("--hierarchy", help="a table derived, base, place; needed for voting")
        if name == "logregr":
            one.add_argument("--batch", required=True, help="a name; a batch is appended once")
        if name == "hintdiff":
            one.add_argument("--statistic", default="coverage", choices=sorted(compare.STATISTICS))
    return p


def infer(spark, a) -> None:
    """Predictions for every project of a data set that has none yet in this run; annotations are removed first, and put aside as what the tool declares."""
    files = scans.data_set(spark, a.dataset).filter("error is null").withColumn("project", F.concat_ws(".", "author", "project"))
    run = lambda df: runs.of_run(df, a.tool, a.remove, a.infer)
    if not a.overwrite:
        files = runs.pending(run(files), a.out).drop(*runs.RUN[:-1])
    placed = files.withColumn("file", F.concat("project", F.lit("/"), "file"))
    bare = rewrite.strip_sources(placed, **{kind: c in a.remove for c, kind in _KINDS.items()})
    annotated = scans.data_set(spark, a.annotated).select(F.concat(F.concat_ws(".", "author", "project"), F.lit("/"), "file").alias("file"), "code")
    found = select.of_categories(predict.factory(a.tool)(annotated).predict(bare), a.infer)
    project = F.substring_index("file", "/", 1)
    out = found.withColumn("project", project).withColumn("file", F.expr("substr(file, length(project) + 2)"))
    runs.write_run(run(out), a.out, runs.REPLACE if a.overwrite else runs.SKIP)


def icr(spark, a):
    agents = {n: scans.predictions(spark, getattr(a, n)) for n in resolve.DEFAULT_ORDER}
    every = resolvers.tagged(agents)
    keys = ["file", "category", "qname_ssa"]
    if a.resolver == "delegation":
        return resolve.delegation(every, "topn")
    if a.resolver == "agreement":
        return resolvers.by_symbol(resolvers.Agreement(), every, every.select(*keys).distinct(), ties=("anno",))
    types = spark.read.parquet(a.hierarchy) if a.hierarchy else {}
    rule = next(r for r in resolve.RULES if r.lower() == a.resolver)
    return resolve.voting(every, types, F.col("agent"), F.col("topn"), rule=rule, keys=keys)


def hintdiff(spark, a):
    x, y = (extract.annotated_symbols(scans.sources(spark, r)).drop("ord") for r in (a.truth, a.inferred))
    if a.statistic == "coverage":
        found = x.withColumn("repository", F.lit(a.truth)).unionByName(y.withColumn("repository", F.lit(a.inferred)))
    else:
        both = compare.annotation_commonality(x, y)
        found = both.select("anno_gt", F.col("anno_it").alias("anno"), F.lit(a.inferred).alias("repository"))
    return compare.statistic(found, a.statistic)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark, exists = local_session(), "overwrite" if a.overwrite else "errorifexists"
    if a.command == "dataset":
        files = scans.sources(spark, a.root).withColumn("project", F.lit(a.root))
        told = runs.write_logged(extract.logged_symbols(files), a.out, extract.SYMBOL_COLUMNS, mode=exists)
        print(", ".join(f"{n} {s}" for s, n in told.items()))
    elif a.command == "context":
        sinks.write_context_vectors(extract.context_vectors(scans.sources(spark, a.root)), a.out, exists=exists)
    elif a.command == "strip":
        sinks.write_sources(rewrite.strip_sources(scans.sources(spark, a.root)), a.out)
    elif a.command == "infer":
        infer(spark, a)
    elif a.command == "harness":
        x, y = (extract.annotated_symbols(scans.sources(spark, r)).drop("ord") for r in (a.truth, a.inferred))
        compare.bucket_counts(compare.symbol_commonality(x, y), "presence").show()
        compare.bucket_counts(compare.annotation_commonality(x, y), "bucket").show()
    elif a.command == "hintdiff":
        hintdiff(spark, a).show(truncate=False)
    elif a.command == "icr":
        icr(spark, a).write.mode(exists).parquet(a.out)
    elif a.command == "logregr":
        context = spark.read.parquet(a.context)
        if not runs.append_once(compare.training_rows(scans.annotated_symbols(spark, a.truth), context), a.out, a.batch):
            print(f"batch {a.batch} is there already")
    elif a.command == "annotate":
        best = select.top_predictions(scans.predictions(spark, a.predictions), "anno")
        sinks.write_sources(rewrite.apply_predictions(scans.sources(spark, a.root), best), a.out)
    else:
        left, right = (scans.sources(spark, r).withColumn("file", F.lit("x.py")) for r in (a.left, a.right))
        print(rewrite.source_diff(left, right).first().code, end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
