"""Predictors: plug-ins that turn sources into ranked predictions. External tools and their models are no part of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PREDICTIONS, assert_schema
from ..shipping import ship
from .align import nth_with_nth
from .extract import annotated_symbols
from .select import ranked, top_of_distribution


class Predictor(Protocol):
    def method(self) -> str: ...

    def predict(self, sources: DataFrame) -> DataFrame:
        """Predictions for sources (file, code) in the schema PREDICTIONS."""
        ...


REGISTRY: dict[str, type] = {}


def register(cls: type) -> type:
    REGISTRY[cls.__name__.lower()] = cls
    return cls


def factory(name: str) -> type:
    return REGISTRY[name.lower()]


@register
class Declared:
    """Predicts the annotations that another version of the sources declares (stubs, or a tool's annotated copy)."""

    def __init__(self, annotated: DataFrame, name: str = "declared"):
        self.annotated, self.name = annotated, name

    def method(self) -> str:
        return self.name

    def predict(self, sources: DataFrame) -> DataFrame:
        there, wanted = annotated_symbols(self.annotated), annotated_symbols(sources).drop("anno", "qname_ssa")
        found = nth_with_nth(wanted, there, ["file", "category", "qname"])
        named = F.when(F.col("category") == "VARIABLE", F.concat("qname", F.lit("λ"), F.col("n").cast("string"))).otherwise(F.col("qname"))
        out = found.select("file", "category", "qname", named.alias("qname_ssa"), "anno", F.lit(self.name).alias("method"), F.lit(1).alias("topn"))
        return assert_schema(out, PREDICTIONS)


@register
class Ranked:
    """Predicts the n likeliest types of distributions: file, category, qname, qname_ssa, distribution."""

    def __init__(self, distributions: DataFrame, n: int = 10, name: str = "ranked"):
        self.distributions, self.n, self.name = distributions, n, name

    def method(self) -> str:
        return f"{self.name}N{self.n}"

    def predict(self, sources: DataFrame) -> DataFrame:
        own = self.distributions.join(sources.select("file").distinct(), "file", "left_semi")
        best = own.withColumn("best", top_of_distribution(F.col("distribution"), self.n)).drop("distribution")
        rows = ranked(best, "best", "e").withColumn("anno", F.col("e.anno")).withColumn("method", F.lit(self.method()))
        return assert_schema(rows.select(*PREDICTIONS.names), PREDICTIONS)


#: What inference gives: predictions, and of files or projects that failed one row with the error and nulls.
INFERRED = T.StructType([*(T.StructField(f.name, f.dataType) for f in PREDICTIONS.fields), T.StructField("error", T.StringType())])


def _inferred(work: Callable[[], Iterable[tuple]], file: str | None, method: str) -> list[tuple]:
    """Rows of INFERRED from work's rows (file, category, qname, qname_ssa, anno, topn). One that fails has no part of its rows."""
    try:
        return [(*row[:5], method, row[5], None) for row in work()]
    except Exception as e:  # a tool may raise anything; the other files must go on
        return [(file, None, None, None, None, method, None, f"{type(e).__name__}: {e}")]


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32() if f.dataType == T.IntegerType() else pa.string() for f in INFERRED.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], INFERRED.names)


def per_file(sources: DataFrame, infer: Callable[[str, str], Iterable[tuple]], method: str, subset: DataFrame | None = None) -> DataFrame:
    """INFERRED rows of a tool that sees one file: infer(file, code) gives (category, qname, qname_ssa, anno, topn). subset: a frame of
    `file`s, others aren't worked on."""
    if subset is not None:
        sources = sources.join(subset.select("file").distinct(), "file", "left_semi")

    def over(batches):
        for batch in batches:
            for file, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows := _inferred(lambda f=file, c=code: [(f, *row) for row in infer(f, c or "")], file, method):
                    yield _batch(rows)

    ship(sources.sparkSession)
    return sources.select("file", "code").mapInArrow(over, INFERRED)


def project_wide(sources: DataFrame, infer: Callable[[dict[str, str]], Iterable[tuple]], method: str, subset: DataFrame | None = None, project: str = "project") -> DataFrame:
    """INFERRED rows of a tool that needs a project's files together: infer(code by file) gives (file, category, qname, qname_ssa, anno,
    topn). subset: a frame of `project` and `file`s; the tool sees all files, rows of others are left out. A project's files bound a group."""

    def over(table):
        import pyarrow as pa

        code = dict(zip(table.column("file").to_pylist(), (c or "" for c in table.column("code").to_pylist()), strict=True))
        name = str(table.column(project)[0].as_py())
        rows = _inferred(lambda: infer(code), None, method)
        out = pa.Table.from_batches([_batch(rows)]) if rows else pa.Table.from_batches([_batch([(None,) * len(INFERRED)])]).slice(0, 0)
        return out.append_column(project, pa.array([name] * len(rows), pa.string()))

    ship(sources.sparkSession)
    schema = T.StructType([*INFERRED.fields, T.StructField(project, T.StringType())])
    found = sources.select(project, "file", "code").groupBy(project).applyInArrow(over, schema)
    if subset is not None:
        wanted = subset.select(F.col(project).cast("string").alias(project), "file").distinct()
        found = found.filter("error is not null").unionByName(found.filter("error is null").join(wanted, [project, "file"], "left_semi"))
    return found
