"""Sinks: tables by tool and project, appended training rows, annotated source trees, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ANNOTATED, CONTEXT, PREDICTIONS, assert_schema
from .tree import Local, store


def _write(df: DataFrame, path: str, schema: T.StructType, kind: str, exists: str) -> None:
    """Columns are picked by name, never by place. exists: ignore, errorifexists, overwrite or append."""
    out = df.select(*schema.names).write.mode(exists)
    out.option("header", "true").option("nullValue", "").csv(path) if kind == "csv" else out.parquet(path)


def write_predictions(df: DataFrame, path: str, kind: str = "parquet", exists: str = "errorifexists") -> None:
    _write(df, path, PREDICTIONS, kind, exists)


def write_context_vectors(df: DataFrame, path: str, kind: str = "parquet", exists: str = "errorifexists") -> None:
    _write(df, path, CONTEXT, kind, exists)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Compressed JSON lines without null fields."""
    df.write.option("compression", "gzip").option("ignoreNullFields", "true").json(path)


def write_sources(df: DataFrame, root: str) -> None:
    """Each row's code as the file of its name below root, a mounted folder that all executors share."""
    top = store(root)
    if not isinstance(top, Local):
        raise ValueError(f"not a mounted folder: {root}")
    top = top.root

    def put(rows):
        import os

        for row in rows:
            path = os.path.join(top, row.file)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8", newline="") as out:
                out.write(row.code or "")

    df.select("file", "code").foreachPartition(put)


def write_functions(df: DataFrame, path: str, exists: str = "errorifexists") -> None:
    """A function frame as CSV, lists as JSON; the header stands also over no row."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    flat = df.select(*(F.to_json(c).alias(c) if c in lists else F.col(c) for c in df.columns))
    flat.write.mode(exists).option("header", "true").option("nullValue", "").option("escape", '"').csv(path)


def write_collection(df: DataFrame, path: str, exists: str = "errorifexists") -> None:
    """Annotated symbols; read_collection gives back the same rows."""
    _write(df, path, ANNOTATED, "parquet", exists)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return assert_schema(spark.read.schema(ANNOTATED).parquet(path), ANNOTATED)


def updated(collection: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all collections, by name; a collection of another schema is an error."""
    out = assert_schema(collection, ANNOTATED).select(*ANNOTATED.names)
    for other in others:
        out = out.unionByName(assert_schema(other, ANNOTATED).select(*ANNOTATED.names))
    return out


def tallies(df: DataFrame, error: str = "error") -> DataFrame:
    """How many rows came out well and how many with an error. runs.tallied counts four states in the pass that writes the rows."""
    return df.groupBy(F.when(F.col(error).isNull(), "ok").otherwise("failed").alias("status")).count()
