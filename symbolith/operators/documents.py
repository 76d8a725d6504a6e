"""Nested documents, file -> scope -> predictions, from flat rows and back, and rows by rank or provenance."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import argument_of, function_of
from .align import cursor_match

#: Categories of scope documents. Fixed values.
KINDS = {"arg": "CALLABLE_PARAMETER", "return": "CALLABLE_RETURN", "local": "VARIABLE"}


def nested_documents(predictions: DataFrame) -> DataFrame:
    """file and document (JSON) of predictions: file, scope, category, name, topn, anno. Of each name the types by rank; names
    in order within a scope. A file's predictions bound a group."""
    ranked = F.sort_array(F.collect_list(F.struct("topn", "anno")))
    names = predictions.groupBy("file", "scope", "category", "name").agg(F.transform(ranked, lambda r: r["anno"]).alias("type"))
    scopes = names.groupBy("file", "scope").agg(F.sort_array(F.collect_list(F.struct("category", "name", "type"))).alias("found"))
    lists = scopes.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("scope", "found"))).alias("scopes"))
    return lists.select("file", F.to_json(F.map_from_entries("scopes")).alias("document"))


def cursor_documents(slots: DataFrame, predictions: DataFrame) -> DataFrame:
    """nested_documents of what a cursor finds for slots (file, ord, name, where name is scope.name)."""
    found = cursor_match(slots, predictions).filter("anno is not null")
    flat = found.select("file", function_of(F.col("name")).alias("scope"), F.lit("arg").alias("category"), argument_of(F.col("name")).alias("name"), F.col("ord").alias("topn"), "anno")
    return nested_documents(flat)


def scope_annotations(scopes: DataFrame) -> DataFrame:
    """Symbols with their annotations, of rows file, scope (qname of a function, empty for the module), method, category,
    name, topn and anno: locals stand under scope.name and scope.self.name, methods have a parameter self, nulls of locals are left out."""
    under = lambda name: F.concat_ws(".", F.nullif("scope", F.lit("")), name)
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("category")]
    local = F.col("category") == "local"
    qname = F.when(F.col("category") == "return", F.array("scope")).when(local, F.array(under(F.col("name")), under(F.concat(F.lit("self."), "name")))).otherwise(F.array(under(F.col("name"))))
    named = scopes.filter(~(local & F.col("anno").isNull())).select("file", kind.alias("category"), F.explode(qname).alias("qname"), "topn", "anno")
    selfs = scopes.filter("method").select("file", F.lit(KINDS["arg"]).alias("category"), under(F.lit("self")).alias("qname"), F.lit(1).alias("topn"), F.lit(None).cast("string").alias("anno")).distinct()
    return named.unionByName(selfs)


def batchify(df: DataFrame, *lists: str) -> DataFrame:
    """A row for each rank of list columns, which are as long as the longest; shorter ones end in nulls."""
    rest = [c for c in df.columns if c not in lists]
    one = df.select(*rest, F.posexplode(F.arrays_zip(*lists)).alias("__p", "__e"))
    return one.select(*rest, (F.col("__p") + 1).alias("topn"), *(F.col(f"__e.{c}").alias(c) for c in lists))


def by_rank(df: DataFrame, most: int) -> dict[int, DataFrame]:
    """df by topn from 1 to `most`. As a table, write df partitioned by topn instead."""
    return {k: df.filter(F.col("topn") == k).drop("topn") for k in range(1, most + 1)}


def by_provenance(df: DataFrame, provenance: str = "provenance") -> DataFrame:
    """Rows of one provenance as a list. All of them: not only adjacent ones, and none is overwritten."""
    rest = [c for c in df.columns if c != provenance]
    return df.groupBy(provenance).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))


def without_ignored(df: DataFrame, ignored: Callable[[Column], Column], anno: str = "original_annotation") -> DataFrame:
    """Rows whose annotation a predicate doesn't tell to ignore; a null annotation stays."""
    return df.filter(~F.coalesce(ignored(F.col(anno)), F.lit(False)))


def display_sample(df: DataFrame, *order, n: int = 20, seed: int = 0) -> DataFrame:
    """At most n rows, drawn by a hash of the seed and the row, in order: for show only."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(n).orderBy(*order)


def string_list(text: Column) -> Column:
    """The strings (and nulls, of None) that a list or tuple written in Python holds, such as ['a', "b"] or ('a',); null for anything
    else. For old tables: what this package writes has arrays."""

    def literal(text: str | None) -> list[str | None] | None:
        try:
            found = ast.literal_eval((text or "").strip())
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return list(found) if isinstance(found, (list, tuple)) and all(x is None or isinstance(x, str) for x in found) else None

    @F.arrow_udf("array<string>")  # needs nothing of this package on the executors
    def parsed(column):
        import pyarrow as pa

        return pa.array(map(literal, column.to_pylist()), pa.list_(pa.string()))

    return parsed(text)
