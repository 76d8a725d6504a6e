"""Scans of source trees, split files, prediction tables and documents."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ANNOTATED, CONTEXT, PREDICTIONS
from ..shipping import ship
from .tree import SourceTree

#: Folder names of data sets whose layout is known. Fixed values.
MANYTYPES, BETTERTYPES, PROJECT = "many-types-4-py-dataset", "better-types-4-py-dataset", "project"

GRAPH_PREDICTIONS = "array<struct<annotation_type:string,location:array<int>,name:string,node_id:int,original_annotation:string,predicted_annotation_logprob_dist:array<struct<anno:string,logprob:double>>,provenance:string>>"
NESTED_PREDICTIONS = "map<string,map<string,array<struct<category:string,name:string,type:array<string>>>>>"


def layout(path: str) -> str:
    """Of a data set's folder, by its name in lower case."""
    name = os.path.basename(path.rstrip("/")).lower()
    return name if name in (MANYTYPES, BETTERTYPES) else PROJECT


def sources(spark: SparkSession, root: str, stubs: bool = False, subset: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """file (below root), code and error of each Python file below root, or of root itself, in one pass: __init__.py and hidden names
    too. A file or folder that can't be read, or a file that isn't UTF-8, has an error and no code. subset: a frame of `file`s, others
    aren't kept; names without a file are silently left out. depth: see tree."""
    ship(spark)
    spark.dataSource.register(SourceTree)
    read = spark.read.format("source_tree").option("suffixes", ".py,.pyi" if stubs or root.endswith(".pyi") else ".py").option("depth", depth)
    found = read.option("partition_bytes", spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()).load(root)
    if subset is not None:
        found = found.join(subset.select("file").distinct(), "file", "left_semi")
    code = F.try_validate_utf8(F.col("content").cast("string"))
    return found.select("file", code.alias("code"), F.when(F.col("error").isNotNull(), F.col("error")).when(code.isNull(), "not UTF-8").alias("error"))


def split_rows(rows: DataFrame, split: str = "test") -> DataFrame:
    """author, project and files (sorted) of one split of rows split, filepath (quoted, with or without a leading repos/)."""
    rows = rows.filter(F.col("split") == split)
    parts = F.split(F.regexp_replace(F.trim(F.col("filepath"), F.lit('"')), "^repos/", ""), "/", 3)
    named = rows.select(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("author", "project", "file"))))
    return named.groupBy("author", "project").agg(F.array_sort(F.collect_set("file")).alias("files"))


def split_file(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """split_rows of a CSV without header."""
    return split_rows(spark.read.schema("split string, filepath string").csv(path), split)


def crawl(spark: SparkSession, root: str) -> DataFrame:
    """author, project, file, code and error of every Python file below author/project folders; what can't be read has an error and
    doesn't stop the rest."""
    parts = F.split("file", "/", 3)
    return sources(spark, root, depth=2).filter(F.size(parts) == 3).select(parts[0].alias("author"), parts[1].alias("project"), parts[2].alias("file"), "code", "error")


def projects(files: DataFrame) -> DataFrame:
    """author and project of paths author/project/...; authors that begin with a dot are left out."""
    parts = F.split("file", "/", 3)
    found = files.select(F.get(parts, F.lit(0)).alias("author"), F.get(parts, F.lit(1)).alias("project"), F.get(parts, F.lit(2)).alias("file"))
    return found.filter(~F.col("author").startswith(".") & F.col("file").isNotNull()).groupBy("author", "project").agg(F.array_sort(F.collect_set("file")).alias("files"))


def test_folder(spark: SparkSession, root: str) -> DataFrame:
    """author, project and files of the Python files below repos/test of root, where folders are named author__project."""
    found = sources(spark, f"{root}/repos/test").select(F.split("file", "/", 2).alias("p")).filter("size(p) = 2")
    named = found.select(F.split(F.col("p")[0], "__").alias("n"), F.col("p")[1].alias("file")).filter("size(n) = 2")
    return named.groupBy(F.col("n")[0].alias("author"), F.col("n")[1].alias("project")).agg(F.array_sort(F.collect_set("file")).alias("files"))


def data_set(spark: SparkSession, root: str) -> DataFrame:
    """author, project, file, code and error of every Python file of a data set, whose folder's name tells where projects lie: by
    author, as author__project, or the folder itself, which is then both author and project."""
    kind, name = layout(root), os.path.basename(root.rstrip("/"))
    if kind == MANYTYPES:
        return crawl(spark, f"{root}/repos").filter(~F.col("author").startswith("."))
    if kind == PROJECT:
        return sources(spark, root).select(F.lit(name).alias("author"), F.lit(name).alias("project"), "file", "code", "error")
    parts = F.split("file", "/", 2)
    found = sources(spark, f"{root}/repos/test").filter(F.size(parts) == 2).withColumn("__n", author_and_repo(parts[0]))
    return found.select("__n.author", F.col("__n.repo").alias("project"), parts[1].alias("file"), "code", "error")


def test_set(spark: SparkSession, root: str) -> DataFrame:
    """author, project and files (sorted) of a data set's test split; of a single project all files."""
    kind = layout(root)
    if kind == MANYTYPES:
        return split_file(spark, f"{root}/data/dataset_split.csv")
    if kind != PROJECT:
        return test_folder(spark, root)
    return data_set(spark, root).groupBy("author", "project").agg(F.array_sort(F.collect_set("file")).alias("files"))


def author_and_repo(name: Column) -> Column:
    """Both parts of author__repo; anything else is an error."""
    parts = F.split(name, "__")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("author"), parts[1].alias("repo"))).otherwise(F.raise_error(F.concat(F.lit("not author__repo: "), name)))


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("nullValue", "").csv(path)


def annotated_symbols(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ANNOTATED)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, PREDICTIONS)


def context_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, CONTEXT)


def graph_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One row per prediction of compressed JSON lines, each of which is a list of predictions."""
    return spark.read.text(path).select(F.explode(F.from_json("value", GRAPH_PREDICTIONS)).alias("p")).select("p.*")


def scopes_of(text: DataFrame) -> DataFrame:
    """file, scope, category, name, topn and anno of JSON documents (value): file -> scope -> predictions."""
    files = text.select(F.explode(F.from_json("value", NESTED_PREDICTIONS)).alias("file", "scopes"))
    one = files.select("file", F.explode("scopes").alias("scope", "found")).select("file", "scope", F.explode("found").alias("p"))
    return one.select("file", "scope", "p.category", "p.name", F.posexplode("p.type").alias("pos", "anno")).select("file", "scope", "category", "name", (F.col("pos") + 1).alias("topn"), "anno")


def inferred_scopes(spark: SparkSession, path: str) -> DataFrame:
    return scopes_of(spark.read.text(path, wholetext=True))


def type_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """type and rank (from 0, by line) of a list of types, a CSV with a header; some thousand rows, to be broadcast."""
    rows = spark.read.option("header", "true").csv(path)
    name = rows.columns[-1]
    return rows.select(F.col(name).alias("type"), F.monotonically_increasing_id().alias("__n")).withColumn("rank", F.row_number().over(Window.orderBy("__n")) - 1).drop("__n")


def with_stubs(code: DataFrame, stubs: DataFrame) -> DataFrame:
    """code with the text of each file's stub, null without one."""
    named = stubs.select(F.regexp_replace("file", r"\.pyi$", ".py").alias("file"), F.col("code").alias("stub"))
    return code.join(named.hint("merge"), "file", "left")  # never a broadcast: Spark guesses far too few bytes for texts
