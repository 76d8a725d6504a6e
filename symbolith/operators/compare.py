"""Comparison of ground truth with predictions: common symbols, equal annotations, coverage, accuracy, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SYMBOL_KEY


def symbol_commonality(left: DataFrame, right: DataFrame, keys: list[str] = SYMBOL_KEY) -> DataFrame:
    """Full outer join with `presence`: both, left_only or right_only. Other columns get _x and _y. Repeated keys fan out."""
    x = left.select(*keys, *(F.col(c).alias(f"{c}_x") for c in left.columns if c not in keys), F.lit(True).alias("__l"))
    y = right.select(*keys, *(F.col(c).alias(f"{c}_y") for c in right.columns if c not in keys), F.lit(True).alias("__r"))
    presence = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return x.join(y, keys, "full_outer").withColumn("presence", presence).drop("__l", "__r")


def annotation_bucket(truth: Column, inferred: Column) -> Column:
    """missing: nothing inferred; exact and differing: both there; no_gt: inferred without a truth."""
    return F.when(inferred.isNull(), "missing").when(truth.isNull(), "no_gt").when(truth == inferred, "exact").otherwise("differing")


def annotation_commonality(truth: DataFrame, inferred: DataFrame, keys: list[str] = SYMBOL_KEY) -> DataFrame:
    """The symbols of truth with anno_gt, anno_it and their bucket."""
    a = truth.select(*keys, F.col("anno").alias("anno_gt"))
    b = inferred.select(*keys, F.col("anno").alias("anno_it"))
    return a.join(b, keys, "left").withColumn("bucket", annotation_bucket(F.col("anno_gt"), F.col("anno_it")))


def bucket_counts(df: DataFrame, bucket: str) -> DataFrame:
    return df.groupBy(bucket).agg(F.count("*").alias("n"))


def coverage() -> Column:
    """The share of annotated rows; null for no row."""
    return F.avg(F.when(F.col("anno").isNotNull(), 1.0).otherwise(0.0)).alias("coverage")


def accuracy(truth: str = "anno_gt", inferred: str = "anno") -> Column:
    """The share of equal annotations, null and `-` being one value."""
    return F.avg((F.coalesce(truth, F.lit("-")) == F.coalesce(inferred, F.lit("-"))).cast("double")).alias("accuracy")


#: Statistics by name: a column to aggregate per repository.
STATISTICS = {"coverage": coverage, "accuracy": accuracy}


def statistic(df: DataFrame, name: str, by: str = "repository") -> DataFrame:
    return df.groupBy(by).agg(STATISTICS[name.lower()]())


def score(truth: Column, predicted: Column) -> Column:
    """-1 without a prediction, 1 if it is right, else 0."""
    return F.when(predicted.isNull(), -1).when(predicted == truth, 1).otherwise(0)


def training_rows(truth: DataFrame, context: DataFrame, keys: list[str] = SYMBOL_KEY) -> DataFrame:
    """The rows of context, with method and features, labelled by ground truth without nulls."""
    a = truth.dropna().select(*keys, F.col("anno").alias("anno_gt"))
    b = context.withColumnRenamed("anno", "anno_ta")
    joined = a.join(b, keys, "right").withColumn("score", score(F.col("anno_gt"), F.col("anno_ta")))
    return joined.select("method", "file", "qname_ssa", "anno_gt", "anno_ta", "score", "loop", "reassigned", "nested", "builtin", "ctxt_category")


def differing_trees(files: DataFrame, root: str = "root", path: str = "path") -> DataFrame:
    """Paths that don't stand below every root."""
    n = files.select(F.count_distinct(root).alias("roots"))
    return files.groupBy(path).agg(F.count_distinct(root).alias("n")).crossJoin(F.broadcast(n)).filter("n < roots").select(path, "n")


def single_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the number of different values over columns."""
    return df.withColumn("n_values", F.size(F.array_distinct(F.array(*columns))))
