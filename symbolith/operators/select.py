"""Selection: best ranked, first, unique and most frequent rows, distributions, and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import known_or_any
from ..schemas import SELECT_KEY


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an explicit order. Spark keeps one row a key before it shuffles (window group limit)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def top_predictions(df: DataFrame, *ties, keys: list[str] = SELECT_KEY) -> DataFrame:
    """The best ranked prediction of each symbol, of equal ranks the first by ties; without method and topn. Rows with a
    null key are left out."""
    return first_per(df.dropna(subset=keys), keys, "topn", *ties).drop("method", "topn")


def first_source_wins(frames: list[DataFrame], keys: list[str], *order) -> DataFrame:
    """Rows of all frames by name, of equal keys that of the earliest frame, there the first in order."""
    tagged = [f.withColumn("__rank", F.lit(k)) for k, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return first_per(out, keys, "__rank", *order).drop("__rank")


def unique_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key stands once."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def assert_unique(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """df as it is; a key that stands twice (among rows that `where` holds for) fails the job that reads it, with the key in the error.
    The count is a window, so it costs a shuffle only where rows aren't dealt by their keys already."""
    hit = F.lit(1) if where is None else F.when(where, 1)
    said = F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in keys))
    n = F.count(hit).over(Window.partitionBy(*keys))
    checked = df.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("a key stands more than once: "), said)).cast("boolean")).otherwise(True))
    return checked.filter("__ok").drop("__n", "__ok")


def best_of(df: DataFrame, keys: list[str], n: int, name: str = "anno", score: str = "logprob") -> DataFrame:
    """Per key the n likeliest of its (name, score) rows as an array `best` like that of top_of_distribution, and no other row: tasks
    keep n rows of a key before they shuffle, so a key with any number of rows costs n a task. Of equal scores the larger name comes first."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.desc_nulls_last(name)))
    kept = df.select(*keys, F.col(name).alias("anno"), F.col(score).alias("logprob")).withColumn("__n", place).filter(F.col("__n") <= n)
    lists = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__n", "anno", "logprob"))).alias("__l"))
    return lists.select(*keys, top_of_distribution(F.col("__l"), n).alias("best"))


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return df.groupBy(*keys).count().filter("count > 1")


def frequency_vote(df: DataFrame, keys: list[str], value: str = "anno", method: str = "method") -> DataFrame:
    """Per key the one value that several rows have, if there is just one such, with its methods joined by +."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"), F.array_join(F.array_sort(F.collect_set(method)), "+").alias(method))
    often = counted.filter("votes > 1").withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    return often.filter("__n = 1").drop("__n")


def top_of_distribution(distribution: Column, n: int) -> Column:
    """Of an array of (anno, logprob) the n likeliest, unknown ones as typing.Any, filled up to n with (typing.Any, -1000)."""
    best = F.slice(F.reverse(F.array_sort(F.transform(distribution, lambda d: F.struct(d["logprob"].alias("logprob"), d["anno"].alias("anno"))))), 1, n)
    named = F.transform(best, lambda d: F.struct(known_or_any(d["anno"]).alias("anno"), d["logprob"].cast("double").alias("logprob")))
    filler = F.struct(F.lit("typing.Any").alias("anno"), F.lit(-1000.0).alias("logprob"))
    return F.slice(F.concat(named, F.array_repeat(filler, n)), 1, n)


def ranked(df: DataFrame, values: str, name: str = "anno") -> DataFrame:
    """A row for each value of a ranked array, with topn from 1."""
    return df.select(*(c for c in df.columns if c != values), F.posexplode(values).alias("__p", name)).withColumn("topn", F.col("__p") + 1).drop("__p")


def rank_probability(rank: Column) -> Column:
    """A half, a quarter, and so on for ranks from 1."""
    return 1 / F.pow(F.lit(2.0), rank)


def usable_arguments(df: DataFrame, name: str = "arg_name", kind: str = "arg_type") -> DataFrame:
    """Arguments but self and those of type Any or None; a null type counts as usable."""
    return df.filter((F.col(name) != "self") & ~F.coalesce(kind, F.lit("")).isin("Any", "None"))


def usable_returns(df: DataFrame, kind: str = "return_type", expressions: str = "return_expr") -> DataFrame:
    return df.filter(~F.coalesce(kind, F.lit("")).isin("nan", "None", "Any") & (F.size(expressions) > 0))


def with_hints(df: DataFrame, *lists: str) -> DataFrame:
    """Rows of which any list has an element."""
    return df.filter(sum((F.greatest(F.size(c), F.lit(0)) for c in lists), F.lit(0)) > 0)


def from_files(df: DataFrame, files: DataFrame, provenance: str = "provenance", file: str = "file") -> DataFrame:
    """Rows whose provenance is a slash and one of the files."""
    return df.join(files.select(F.concat(F.lit("/"), file).alias(provenance)).distinct(), provenance, "left_semi")


def of_categories(df: DataFrame, categories: list[str]) -> DataFrame:
    return df.filter(F.col("category").isin(*categories))


def check_inferable(inferring: set[str], removing: set[str]) -> None:
    """What is inferred must have been removed."""
    if more := inferring - removing:
        raise ValueError(f"inferred but not removed: {', '.join(sorted(more))}")
