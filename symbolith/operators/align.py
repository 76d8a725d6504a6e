"""Alignment of predictions with symbols: baselines, occurrences, greedy cursors, functions with their parameters."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import argument_of, function_of
from ..schemas import SELECT_KEY
from ..shipping import ship
from .select import assert_unique, first_per


def to_baseline(predictions: DataFrame, baseline: DataFrame, keys: list[str] = SELECT_KEY) -> DataFrame:
    """All symbols of baseline, in its columns, with what is predicted for them."""
    return predictions.select(*keys, "anno").join(baseline.drop("anno"), keys, "right")


def merged_with_baseline(predictions: DataFrame, baseline: DataFrame, *order, strict: bool = False, keys: list[str] = SELECT_KEY) -> DataFrame:
    """All symbols of baseline with what is predicted for them, and, behind, what is predicted for symbols that it lacks; the first row of
    a key stays. The rows of both sides meet in one shuffle, and each side is read once. strict: keys that stand twice in predictions
    fail the job, by name."""
    columns = [c for c in baseline.columns if c not in (*keys, "anno")]
    said = predictions.select(*keys, "anno", F.lit(1).alias("__rank"))
    rows = baseline.select(*keys, *columns, F.lit(0).alias("__rank")).unionByName(said, allowMissingColumns=True)
    if strict:
        rows = assert_unique(rows, keys, F.col("__rank") == 1)
    of_key = Window.partitionBy(*keys)
    best = F.first(F.when(F.col("__rank") == 1, F.struct("anno")), ignorenulls=True).over(of_key.orderBy(F.desc("__rank"), *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return first_per(rows.withColumn("anno", best["anno"]), keys, "__rank", *order).select(*keys, *columns, "anno")


def nth_with_nth(targets: DataFrame, annotations: DataFrame, keys: list[str] = ["file", "qname"], order: str = "ord") -> DataFrame:
    """The n-th target of a name with its n-th annotation; targets without one keep null."""
    w = Window.partitionBy(*keys).orderBy(order)
    a = annotations.withColumn("n", F.row_number().over(w)).select(*keys, "n", "anno")
    # Spark guesses from the bytes of sources how many rows extraction gives, far too few: without the hint it sends them all through the driver
    return targets.withColumn("n", F.row_number().over(w)).join(a.hint("merge"), [*keys, "n"], "left")


def first_match(left: DataFrame, right: DataFrame, keys: list[str], *order) -> DataFrame:
    """left with the first row of right for its keys."""
    return left.join(first_per(right, keys, *order), keys, "left")


def functions_with_parameters(symbols: DataFrame) -> DataFrame:
    """Per function its parameters as name:anno in order, joined by commas (? for none)."""
    p = symbols.filter("category = 'CALLABLE_PARAMETER'").select("file", function_of(F.col("qname")).alias("function"), argument_of(F.col("qname")).alias("arg"), "anno", "ord")
    item = F.struct("ord", F.concat_ws(":", "arg", F.coalesce("anno", F.lit("?"))).alias("text"))
    lists = p.groupBy("file", "function").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return lists.select("file", "function", F.array_join("items.text", ",").alias("parameters"))


def greedy_cursor(slots: list[str], predicted: list[str]) -> list[int]:
    """For each slot the number of the next prediction of its name behind the cursor, which moves there; -1, and no move, if none."""
    places: dict[str, list[int]] = {}
    for k, name in enumerate(predicted):
        places.setdefault(name, []).append(k)
    out, cursor = [], 0
    for name in slots:
        own = places.get(name, ())
        at = bisect_left(own, cursor)
        if at == len(own):
            out.append(-1)
            continue
        out.append(own[at])
        cursor = own[at] + 1
    return out


def cursor_match(slots: DataFrame, predictions: DataFrame) -> DataFrame:
    """slots (file, ord, name) with the anno of predictions (file, ord, name, anno) that the cursor finds in their file. A file's
    rows are worked on together: files are what bounds a group."""

    def over(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("ord"), right.sort_values("ord")
        at = greedy_cursor(left["name"].tolist(), right["name"].tolist())
        annos = right["anno"].tolist()
        return left.assign(anno=[annos[k] if k >= 0 else None for k in at])[["file", "ord", "name", "anno"]]

    ship(slots.sparkSession)
    # columns of its own for the right side: both may come from one table, and pruning goes by a column's identity
    right = predictions.select(*(F.concat(F.col(c), F.lit("")).alias(c) if c != "ord" else (F.col(c) + 0).cast("long").alias(c) for c in ("file", "ord", "name", "anno")))
    return slots.select("file", "ord", "name").groupBy("file").cogroup(right.groupBy("file")).applyInPandas(over, "file string, ord long, name string, anno string")
