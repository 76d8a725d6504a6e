"""Numbers of repeated assignments of one name, by an explicit order column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGN = "λ"


def number(df: DataFrame, order: str = "ord", by: tuple[str, ...] = ("file",)) -> DataFrame:
    """df with qname_ssa: the n-th VARIABLE row of a name in a file (and rank, if there is topn) is qname λ n; other
    categories keep qname."""
    keys = [*by, "category", "qname", *(["topn"] if "topn" in df.columns else [])]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("qname_ssa", F.when(F.col("category") == "VARIABLE", F.concat("qname", F.lit(SIGN), n.cast("string"))).otherwise(F.col("qname")))


def nth_occurrence(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """df with n, the number of a row among those of its keys; two frames joined on keys and n pair nth with nth."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
