"""Declared schemas of the symbol tables, their enums, and a check that a frame keeps to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Kinds of symbols as they stand in tables, and the codes of feature tables. Fixed values.
CATEGORIES = ("VARIABLE", "CALLABLE_RETURN", "CALLABLE_PARAMETER")
CONTEXT_CODES = {"CALLABLE_RETURN": 1, "CALLABLE_PARAMETER": 2, "VARIABLE": 3, "INSTANCE_ATTR": 4}
FLAGS = ("loop", "reassigned", "nested", "builtin", "branching")

SYMBOL_KEY = ["file", "category", "qname", "qname_ssa"]
SELECT_KEY = ["file", "category", "qname_ssa"]


def _strings(*names: str, null: bool = False) -> list[StructField]:
    return [StructField(n, StringType(), null) for n in names]


SYMBOLS = StructType(_strings(*SYMBOL_KEY))
ANNOTATED = StructType([*SYMBOLS.fields, *_strings("anno", null=True)])
PREDICTIONS = StructType([*ANNOTATED.fields, *_strings("method"), StructField("topn", IntegerType(), False)])
CONTEXT = StructType([*ANNOTATED.fields, *_strings("simple_name"), *(StructField(f, IntegerType(), False) for f in (*FLAGS, "ctxt_category"))])
TRAINING = StructType(
    [*_strings("method", "file", "qname_ssa"), *_strings("anno_gt", "anno_ta", null=True)]
    + [StructField(f, IntegerType(), False) for f in ("score", "loop", "reassigned", "nested", "builtin", "ctxt_category")]
)


def assert_schema(df: DataFrame, schema: StructType, values: bool = False) -> DataFrame:
    """df if it has the columns of schema with their types (more may follow); with values also if nulls, categories,
    flags and ranks keep to their domains, which takes one aggregate over df."""
    have = {f.name: f.dataType for f in df.schema.fields}
    odd = [f.name for f in schema.fields if have.get(f.name) != f.dataType]
    if odd:
        raise ValueError(f"columns missing or of another type: {', '.join(odd)}")
    if values:
        rules = {f"{f.name} is null": F.col(f.name).isNull() for f in schema.fields if not f.nullable}
        names = set(schema.names)
        if "category" in names:
            rules["category is unknown"] = ~F.col("category").isin(*CATEGORIES)
        if "topn" in names:
            rules["topn is below 1"] = F.col("topn") < 1
        rules |= {f"{f} is not a flag": ~F.col(f).isin(0, 1) for f in FLAGS if f in names}
        if "score" in names:
            rules["score is out of range"] = ~F.col("score").isin(-1, 0, 1)
        row = df.agg(*(F.count_if(c).alias(n) for n, c in rules.items())).first()
        if broken := [n for n in rules if row[n]]:
            raise ValueError("; ".join(broken))
    return df
