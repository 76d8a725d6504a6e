"""The class hierarchy of source files as data, with each class's linearisation.

Ancestors come from a closure by doubling: each round joins the pairs that are known with themselves, so a hierarchy of depth d takes
about log2(d) rounds, each written to the shared folder. A class and its ancestors with their bases then meet in one small group,
in which C3 merges the linearisations of the bases. Classes that inherit from themselves, or whose bases have no consistent order,
have an error and no ancestors.
"""

from __future__ import annotations

import ast
import builtins

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..shipping import ship
from .scopes import Scopes

OBJECT = "builtins.object"


def module_of(file: str) -> str:
    """a.b of a/b.py and of a/b/__init__.py."""
    parts = [p for p in file.replace("\\", "/").removesuffix(".pyi").removesuffix(".py").split("/") if p not in ("", ".")]
    return ".".join(parts[:-1] if parts[-1:] == ["__init__"] else parts)


def class_rows(code: str, file: str = "x.py") -> list[tuple[str, list[str], int]]:
    """Per class its name behind its module's, its bases' names as its place sees them, and its order. Of a base in brackets only what is in front counts."""
    tree, module = ast.parse(code), module_of(file)
    scopes = Scopes(tree, [p for p in file.replace("\\", "/").split("/")[:-1] if p not in ("", ".")])
    own = {".".join(s.path) for n, s in scopes.of.items() if isinstance(n, ast.ClassDef)}

    def named(node: ast.expr, scope) -> str:
        if isinstance(node, ast.Subscript):
            return named(node.value, scope)
        if isinstance(node, ast.Attribute):
            return f"{named(node.value, scope)}.{node.attr}"
        return (scope.lookup(node.id) or node.id) if isinstance(node, ast.Name) else ast.unparse(node)

    out = []
    for node, scope in scopes.of.items():
        if isinstance(node, ast.ClassDef):
            bases = [named(b, scopes.signature[node]) for b in node.bases if not isinstance(b, ast.Starred)]
            name = ".".join(scope.path)
            out.append((f"{module}.{name}", [f"{module}.{b}" if b in own else b for b in bases] or [OBJECT], node.lineno))
    return out


def classes(sources: DataFrame) -> DataFrame:
    """sources: file, code. file, cls, bases and ord of every class; files that aren't Python have none."""
    ship(sources.sparkSession)

    def over(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for file, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(file, *row) for row in class_rows(code or "", file)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()), strict=True)], ["file", "cls", "bases", "ord"])

    return sources.select("file", "code").mapInArrow(over, "file string, cls string, bases array<string>, ord long")


def builtin_classes(spark: SparkSession) -> DataFrame:
    """cls and bases of the builtins of this Python, some hundred rows."""
    rows = [(f"builtins.{n}", [f"{b.__module__}.{b.__qualname__}" for b in c.__bases__]) for n, c in sorted(vars(builtins).items()) if isinstance(c, type) and c.__name__ == n]
    return spark.createDataFrame(rows, "cls string, bases array<string>")


def c3(cls: str, bases: dict[str, list[str]]) -> list[str]:
    """The linearisation of a class; classes that aren't in bases have object for their only base. An inconsistent order is an error."""
    done: dict[str, list[str]] = {OBJECT: [OBJECT]}

    def of(c: str, below: tuple[str, ...]) -> list[str]:
        if c in below:
            raise ValueError(f"{c} inherits from itself")
        if c not in done:
            own = [b for b in bases.get(c) or [OBJECT]]
            if len(set(own)) < len(own):
                raise ValueError(f"{c} has a base twice")
            done[c] = [c, *merged(c, [[*of(b, (*below, c))] for b in own] + [own])]
        return done[c]

    def merged(c: str, lists: list[list[str]]) -> list[str]:
        out = []
        while lists := [x for x in lists if x]:
            head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
            if head is None:
                raise ValueError(f"no consistent order of the bases of {c}")
            out.append(head)
            lists = [x[1:] if x[0] == head else x for x in lists]
        return out

    return of(cls, ())


def ancestors(edges: DataFrame) -> DataFrame:
    """edges: derived, base. All pairs of a class and what it inherits from, by however many steps; on a cycle also itself."""
    pairs = stored(edges.select("derived", "base").distinct(), "pairs")
    n = pairs.count()
    while True:
        left, right = pairs.select("derived", F.col("base").alias("by")), pairs.select(F.col("derived").alias("by"), "base")
        more = stored(pairs.unionByName(left.join(right, "by").select("derived", "base")).distinct(), "pairs")
        found = more.count()
        if found == n:
            return more
        pairs, n = more, found


def linearised(known: DataFrame) -> DataFrame:
    """known: cls, bases (of a name that stands twice, the largest ord stays if there is one). Per class and ancestor: derived, base, place
    (0 for itself) and error; a class with an error has one row, without base."""
    ship(known.sparkSession)
    if "ord" in known.columns:
        known = known.groupBy("cls").agg(F.max_by("bases", F.struct("ord", "bases")).alias("bases"))
    known = stored(known.select("cls", F.when(F.size("bases") > 0, F.col("bases")).otherwise(F.when(F.col("cls") != OBJECT, F.array(F.lit(OBJECT))).otherwise(F.array().cast("array<string>"))).alias("bases")), "classes")
    edges = known.select(F.col("cls").alias("derived"), F.explode("bases").alias("base"))
    own = known.select(F.col("cls").alias("derived"), "cls", "bases")
    of_ancestors = ancestors(edges.filter(F.col("base") != OBJECT)).join(known.withColumnRenamed("cls", "base"), "base").select("derived", F.col("base").alias("cls"), "bases")
    grouped = own.unionByName(of_ancestors).groupBy("derived").agg(F.collect_list(F.struct("cls", "bases")).alias("of"))  # a class and its ancestors

    def over(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for derived, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(derived, base, k, None) for k, base in enumerate(c3(derived, {x["cls"]: x["bases"] for x in of}))]
                except (ValueError, RecursionError) as error:
                    rows.append((derived, None, None, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["derived", "base", "place", "error"])

    return grouped.mapInArrow(over, "derived string, base string, place int, error string")


def up_lists(hierarchy: DataFrame) -> DataFrame:
    """hierarchy: derived, base, place. Per type its list of ancestors, itself first: type, up."""
    rows = hierarchy.filter(F.col("base").isNotNull())
    return rows.groupBy(F.col("derived").alias("type")).agg(F.sort_array(F.collect_list(F.struct("place", "base"))).alias("l")).select("type", F.col("l.base").alias("up"))


def subtypes(hierarchy: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: derived, base. With `subtype`, whether base is in derived's linearisation; of a type that isn't known the answer is null."""
    known = hierarchy.select("derived").distinct().withColumn("known", F.lit(True))
    held = hierarchy.select("derived", "base").withColumn("held", F.lit(True))
    return pairs.join(held, ["derived", "base"], "left").join(known, "derived", "left").select("derived", "base", F.when(F.col("known"), F.coalesce("held", F.lit(False))).alias("subtype"))
