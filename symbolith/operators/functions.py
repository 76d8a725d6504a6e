"""Frames of functions with their parameters and return expressions, and of nodes that a tool's type map can be joined with."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .extract import Module
from .select import usable_arguments, usable_returns

FUNCTIONS = "file string, cls_name string, func_name string, arg_names array<string>, arg_types array<string>, return_type string, return_expr array<string>, ord long"
NODES = "file string, category string, qname string, line long, col long, ord long"


def _own(node: ast.AST):
    """Nodes of a function's body that aren't in a function or class inside it, in source order."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            yield child
            yield from _own(child)


def _scopes(tree: ast.Module):
    """Functions with the names of the scopes around them and the innermost class directly around, in source order."""
    todo: list[tuple[ast.AST, tuple[str, ...], str | None]] = [(tree, (), None)]
    while todo:
        node, names, cls = todo.pop()
        inner = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner.append((child, (*names, child.name), None))
            elif isinstance(child, ast.ClassDef):
                inner.append((child, (*names, child.name), child.name))
            else:
                inner.append((child, names, cls))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node, names
        todo += reversed(inner)


def parameters(node) -> list[ast.arg]:
    """All parameters, those of stars too, in the order in which they stand."""
    a = node.args
    return [*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]


def function_rows(code: str) -> list[tuple]:
    """Per function: class, name, parameters' names and types (None for no annotation), return type, expressions returned."""
    out = []
    tree = ast.parse(code)
    classes = {id(f): c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body}
    for node, _ in _scopes(tree):
        args = [p for p in parameters(node) if p not in (node.args.vararg, node.args.kwarg)]
        returned = [ast.unparse(s.value) for s in _own(node) if isinstance(s, ast.Return) and s.value is not None]
        types = [ast.unparse(p.annotation) if p.annotation else None for p in args]
        out.append((classes.get(id(node)), node.name, [p.arg for p in args], types, ast.unparse(node.returns) if node.returns else None, returned, len(out)))
    return out


class Nodes(Module):
    """A file's symbols with their places, as extraction names them: functions, parameters (of stars too), names that are bound, and hints in front."""

    def __init__(self, code: str):
        self.places: list[tuple[str, str, int, int]] = []
        super().__init__(code)

    def place(self, category: str, name: str, node: ast.AST) -> None:
        self.places.append((category, self.qname(name), node.lineno, node.col_offset))

    def function(self, node) -> None:
        self.place("CALLABLE_RETURN", node.name, node)
        for p in parameters(node):
            self.place("CALLABLE_PARAMETER", f"{node.name}.{p.arg}", p)
        super().function(node)

    def variable(self, name: str, anno, labelled, inferred) -> None:
        super().variable(name, anno, labelled, inferred)
        self.place("VARIABLE", name, self.node)

    def hinted(self, name: str, node: ast.AST) -> None:
        self.place("VARIABLE", name, node)


def node_rows(code: str) -> list[tuple]:
    """Of each of a file's Nodes: category, qname, line, column (bytes) and order."""
    return [(*row, k) for k, row in enumerate(sorted(Nodes(code).places, key=lambda r: (r[2], r[3])))]


def _per_file(sources: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows of each file's code; files that aren't Python have none."""
    ship(sources.sparkSession)

    def over(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            for file, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = [(file, *row) for row in rows_of(code or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return sources.select("file", "code").mapInArrow(over, schema)


def function_frame(sources: DataFrame) -> DataFrame:
    """A row for each function of sources (file, code), with the sizes of its lists."""
    found = _per_file(sources, function_rows, FUNCTIONS)
    return found.withColumn("arg_names_len", F.size("arg_names")).withColumn("arg_types_len", F.size("arg_types"))


def argument_frame(functions: DataFrame) -> DataFrame:
    """A row for each usable parameter of function_frame."""
    one = functions.select("file", "cls_name", "func_name", "ord", F.posexplode(F.arrays_zip("arg_names", "arg_types")).alias("pos", "a"))
    return usable_arguments(one.select("file", "cls_name", "func_name", "ord", "pos", F.col("a.arg_names").alias("arg_name"), F.col("a.arg_types").alias("arg_type")))


def return_frame(functions: DataFrame) -> DataFrame:
    """The functions with a usable return type that return something."""
    return usable_returns(functions.select("file", "cls_name", "func_name", "ord", "return_type", "return_expr"))


def node_frame(sources: DataFrame) -> DataFrame:
    return _per_file(sources, node_rows, NODES)


def typed_nodes(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Nodes with the anno of a type map (file, line, col, anno), of which each place stands once."""
    return nodes.join(types.select("file", "line", "col", "anno"), ["file", "line", "col"], "left").select("file", "category", "qname", "anno", "ord")
