"""Scalar functions over names, annotations and lists, as column expressions."""

from __future__ import annotations

import builtins
import os
import typing

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_builtins_prefix(anno: Column) -> Column:
    """`builtins.` in front goes, once; inner ones stay."""
    return F.regexp_replace(anno, r"^builtins\.", "")


def without_locals(name: Column) -> Column:
    return F.replace(name, F.lit(".<locals>."), F.lit("."))


def module_and_target(name: Column) -> Column:
    """The leading dots and the path before the last dot, and what follows it."""
    pattern = r"^(\.*)(?:(.*)\.)?([^.]*)$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.struct(F.concat(part(1), part(2)).alias("module"), part(3).alias("target"))


def pick_qualified(candidates: Column, text: Column) -> Column:
    """The first candidate that isn't relative, else the first, else the text."""
    return F.coalesce(F.get(F.filter(candidates, lambda c: ~c.startswith(".")), F.lit(0)), F.get(candidates, F.lit(0)), text)


def function_of(qname: Column) -> Column:
    return F.regexp_extract(qname, r"^(.*)\.([^.]*)$", 1)


def argument_of(qname: Column) -> Column:
    return F.regexp_extract(qname, r"^(.*)\.([^.]*)$", 2)


def within_scope(scope: Column, name: Column) -> Column:
    """name without `scope.` in front."""
    prefix = F.concat(scope, F.lit("."))
    return F.when((scope != "") & name.startswith(prefix), F.substring(name, F.length(prefix) + 1, F.length(name))).otherwise(name)


def qualified(scope: Column, name: Column) -> Column:
    return F.concat_ws(".", scope, name)


def callable_return(anno: Column) -> Column:
    """What stands behind the last comma of a callable's annotation; null for a return type with brackets."""
    return F.nullif(F.regexp_extract(anno, r", ([^\]]+)\]$", 1), F.lit(""))


def scope_to_qname(scope: Column) -> Column:
    """`function,inner@Class` as `Class.function.inner`; the class `global` doesn't count, `global@global` is empty."""
    functions, owner = F.substring_index(F.replace(scope, F.lit(","), F.lit(".")), "@", 1), F.substring_index(F.replace(scope, F.lit(","), F.lit(".")), "@", -1)
    return F.when(scope == "global@global", "").when(owner == "global", functions).otherwise(F.concat_ws(".", owner, functions))


def arguments_text(args: Column) -> Column:
    return F.array_join(F.filter(args, lambda a: a != "self"), " ")


def returns_text(expressions: Column) -> Column:
    return F.array_join(F.transform(expressions, lambda e: F.regexp_replace(e, r"self\.?", "")), " ")


def probability(logprob: Column) -> Column:
    return F.exp(logprob)


def nth(values: Column, n: Column | int, default: str | None = None) -> Column:
    """The n-th value from 0, or the default behind the end."""
    found = F.get(values, F.lit(n) if isinstance(n, int) else n)
    return found if default is None else F.coalesce(found, F.lit(default))


def known_or_any(anno: Column) -> Column:
    return F.when(anno.isin("%UNK%", "%UNKNOWN%"), "typing.Any").otherwise(anno)


def other_to_null(anno: Column) -> Column:
    return F.nullif(anno, F.lit("other"))


_BUILTIN_NAMES = sorted({*dir(builtins), *dir(typing)})


def is_builtin(anno: Column) -> Column:
    """1 if the outer name of an annotation, without its path, is one of builtins or typing; 0 for null and unions."""
    head = F.regexp_extract(anno, r"^(?:[\w]+\.)*([\w]+)(?:\[.*\])?$", 1)
    return F.coalesce(head.isin(_BUILTIN_NAMES), F.lit(False)).cast("int")


def joined_methods(methods: Column) -> Column:
    return F.concat_ws("+", methods)


def stub_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.py$", ".pyi")


def workers() -> int:
    """CPUs that the scheduler grants, else a setting, else those of the machine."""
    return int(os.environ.get("SLURM_CPUS_PER_TASK") or os.environ.get("SYMBOLITH_WORKERS") or os.cpu_count() or 1)
