"""Symbols of Python files from the standard library's syntax trees: one pass per file gives annotated symbols and their
context features. Files are worked on in Arrow batches; rows leave Python flat, with `ord`, their order in the file."""

from __future__ import annotations

import ast
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_builtin
from ..schemas import CONTEXT_CODES
from ..shipping import ship
from .numbering import number
from .scopes import Scope, Scopes

SCHEMA = "file string, category string, qname string, anno string, simple_name string, labelled string, inferred string, loop int, reassigned int, nested int, branching int, ord long, error string, warning string"


class Module:
    """What one file declares. symbols: (category, qname, anno, simple name, labelled, inferred, loop, reassigned, nested, branching)."""

    def __init__(self, code: str, file: str = "x.py", lax: bool = False):
        self.lax = lax
        self.scope: list[tuple[str, str]] = []  # (kind, name)
        self.hints: list[dict[str, list]] = [{}]
        self.seen: list[list[set[str]]] = [[set()]]  # per scope the blocks' names
        self.external: list[set[str]] = [set()]
        self.moved: set[str] = set()
        self.loops = self.branches = 0
        self.node: ast.expr | None = None  # of the variable being added, and whether its hint comes from outside its block
        self.lowered = False
        self.functions: dict[tuple, list] = {}
        self.variables: dict[str, list] = {}
        self.tree = ast.parse(code)
        self.scopes = self.scoped(code, file)
        self.here = self.scopes.top
        self.skipped: list[tuple[int, str]] = []
        self.body(self.tree.body)
        self.symbols = [s for f in self.functions.values() for s in f] + [s for v in self.variables.values() for s in v]
        self.symbols = [(*s[:7], int(s[7] or s[1] in self.moved), *s[8:]) for s in self.symbols]

    def scoped(self, code: str, file: str) -> Scopes:
        return Scopes(self.tree, [p for p in file.replace("\\", "/").split("/")[:-1] if p not in ("", ".")])

    # annotations

    def anno(self, node: ast.expr | None, scope: Scope | None = None) -> str | None:
        """An annotation with its names qualified, as they stand in a scope (here, if none is given). Names of the file itself keep their path in
        it, unknown ones stay. Of what stands in brackets only names and what is in brackets itself is qualified, of a call
        its function alone stays, and nothing in Type[...] is touched."""
        if node is None:
            return None
        scope = scope or self.here
        if isinstance(node, ast.Name):
            return scope.lookup(node.id) or node.id
        if isinstance(node, ast.Attribute):
            return f"{self.anno(node.value, scope)}.{node.attr}"
        if isinstance(node, ast.Subscript):
            whole = self.anno(node.value, scope)
            inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            known = (ast.Name, ast.Attribute, ast.Subscript) if whole not in ("Type", "typing.Type") else ()
            return f"{whole}[{', '.join(self.anno(x, scope) if isinstance(x, known) else ast.unparse(x) for x in inner) or '()'}]"
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            return f"{self.anno(node.left, scope)} | {self.anno(node.right, scope)}"
        if isinstance(node, ast.Call):
            return self.anno(node.func, scope)
        return ast.unparse(node)

    def qname(self, name: str) -> str:
        return ".".join([*(n for _, n in self.scope), name])

    # rows

    def add(self, category: str, name: str, anno: str | None, labelled: str | None, inferred: str | None, is_function: bool = False) -> tuple:
        kinds = [k for k, _ in self.scope]
        nested = kinds.count("function") + is_function >= 2 or kinds.count("class") >= 2
        own = self.seen[-1]
        again = any(name in s for s in own)
        own[-1].add(name)
        return category, self.qname(name), anno, name, labelled, inferred, int(self.loops > 0), int(again), int(nested), int(self.branches > 0)

    def variable(self, name: str, anno: str | None, labelled: str | None, inferred: str | None) -> None:
        row = self.add("VARIABLE", name, anno, labelled, inferred)
        self.variables.setdefault(row[1], []).append(row)

    def hinted(self, name: str, node: ast.expr) -> None:
        """A hint in front of what it is for, which gives no row."""

    def function(self, node) -> None:
        a = node.args
        params = [*a.posonlyargs, *a.args, *a.kwonlyargs]
        around, signature_scope = self.here, self.scopes.signature[node]
        returns = self.anno(node.returns, signature_scope)
        rows = [self.add("CALLABLE_RETURN", node.name, returns if returns is not None or not self.lax else "None", returns, returns, True)]
        self.scope.append(("function", node.name))
        self.seen.append([set()])
        self.here = self.scopes.of[node]
        self.external.append(set(self.here.moved))
        loops, branches, self.loops, self.branches = self.loops, self.branches, 0, 0
        for p in params:
            anno = self.anno(p.annotation, signature_scope)
            rows.append(self.add("CALLABLE_PARAMETER", p.arg, anno, anno, anno))
        signature = tuple((p.arg, ast.dump(p.annotation) if p.annotation else None) for p in params)
        self.functions[(self.qname(""), signature)] = rows
        self.body(node.body)
        self.loops, self.branches, self.here = loops, branches, around
        self.external.pop()
        self.seen.pop()
        self.scope.pop()

    # targets and hints

    @staticmethod
    def target(node: ast.expr) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self":
            return f"self.{node.attr}"
        return None

    def targets(self, nodes: list[ast.expr]) -> list[tuple[str, ast.expr]]:
        """Names that targets bind and their nodes, outer ones first."""
        out, queue = [], deque(nodes)
        while queue:
            node = queue.popleft()
            if isinstance(node, (ast.Tuple, ast.List)):
                queue.extend(node.elts)
            elif isinstance(node, ast.Starred):
                queue.append(node.value)
            elif (name := self.target(node)) is not None:
                out.append((name, node))
        return out

    def free(self, name: str) -> bool:
        """Whether a name belongs to this scope; names of outer scopes that change here are remembered."""
        if name in self.external[-1]:
            self.moved.add(name)
            return False
        return True

    def hint(self, name: str) -> tuple[str | None, bool, bool]:
        """The hint in force for a name, whether it is still unused, and whether it comes from outside the block."""
        key = self.qname(name)
        if key in self.hints[-1]:
            anno, used, lowered = self.hints[-1][key]
            return anno, not used, lowered
        for outer in reversed(self.hints[:-1]):
            if key in outer:
                anno, used, _ = outer[key]
                outer[key][1] = True
                self.hints[-1][key] = [anno, True, True]
                return anno, not used, True
        return None, False, False

    def bind(self, name: str, label_unused: bool, node: ast.expr) -> None:
        if not self.free(name):
            return
        anno, unused, self.lowered = self.hint(name)
        self.node = node
        label = anno if label_unused and unused else None
        if label is not None:
            self.hints[-1][self.qname(name)][1] = True
        self.variable(name, label, label, anno)

    # statements

    def skip(self, s: ast.stmt) -> None:
        """A statement that binds something, but gives no row."""
        self.skipped.append((s.lineno, ast.unparse(s)))

    def body(self, statements: list[ast.stmt]) -> None:
        for s in statements:
            self.statement(s)

    def block(self, statements: list[ast.stmt], own_hints: bool = True) -> set[str]:
        """The names that a block binds; hints inside it end with it."""
        self.seen[-1].append(set())
        if own_hints:
            self.hints.append({})
        self.body(statements)
        if own_hints:
            self.hints.pop()
        return self.seen[-1].pop()

    def branch(self, statements: list[ast.stmt]) -> set[str]:
        self.branches += 1
        found = self.block(statements)
        self.branches -= 1
        return found

    def condition(self, s: ast.If) -> set[str]:
        """Names that are bound whichever way an if goes; those of one without else don't stay."""
        here = self.branch(s.body)
        if not s.orelse:
            return set()
        if len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If):
            return here & self.condition(s.orelse[0])
        return here & self.branch(s.orelse)

    def statement(self, s: ast.stmt) -> None:
        in_class = bool(self.scope) and self.scope[-1][0] == "class"
        own = self.seen[-1][-1]
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(s)
        elif isinstance(s, ast.ClassDef):
            around, self.here = self.here, self.scopes.of[s]
            self.scope.append(("class", s.name))
            self.seen.append([set()])
            self.external.append(set(self.here.moved))
            self.body(s.body)
            self.here = around
            self.external.pop()
            self.seen.pop()
            self.scope.pop()
        elif isinstance(s, ast.AnnAssign):
            name, anno = self.target(s.target), self.anno(s.annotation)
            if name is None:
                self.skip(s)
            if name is None or not self.free(name):
                return
            if s.value is None and not in_class:
                self.hinted(name, s.target)
                self.hints[-1][self.qname(name)] = [anno, False, False]
            else:
                self.hints[-1][self.qname(name)] = [anno, True, False]
                self.node, self.lowered = s.target, False
                self.variable(name, anno, anno, anno)
        elif isinstance(s, ast.Assign):
            ellipsis = isinstance(s.value, ast.Constant) and s.value.value is ...
            if len(s.targets) == 1 and not isinstance(s.targets[0], (ast.Tuple, ast.List)):
                name = self.target(s.targets[0])
                if name is not None and (in_class or not ellipsis):
                    self.bind(name, False, s.targets[0])
                else:
                    self.skip(s)
            else:
                found = self.targets(s.targets)
                for name, node in found:
                    self.bind(name, True, node)
                if not found:
                    self.skip(s)
        elif isinstance(s, ast.AugAssign):
            for name, node in self.targets([s.target]):
                self.bind(name, True, node)
        elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            self.loops += 1
            if not isinstance(s, ast.While):
                for name, node in self.targets([s.target]):
                    self.bind(name, True, node)
            own |= self.block(s.body)
            if s.orelse:
                own |= self.branch(s.orelse)
            self.loops -= 1
        elif isinstance(s, ast.If):
            own |= self.condition(s)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for name, node in self.targets([i.optional_vars for i in s.items if i.optional_vars]):
                self.bind(name, True, node)
            self.body(s.body)
        elif isinstance(s, (ast.Try, ast.TryStar)):
            found = self.block(s.body)
            for h in s.handlers:
                found |= self.block(h.body, isinstance(s, ast.TryStar))
            if s.orelse:
                found |= self.branch(s.orelse)
            own |= found | self.block(s.finalbody, False)
        elif isinstance(s, ast.Match):
            for case in s.cases:
                self.block(case.body)


def symbols(sources: DataFrame, lax: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """sources: file, code. The symbols of all files; a file without code, or that can't be parsed, gives one row with an error and no symbol,
    and a statement that no form of hint fits one with a warning and no symbol. keep: columns of sources that each row gets too."""

    def over(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows, at = [], []
            for place, (file, code) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                try:
                    if code is None:
                        raise ValueError("no code")
                    module = Module(code, file, lax)
                    rows += [(file, *s, k, None, None) for k, s in enumerate(module.symbols)]
                    rows += [(file, *[None] * 12, f"line {line}: no symbol in {text}") for line, text in module.skipped]
                except (SyntaxError, ValueError, RecursionError) as error:
                    rows.append((file, *[None] * 11, str(error), None))
                at += [place] * (len(rows) - len(at))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kept = [batch.column(2 + k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *kept], [*names, *(f"kept_{c}" for c in keep)])

    ship(sources.sparkSession)
    more = "".join(f", kept_{c} {sources.schema[c].dataType.simpleString()}" for c in keep)
    return sources.select("file", "code", *keep).mapInArrow(over, SCHEMA + more)


def annotated_symbols(sources: DataFrame, lax: bool = False) -> DataFrame:
    """file, category, qname, qname_ssa, anno, ord."""
    return number(symbols(sources, lax).filter("category is not null")).select("file", "category", "qname", "qname_ssa", "anno", "ord")


def context_vectors(sources: DataFrame, features: tuple[str, ...] = ("loop", "reassigned", "nested", "builtin", "branching")) -> DataFrame:
    """Annotated symbols with flags (0 for features that aren't asked for) and the category's code."""
    found = number(symbols(sources).filter("category is not null")).withColumn("builtin", is_builtin(F.col("labelled")))
    code = F.create_map(*(F.lit(x) for kv in CONTEXT_CODES.items() for x in kv))[F.col("category")]
    flags = [(F.col(f) if f in features else F.lit(0)).cast("int").alias(f) for f in ("loop", "reassigned", "nested", "builtin", "branching")]
    return found.select("file", "category", "qname", "qname_ssa", F.col("labelled").alias("anno"), "simple_name", *flags, code.alias("ctxt_category"), "ord")


#: What a logged extraction has besides project, file and messages.
SYMBOL_COLUMNS = ["category", "qname", "qname_ssa", "anno", "ord"]


def logged_symbols(sources: DataFrame, lax: bool = False) -> DataFrame:
    """sources: project, file, code, error (of the scan). Annotated symbols with their project, and a row for each message: of a file that can't be
    read or parsed, an error, of a statement that gives no symbol, a warning. One pass; to be written by runs.write_logged."""
    found = number(symbols(sources, lax, ("project", "error")), by=("kept_project", "file"))
    told = F.when(F.col("error").isNotNull(), F.coalesce("kept_error", "error"))
    return found.select(F.col("kept_project").alias("project"), "file", *SYMBOL_COLUMNS, told.alias("error"), "warning")
