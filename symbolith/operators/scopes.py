"""The scopes of a Python file and what their names stand for.

One walk over the tree binds names: imports stand for what they import, classes, functions and variables for their own path. A name is
looked up from the scope where it stands outwards; a class's names are seen from its own body only, not from functions inside.
global and nonlocal names bind, and are looked up, where they say. As in Python's compiler, a name is its scope's own wherever in it
the binding stands; of several bindings in one scope the last counts.
"""

from __future__ import annotations

import ast
import builtins
from collections import defaultdict
from collections.abc import Iterator

BUILTINS = frozenset(dir(builtins))
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


class Scope:
    """kind: module, class, function, or types (type parameters around a class or function). path: names of the classes and functions
    around. names: what each of its own names stands for. moved: its global and nonlocal names with the scope they belong to."""

    def __init__(self, kind: str, path: tuple[str, ...], parent: Scope | None):
        self.kind, self.path, self.parent = kind, path, parent
        self.names: dict[str, str] = {}
        self.moved: dict[str, Scope] = {}

    def bind(self, name: str, target: str | None = None) -> None:
        home = self.moved.get(name, self)
        home.names[name] = target if target is not None else ".".join([*home.path, name])

    def outer(self) -> Iterator[Scope]:
        """This scope and those whose names it sees, from the inside out."""
        at: Scope | None = self
        while at is not None:
            if at is self or at.kind != "class":
                yield at
            at = at.parent

    def lookup(self, name: str) -> str | None:
        """What a name stands for here; None if no scope binds it and it isn't a builtin."""
        home = self.moved.get(name)
        for scope in (home,) if home else self.outer():
            if name in scope.names:
                return scope.names[name]
        return f"builtins.{name}" if name in BUILTINS else None


class Unscoped:
    """Stands for the Scopes of a file without global and nonlocal names where nothing is looked up."""

    def __init__(self):
        self.top = Scope("module", (), None)
        self.of = self.signature = defaultdict(lambda: self.top)


class Scopes:
    """of: the scope inside each class and function, and the module's, by node; signature: where decorators aside a function's
    annotations and a class's bases are looked up."""

    def __init__(self, tree: ast.Module, package: list[str] = ()):
        self.package = list(package)
        self.top = Scope("module", (), None)
        self.of: dict[ast.AST, Scope] = {tree: self.top}
        self.signature: dict[ast.AST, Scope] = {}
        todo: list[tuple[ast.AST, Scope]] = [(tree, self.top)]
        while todo:  # a scope is bound as a whole before those inside it, so that nonlocal names are there
            node, scope = todo.pop()
            todo += reversed(self._scope(node, scope))

    def _scope(self, node: ast.AST, scope: Scope) -> list[tuple[ast.AST, Scope]]:
        """Bind a scope's own names. Returns the scopes directly inside it."""
        own, inner = list(self._own(node)), []
        for s in own:
            if isinstance(s, ast.Global):
                scope.moved |= dict.fromkeys(s.names, self.top)
            elif isinstance(s, ast.Nonlocal):
                for name in s.names:
                    home = next((x for x in scope.outer() if x is not scope and x.kind == "function" and name in x.names), None)
                    scope.moved[name] = home or scope.parent or self.top
        if isinstance(node, FUNCTIONS):
            a = node.args
            for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]:
                scope.bind(p.arg)
        for s in own:
            if isinstance(s, ast.Import):
                for a in s.names:
                    first = a.name.split(".")[0]
                    scope.bind(a.asname or first, a.name if a.asname else first)
            elif isinstance(s, ast.ImportFrom):
                up = self.package[: len(self.package) - s.level + 1] if s.level else []
                prefix = ".".join([*up, *([s.module] if s.module else [])])
                for a in s.names:
                    if a.name != "*":
                        scope.bind(a.asname or a.name, f"{prefix}.{a.name}" if prefix else a.name)
            elif isinstance(s, (*FUNCTIONS, ast.ClassDef)):
                scope.bind(s.name)
                around = scope
                if getattr(s, "type_params", None):
                    around = Scope("types", scope.path, scope)
                    for p in s.type_params:
                        around.bind(p.name, p.name)
                self.signature[s] = around
                self.of[s] = Scope("class" if isinstance(s, ast.ClassDef) else "function", (*scope.path, s.name), around)
                inner.append((s, self.of[s]))
            elif isinstance(s, ast.Name) and isinstance(s.ctx, (ast.Store, ast.Del)):
                scope.bind(s.id)
            elif isinstance(s, ast.TypeAlias):
                scope.bind(s.name.id)
            elif isinstance(s, ast.ExceptHandler) and s.name or isinstance(s, (ast.MatchAs, ast.MatchStar)) and s.name:
                scope.bind(s.name)
            elif isinstance(s, ast.MatchMapping) and s.rest:
                scope.bind(s.rest)
        return inner

    @staticmethod
    def _own(node: ast.AST) -> Iterator[ast.AST]:
        """Nodes that belong to a scope, in source order: not what stands in scopes inside, of which only the nodes themselves come; of
        comprehensions, which bind names of their own, only what := binds."""
        todo: list[tuple[ast.AST, bool]] = [(s, False) for s in reversed(node.body)]
        while todo:
            at, hidden = todo.pop()
            if not (hidden and isinstance(at, ast.Name)):
                yield at
            if isinstance(at, (*FUNCTIONS, ast.ClassDef)):
                outside = [*at.decorator_list, *(at.bases if isinstance(at, ast.ClassDef) else [*at.args.defaults, *filter(None, at.args.kw_defaults)])]
                todo += [(x, hidden) for x in reversed(outside)]
            elif isinstance(at, ast.Lambda):
                todo += [(x, hidden) for x in reversed([*at.args.defaults, *filter(None, at.args.kw_defaults)])]
            elif isinstance(at, ast.NamedExpr):
                todo += [(at.value, hidden), (at.target, False)]
            elif isinstance(at, ast.AnnAssign) and at.value is None and not at.simple:  # binds nothing
                todo.append((at.annotation, hidden))
            elif isinstance(at, COMPREHENSIONS):
                todo += [(x, True) for x in reversed(list(ast.iter_child_nodes(at)))]
            else:
                todo += [(x, hidden) for x in reversed(list(ast.iter_child_nodes(at)))]
