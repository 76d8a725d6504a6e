"""Rewriting of Python source text: annotations removed, applied or compared, by edits of the spans that the syntax tree names."""

from __future__ import annotations

import ast
import difflib
import re
import tokenize

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.scans import with_stubs
from .edits import Text
from .extract import Module
from .scopes import Scopes, Unscoped
from .select import first_per

FUTURE = "from __future__ import annotations"
#: A dotted name that isn't part of a longer one, nor of a string.
_DOTTED = re.compile(r"""'[^']*'|"[^"]*"|(?<![\w.])((?:[^\W\d]\w*\.)+)[^\W\d]\w*""")
#: What a bracket that is none can stand in, a bracket, and what follows a target without brackets around it.
_HIDING, _BRACKET, _ASSIGNED = re.compile(rb"['\"#]"), re.compile(rb"[()]"), re.compile(rb"[ \t]*=")


def strip(code: str, variables: bool = True, parameters: bool = True, returns: bool = True) -> str:
    """code without annotations of the chosen kinds, with the brackets, comments and line joins inside them. A bare hint in a class
    becomes `name = ...`, elsewhere it goes; a body that would be empty gets `pass`. What doesn't compile is an error, never returned."""
    text, tree = Text(code), ast.parse(code)
    for parent in ast.walk(tree):
        if isinstance(parent, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if returns and parent.returns:
                first, last = text.tokens.around(text.start(parent.returns), text.end(parent.returns))
                text.edit(text.tokens.end[first - 2], text.tokens.end[last], "")  # from behind the token before ->
            a = parent.args
            for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))] if parameters else []:
                if p.annotation:
                    text.edit(text.start(p) + len(text.tokens.text[text.tokens.from_(text.start(p))].encode()), text.tokens.end[text.tokens.around(text.start(p.annotation), text.end(p.annotation))[1]], "")
        for field in ("body", "orelse", "finalbody") if variables else ():
            body = getattr(parent, field, None)
            if isinstance(body, list):
                _strip_hints(text, parent, body)
    if not text.edits:
        return code
    out = text.done()
    compile(out, "x.py", "exec", dont_inherit=True)
    return out


def _strip_hints(text: Text, parent: ast.AST, body: list[ast.stmt]) -> None:
    hints = [s for s in body if isinstance(s, ast.AnnAssign)]
    gone = [s for s in hints if s.value is None and not (isinstance(parent, ast.ClassDef) and Module.target(s.target))]
    for s in hints:
        if s not in gone:  # from behind the target, brackets around it included
            first, last = text.tokens.around(text.start(s.annotation), text.end(s.annotation))
            text.edit(text.tokens.end[first - 2], text.tokens.end[last], "" if s.value is not None else " = ...")
            continue
        a, b = text.start(s), text.end(s)
        line, rest = text.lines[s.lineno - 1], text.raw[b : text.lines[s.end_lineno]]
        if len(gone) == len(body) and s is gone[-1] and not isinstance(parent, ast.Module):
            text.edit(a, b, "pass")
        elif not text.raw[line:a].strip() and not rest.strip():
            text.edit(line, text.lines[s.end_lineno], "")
        elif rest.lstrip().startswith(b";") and rest.lstrip().removeprefix(b";").strip():
            text.edit(a, b + len(rest) - len(rest.lstrip().removeprefix(b";").lstrip(b" ")), "")
        else:
            text.edit(a, b, "pass")


def _closing(text: Text, node) -> int:
    """Where the parameters of a def end: behind their bracket. Where no string, comment or type parameter can hold one, brackets are
    counted, which spares the tokens."""
    start = text.start(node)
    head = text.raw[start : text.start(node.body[0])]
    if not _HIDING.search(head) and b"[" not in head[: head.find(b"(")]:
        depth = 0
        for m in _BRACKET.finditer(head):
            depth += 1 if m[0] == b"(" else -1
            if not depth:
                return start + m.end()
    tokens = text.tokens
    k = tokens.from_(text.start(node))
    while tokens.text[k] != "def":
        k += 1
    k += 2
    if tokens.text[k] == "[":  # type parameters
        k = tokens.partner[k] + 1
    return tokens.end[tokens.partner[k]]


def parameters(node) -> tuple[str, ...]:
    """A function's signature: its parameters' names, those of stars with their stars."""
    a = node.args
    return (*(p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs)), *(f"*{p.arg}" for p in [a.vararg] if p), *(f"**{p.arg}" for p in [a.kwarg] if p))


class Applier(Module):
    """Writes annotations where there are none, or, to overwrite, in place of those there are. annos: (category, qname_ssa) ->
    annotation, or (category, qname_ssa, signature of the function) -> annotation, which is for that signature only."""

    def __init__(self, code: str, file: str, annos: dict[tuple, str], overwrite: bool = False):
        self.text, self.annos, self.overwrite = Text(code), annos, overwrite
        self.count: dict[str, int] = {}
        self.current: ast.stmt | None = None
        self.written: list[str] = []
        super().__init__(code, file)

    def scoped(self, code: str, file: str) -> Scopes | Unscoped:
        return super().scoped(code, file) if "global" in code or "nonlocal" in code else Unscoped()

    def anno(self, node: ast.expr | None, scope=None) -> str | None:
        """That there is an annotation: what it stands for isn't asked."""
        return None if node is None else ""

    def found(self, category: str, qname: str, *signature) -> str | None:
        anno = self.annos.get((category, qname, *signature)) or self.annos.get((category, qname))
        return anno.removeprefix("builtins.") if anno else None

    def write(self, a: int, b: int, anno: str, form: str) -> None:
        self.written.append(anno)
        self.text.edit(a, b, form.format(anno))

    def annotated(self, old: ast.expr | None, at: int, anno: str | None, form: str) -> None:
        """Write anno at `at`, or over an old one."""
        if anno and old is None:
            self.write(at, at, anno, form)
        elif anno and self.overwrite:
            self.write(self.text.start(old), self.text.end(old), anno, "{}")

    def function(self, node) -> None:
        a, name, own = node.args, self.qname(node.name), parameters(node)
        if anno := self.found("CALLABLE_RETURN", name, own):
            self.annotated(node.returns, _closing(self.text, node) if node.returns is None else 0, anno, " -> {}")
        for p in [*a.posonlyargs, *a.args, *a.kwonlyargs]:
            self.annotated(p.annotation, self.text.end(p), self.found("CALLABLE_PARAMETER", f"{name}.{p.arg}", own), ": {}")
        super().function(node)

    def statement(self, s: ast.stmt) -> None:
        before, self.current = self.current, s
        super().statement(s)
        self.current = before

    def variable(self, name: str, anno, labelled, inferred) -> None:
        super().variable(name, anno, labelled, inferred)
        key = self.qname(name)
        self.count[key] = self.count.get(key, 0) + 1
        new, s = self.found("VARIABLE", f"{key}λ{self.count[key]}"), self.current
        if not new:
            return
        if isinstance(s, ast.AnnAssign):
            self.annotated(s.annotation, 0, new, "{}")
        elif inferred is not None:
            return
        elif isinstance(s, ast.Assign) and len(s.targets) == 1 and not isinstance(s.targets[0], (ast.Tuple, ast.List)):
            target = s.targets[0]
            behind = self.text.end(target)
            if not _ASSIGNED.match(self.text.raw, behind):
                behind = self.text.tokens.end[self.text.tokens.around(self.text.start(target), behind)[1]]
            self.write(behind, behind, new, ": {}")
        else:
            start = self.text.start(s)
            before = self.text.raw[self.text.lines[s.lineno - 1] : start].decode()
            simple = isinstance(s, (ast.Assign, ast.AugAssign)) or before.strip()  # no line can be put before the latter
            if before.strip() and not isinstance(s, (ast.Assign, ast.AugAssign)):
                return
            self.write(start, start, new, name + ": {}; " if simple else name + ": {}\n" + before)


def _modules(annos: list[str], tree: ast.Module) -> list[str]:
    """Modules that dotted names of annos want and tree doesn't bind at its top."""
    bound: set[str] = set()
    opened: set[str] = set()  # packages of which other modules can be imported beside
    for s in tree.body:
        if isinstance(s, ast.Import):
            bound |= {part for a in s.names for part in ([a.asname] if a.asname else _prefixes(a.name))}
            opened |= {_prefixes(a.name)[0] for a in s.names if not a.asname}
        elif isinstance(s, ast.ImportFrom):
            bound |= {a.asname or a.name for a in s.names}
        elif isinstance(s, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            bound.add(s.name)
        elif isinstance(s, (ast.Assign, ast.AnnAssign)):
            bound |= {t.id for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)}
    wanted = {m[1][:-1] for a in annos for m in _DOTTED.finditer(a) if m[1]}
    return sorted(w for w in wanted if w not in bound and not (_prefixes(w)[0] in bound and _prefixes(w)[0] not in opened))


def _prefixes(dotted: str) -> list[str]:
    """a, a.b, a.b.c of a.b.c."""
    parts = dotted.split(".")
    return [".".join(parts[:k]) for k in range(1, len(parts) + 1)]


def apply(code: str, annos: dict[tuple, str], file: str = "x.py", overwrite: bool = False, imports: bool = True, extra: tuple[str, ...] = ()) -> str:
    """code with annotations for symbols that have none, or for all. Where anything is written postponed evaluation is switched on,
    and modules of dotted names are imported, with `extra` lines behind. What doesn't compile is an error, never returned."""
    return _applied(Applier(code, file, annos, overwrite), file, imports, extra)


def _applied(work: Applier, file: str, imports: bool, extra: tuple[str, ...]) -> str:
    """What apply returns, of edits that are made."""
    tree, text = work.tree, work.text
    if not text.edits:
        return text.code
    lines = [] if any(isinstance(s, ast.ImportFrom) and s.module == "__future__" and any(a.name == "annotations" for a in s.names) for s in tree.body) else [FUTURE]
    later = [*(f"import {m}" for m in _modules(work.written, tree) if imports), *extra]
    place = [s for s in tree.body[:1] if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)]
    there = [s for s in tree.body if isinstance(s, ast.ImportFrom) and s.module == "__future__"][-1:]
    heads = [_insertion(text, tree, behind, new) for behind, new in ((place, lines), (there or place, later)) if new]
    text.edits = heads + text.edits  # of edits at one place the first comes first
    out = text.done()
    compile(out, file, "exec", dont_inherit=True)
    return out


def _insertion(text: Text, tree: ast.Module, behind: list[ast.stmt], new: list[str]) -> tuple[int, int, bytes]:
    """The edit that puts statements in front of all, or behind one of the top."""
    first = next((s for s in tree.body if not behind or text.start(s) > text.start(behind[0])), None)
    if first is not None and behind and first.lineno == behind[0].end_lineno:  # on one line
        return (text.start(first),) * 2 + ("".join(f"{x}; " for x in new).encode(),)
    if behind:
        at = text.lines[behind[0].end_lineno]
    else:
        at = text.lines[min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))]) - 1] if first else 0
    gap = "\n" if behind and not text.raw[:at].endswith((b"\n", b"\r")) else ""
    return at, at, (gap + "".join(f"{x}\n" for x in new)).encode()


def stub_annotations(stub: str) -> tuple[dict[tuple, str], list[tuple[str, str]]]:
    """What a stub declares, as annos of Applier that hold for functions of the same signature, and its imports as (name, line)."""
    annos: dict[tuple, str] = {}
    imports: list[tuple[str, str]] = []

    def walk(body: list[ast.stmt], scope: str) -> None:
        for s in body:
            if isinstance(s, ast.ClassDef):
                walk(s.body, f"{scope}{s.name}.")
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name, own = scope + s.name, parameters(s)
                if s.returns:
                    annos.setdefault(("CALLABLE_RETURN", name, own), ast.unparse(s.returns))
                for p in (*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs):
                    if p.annotation:
                        annos.setdefault(("CALLABLE_PARAMETER", f"{name}.{p.arg}", own), ast.unparse(p.annotation))
            elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                annos.setdefault(("VARIABLE", f"{scope}{s.target.id}λ1"), ast.unparse(s.annotation))
            elif isinstance(s, ast.Import):
                imports.extend((a.asname or a.name.split(".")[0], f"import {a.name}" + (f" as {a.asname}" if a.asname else "")) for a in s.names)
            elif isinstance(s, ast.ImportFrom) and s.module != "__future__":
                source = "." * s.level + (s.module or "")
                imports.extend((a.asname or a.name, f"from {source} import {a.name}" + (f" as {a.asname}" if a.asname else "")) for a in s.names if a.name != "*")

    walk(ast.parse(stub).body, "")
    return annos, imports


def apply_stub(code: str, stub: str, file: str = "x.py", overwrite: bool = True) -> str:
    """code with what its stub declares of functions of the same name and signature, and of variables; names that this needs are imported as in the stub."""
    annos, imports = stub_annotations(stub)
    work = Applier(code, file, annos, overwrite)
    used = {name for a in set(work.written) for name in ([a] if a.isidentifier() else [n.id for n in ast.walk(ast.parse(a, mode="eval")) if isinstance(n, ast.Name)])}
    bound = {a.asname or a.name.split(".")[0] for s in work.tree.body if isinstance(s, (ast.Import, ast.ImportFrom)) for a in s.names}
    extra = tuple(dict.fromkeys(line for name, line in imports if name in used - bound))
    return _applied(work, file, False, extra)


def diff(left: str, right: str, name: str = "x.py") -> str:
    """A unified diff with one line of context."""
    return "".join(difflib.unified_diff(left.splitlines(keepends=True), right.splitlines(keepends=True), name, name, n=1))


def _rewritten(rows: DataFrame, work, *columns: str) -> DataFrame:
    """file, code and error after work(file, *columns), which may raise what a file that isn't Python raises."""

    def over(batches):
        import pyarrow as pa

        for batch in batches:
            code, error = [], []
            for file, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    code.append(work(file, *rest))
                    error.append(None)
                except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
                    code.append(rest[0])
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), pa.array(error, pa.string())], ["file", "code", "error"])

    ship(rows.sparkSession)
    return rows.select("file", *columns).mapInArrow(over, "file string, code string, error string")


def strip_sources(sources: DataFrame, **kinds: bool) -> DataFrame:
    return _rewritten(sources, lambda file, code: strip(code or "", **kinds), "code")


def _by_file(sources: DataFrame) -> DataFrame:
    """file and code, dealt by file into all shuffle partitions: files are few bytes for the time they take, so partitions must not
    be merged for their size. The join with what is known of a file uses the same partitions."""
    return sources.select("file", "code").repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def apply_stubs(sources: DataFrame, stubs: DataFrame) -> DataFrame:
    """sources merged with the stub (file, code) beside each; a file without one stays as it is."""
    known = with_stubs(_by_file(sources), stubs)
    return _rewritten(known, lambda file, code, stub: apply_stub(code or "", stub, file) if stub else code or "", "code", "stub")


def apply_predictions(sources: DataFrame, best: DataFrame, overwrite: bool = False, imports: bool = True) -> DataFrame:
    """sources with the annotations of best: file, category, qname_ssa, anno, of each symbol the first."""
    one = first_per(best.filter("anno is not null"), ["file", "category", "qname_ssa"], "anno")
    lists = one.groupBy("file").agg(F.collect_list(F.struct("category", "qname_ssa", "anno")).alias("annos"))
    known = _by_file(sources).join(lists.hint("merge"), "file", "left")  # files are more and larger than Spark guesses: see align.nth_with_nth
    return _rewritten(known, lambda file, code, annos: apply(code or "", {(a["category"], a["qname_ssa"]): a["anno"] for a in annos or []}, file, overwrite, imports), "code", "annos")


def source_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per file of both sides: file, code (the diff), error."""
    both = left.select("file", "code").join(right.select("file", F.col("code").alias("other")).hint("merge"), "file")
    return _rewritten(both, lambda file, a, b: diff(a or "", b or "", file), "code", "other")
