"""Symbols, imports, exports and calls of Python files, from the standard parser inside mapInPandas.

A file that doesn't parse is tried again without the top-level block at fault, so what else
it holds is still found and its status is `partial`.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "array<struct<name:string,qualified_name:string,kind:string,parent:string,start_line:int,end_line:int,signature:string,docstring:string,return_type:string,is_exported:boolean,is_async:boolean,decorators:array<string>,bases:array<string>,parameters:array<struct<name:string,type:string,default:string,kind:string>>>>"
IMPORTS = "array<struct<module:string,level:int,kind:string,names:array<struct<name:string,alias:string>>,line:int,is_type_only:boolean>>"
CALLS = "array<struct<callee:string,line:int,caller:string>>"
PARSED = f"repository_id string, path string, status string, symbols {SYMBOLS}, imports {IMPORTS}, calls {CALLS}, exports array<string>"


def _flat(text: str, limit: int = 300) -> str:
    text = " ".join(text.split())
    return text if len(text) <= limit else text[: limit - 1].rstrip() + "…"


def parse(source: str) -> tuple[ast.Module | None, str]:
    """(tree, parsed | partial | failed)."""
    rows = source.split("\n")
    status = "parsed"
    while True:  # each round blanks a row at least
        try:
            return ast.parse("\n".join(rows)), status
        except (SyntaxError, ValueError) as error:
            at = getattr(error, "lineno", None)
            if not at or not any(r.strip() for r in rows):
                return None, "failed"
            status = "partial"
            begin = end = min(at, len(rows)) - 1
            while begin > 0 and (not rows[begin].strip() or rows[begin][0] in " \t)]}"):
                begin -= 1
            end = max(end, begin)
            while end + 1 < len(rows) and (not rows[end + 1].strip() or rows[end + 1][0] in " \t)]}"):
                end += 1
            if not any(r.strip() for r in rows[begin : end + 1]):
                begin, end = 0, end
            if not any(rows[begin : end + 1]):
                return None, "failed"
            rows[begin : end + 1] = [""] * (end + 1 - begin)


def _parameters(a: ast.arguments) -> list[dict]:
    out = []
    plain = [*a.posonlyargs, *a.args]
    gaps = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)

    def add(arg: ast.arg, kind: str, default: ast.expr | None = None) -> None:
        out.append({"name": arg.arg, "type": ast.unparse(arg.annotation) if arg.annotation else None, "default": ast.unparse(default) if default else None, "kind": kind})

    for k, (arg, default) in enumerate(zip(plain, gaps)):
        add(arg, "positional_only" if k < len(a.posonlyargs) else "positional", default)
    if a.vararg:
        add(a.vararg, "var_positional")
    for arg, default in zip(a.kwonlyargs, a.kw_defaults):
        add(arg, "keyword_only", default)
    if a.kwarg:
        add(a.kwarg, "var_keyword")
    return out


def _remark_above(rows: list[str], line: int) -> str | None:
    found = []
    for row in reversed(rows[: line - 1]):
        if not row.strip().startswith("#"):
            break
        found.append(row.strip().lstrip("#").strip())
    return "\n".join(reversed(found))[:1000] or None


class _Walk(ast.NodeVisitor):
    def __init__(self, rows: list[str]):
        self.rows, self.owner, self.classes, self.typing = rows, [], [], 0
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.calls: list[dict] = []

    def _symbol(self, node, kind: str) -> None:
        qualified = ".".join([*self.owner, node.name])
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        callable_ = kind != "class"
        head = ("async " if isinstance(node, ast.AsyncFunctionDef) else "") + (f"def {node.name}({ast.unparse(node.args)})" if callable_ else f"class {node.name}")
        back = ast.unparse(node.returns) if callable_ and node.returns else None
        bases = [] if callable_ else [ast.unparse(b) for b in node.bases]
        if bases:
            head += f"({', '.join(bases)})"
        if back:
            head += f" -> {back}"
        doc = ast.get_docstring(node) or _remark_above(self.rows, first)
        self.symbols.append(
            {
                "name": node.name, "qualified_name": qualified, "kind": kind, "parent": ".".join(self.owner) or None, "start_line": first, "end_line": node.end_lineno,
                "signature": _flat(head), "docstring": doc[:2000] if doc else None, "return_type": back, "is_exported": False, "is_async": isinstance(node, ast.AsyncFunctionDef),
                "decorators": [ast.unparse(d) for d in node.decorator_list], "bases": bases, "parameters": _parameters(node.args) if callable_ else [],
            }
        )
        for d in node.decorator_list:
            self.visit(d)
        self.owner.append(node.name)
        self.classes.append(not callable_)
        for child in node.body:
            self.visit(child)
        self.owner.pop()
        self.classes.pop()

    def visit_ClassDef(self, node):
        self._symbol(node, "class")

    def visit_FunctionDef(self, node):
        self._symbol(node, "method" if self.classes and self.classes[-1] else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_If(self, node):
        typing = ast.unparse(node.test).endswith("TYPE_CHECKING")
        self.typing += typing
        for child in node.body:
            self.visit(child)
        self.typing -= typing
        for child in node.orelse:
            self.visit(child)
        self.visit(node.test)

    def visit_Import(self, node):
        for a in node.names:
            self.imports.append({"module": a.name, "level": 0, "kind": "import", "names": [{"name": a.name, "alias": a.asname}], "line": node.lineno, "is_type_only": self.typing > 0})

    def visit_ImportFrom(self, node):
        self.imports.append({"module": node.module or "", "level": node.level, "kind": "from", "names": [{"name": a.name, "alias": a.asname} for a in node.names], "line": node.lineno, "is_type_only": self.typing > 0})

    def visit_Call(self, node):
        callee = re.sub(r"\s+", "", ast.unparse(node.func))
        if isinstance(node.func, (ast.Name, ast.Attribute)) and len(callee) <= 200 and "(" not in callee and "[" not in callee:
            self.calls.append({"callee": callee, "line": node.lineno, "caller": ".".join(self.owner) or None})
        self.generic_visit(node)


def _all_names(tree: ast.Module) -> list[str] | None:
    named: list[str] | None = None
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AugAssign, ast.AnnAssign)) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            values = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
            named = (named or []) + values if isinstance(node, ast.AugAssign) else values
    return named


def analyze(source: str, most_symbols: int | None = None) -> dict:
    """status, symbols, imports, calls and exports of one file; the first symbols only where a limit is given."""
    tree, status = parse(source)
    if tree is None:
        return {"status": status, "symbols": [], "imports": [], "calls": [], "exports": []}
    walk = _Walk(source.split("\n"))
    walk.visit(tree)
    top = [s["name"] for s in walk.symbols if s["parent"] is None]
    named = _all_names(tree)
    exports = named if named is not None else [n for n in dict.fromkeys(top) if not n.startswith("_")]
    for s in walk.symbols:
        s["is_exported"] = s["parent"] is None and s["name"] in exports
    return {"status": status, "symbols": walk.symbols[:most_symbols], "imports": walk.imports, "calls": walk.calls, "exports": exports}


def _analyzer(most_symbols: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, text in zip(batch["repository_id"], batch["path"], batch["content"]):
                try:
                    found = analyze(text or "", most_symbols)
                except (RecursionError, MemoryError):
                    found = {"status": "failed", "symbols": [], "imports": [], "calls": [], "exports": []}
                rows.append((repo, path, found["status"], found["symbols"], found["imports"], found["calls"], found["exports"]))
            yield pd.DataFrame(rows, columns=["repository_id", "path", "status", "symbols", "imports", "calls", "exports"])

    return run


def analyze_python(files: DataFrame, most_symbols: int | None = None) -> DataFrame:
    """PARSED rows of (repository_id, path, content) Python files; null contents are empty files."""
    return files.select("repository_id", "path", "content").mapInPandas(_analyzer(most_symbols), PARSED)


def symbol_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("repository_id", "path", F.inline("symbols"))


def import_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("repository_id", "path", F.posexplode("imports").alias("ord", "i")).select("repository_id", "path", "ord", "i.*")
