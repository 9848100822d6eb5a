"""Symbols, imports, exports, calls, rendered components and API calls of JavaScript and TypeScript.

Not a parser: comments, strings, templates and pattern literals are blanked first, so that
brackets can be paired and declarations found in what is left. Unpaired brackets make the
status `partial`; what was found still counts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

MOST_SYMBOLS = 5000
PARSED = (
    "repository_id string, path string, status string, has_jsx boolean, "
    "symbols array<struct<name:string,qualified_name:string,kind:string,parent:string,start_line:int,end_line:int,signature:string,docstring:string,return_type:string,is_exported:boolean,is_async:boolean,bases:array<string>,parameters:array<string>>>, "
    "imports array<struct<module:string,kind:string,names:array<struct<name:string,alias:string>>,line:int,is_type_only:boolean>>, "
    "exports array<struct<name:string,kind:string,source:string>>, calls array<struct<callee:string,line:int,caller:string,kind:string>>, renders array<struct<component:string,line:int,caller:string>>, "
    "api_calls array<struct<client:string,method:string,url:string,line:int>>"
)

_LEXEME = regex.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)) | (?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)
    | (?P<template>`(?:[^`\\$]|\\.|\$(?!\{)|\$(?P<hole>\{(?:[^{}`]|(?&hole)|`(?:[^`\\]|\\.)*`)*\}))*`?)
    | (?P<pattern>(?<=[=(,:;!&|?{}\[\n]\s*|\breturn\s*|^\s*)/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)""",
    regex.X | regex.S,
)
_NAME = r"[A-Za-z_$][\w$]*"
_HEAD = r"(?P<export>\bexport\s+(?P<default>default\s+)?)?(?:declare\s+)?"
_FUNCTION = re.compile(_HEAD + rf"(?P<async>\basync\s+)?\bfunction\b\s*\*?\s*(?P<name>{_NAME})?\s*(?:<[^()]*?>)?\s*(?=\()")
_CLASS = re.compile(_HEAD + rf"(?:abstract\s+)?\bclass\b\s*(?P<name>(?!extends\b){_NAME})?(?:<[^{{]*?>)?(?P<heritage>[^{{;]*)(?=\{{)")
_VALUE = re.compile(_HEAD + rf"\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=;\n]+?)?=(?![=>])\s*(?P<wrap>(?:React\.)?(?:memo|forwardRef|observer)\s*(?:<[^()]*>)?\(\s*)?(?P<async>async\s*)?(?P<fn>function\b\s*\*?\s*(?:{_NAME})?\s*(?=\()|(?:<[^()]*>\s*)?(?=\()|{_NAME}\s*(?==>))?")
_SHAPE = re.compile(_HEAD + rf"(?:const\s+)?\b(?P<kind>interface|type|enum)\s+(?P<name>{_NAME})\s*(?:<[^={{]*>)?\s*(?P<heritage>extends[^{{]*)?(?P<open>[={{])")
_METHOD = re.compile(rf"(?:(?<=[{{}};])|^)\s*(?:@[\w.]+(?:\([^()]*\))?\s*)*(?P<mods>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*)\*?\s*(?P<name>#?{_NAME})\s*(?:<[^()]*>)?\s*(?:(?=\()|=\s*(?P<arrow>async\s*)?(?=\())", re.M)
_NOT_METHODS = frozenset("if for while switch catch return function super new await typeof do else constructor_".split())
_CALL = re.compile(rf"(?<![\w$.])(?P<new>new\s+)?(?P<callee>{_NAME}(?:\??\.{_NAME})*)\s*(?:<[\w\s,.\[\]|]*>)?\(")
_NOT_CALLS = frozenset("if for while switch catch return function super typeof await import require of in async do else void delete throw case".split())
_RENDER = re.compile(r"(?<![\w$)\]])<(?P<name>[A-Z][\w.]*)(?=[\s/>])")
_JSX = re.compile(r"(?:return|=>|\(|\?|:|&&|=)\s*\(?\s*<(?:[A-Za-z][\w.]*[\s/>]|>)")
_IMPORT = re.compile(r"\bimport\s+(?P<type>type\s+)?(?P<what>[\w$*{}\s,]+?)\s+from\s*(?=[\"'])|\bimport\s*(?=[\"'])")
_EXPORT = re.compile(rf"\bexport\s+(?P<type>type\s+)?(?:\*\s*(?:as\s+(?P<space>{_NAME})\s*)?|\{{(?P<names>[^}}]*)\}}\s*)(?P<from>from\s*(?=[\"']))?|\bexport\s+default\s+(?P<default>{_NAME})\s*;?\s*$|\bmodule\.exports\s*=\s*(?:\{{(?P<common>[^}}]*)\}}|(?P<whole>{_NAME}))|\bexports\.(?P<one>{_NAME})\s*=", re.M)
_LOADED = re.compile(r"\b(?P<how>require|import)\s*\(\s*(?=[\"'`])")
#: Clients and methods of web requests. Fixed values.
_METHODS = "get post put patch delete head options request".split()
_API = re.compile(rf"(?<![\w$.])(?P<client>fetch|axios|ky|got|\w*(?:[Aa]pi|[Cc]lient|[Hh]ttp|axios))(?:\.(?P<method>{'|'.join(_METHODS)}))?\s*(?:<[^()]*>)?\(\s*(?=[\"'`])")
_REACT = re.compile(r"(?:React\.)?(?:Pure)?Component$")


class _File:
    def __init__(self, text: str):
        self.text = text
        out, self.comments = list(text), []
        for m in _LEXEME.finditer(text, timeout=20):
            if m.group("comment"):
                self.comments.append((m.start(), m.end(), m.group()))
            a, b = (m.start(), m.end()) if m.group("comment") or m.group("pattern") else (m.start() + 1, max(m.end() - 1, m.start() + 1))
            for k in range(a, b):
                if out[k] != "\n":
                    out[k] = " "
        self.code = "".join(out)
        self.lines = [0] + [m.end() for m in re.finditer("\n", text)]
        self.pair, stack, self.balanced = {}, [], True
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c = m.group()
            if c in "([{":
                stack.append((c, m.start()))
            elif stack and "([{".index(stack[-1][0]) == ")]}".index(c):
                self.pair[stack.pop()[1]] = m.start()
            else:
                self.balanced = False
        self.balanced &= not stack

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def literal(self, at: int) -> str | None:
        """The string that starts at or after white space from `at`, `{...}` for its holes."""
        m = re.compile(r"\s*([\"'`])").match(self.text, at)
        if not m:
            return None
        end = self.code.find(m.group(1), m.end())
        return re.sub(r"\$\{[^}]*\}", lambda h: "{" + h.group()[2:-1].strip() + "}", self.text[m.end() : end]) if end >= 0 else None

    def above(self, at: int) -> str | None:
        """The comment that ends right above a declaration."""
        begin = self.lines[self.line(at) - 1]
        found = []
        for a, b, text in reversed([c for c in self.comments if c[1] <= at]):
            if self.code[b:begin].strip() or self.text[b:begin].count("\n") > 1:
                break
            found.append(text)
            begin = a
            if text.startswith("/*"):
                break
        rows = [re.sub(r"^\s*(?:/\*+|\*+/|\*|//+)\s?|\s*\*/\s*$", "", r) for t in reversed(found) for r in t.split("\n")]
        return "\n".join(rows).strip()[:2000] or None


def _split(text: str) -> list[str]:
    """Parts at commas outside brackets."""
    out, depth, begin = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[k - 1 : k] != "="))
        if c == "," and depth <= 0:
            out.append(text[begin:k])
            begin = k + 1
    return [x.strip() for x in [*out, text[begin:]] if x.strip()]


def _aliases(text: str) -> list[dict]:
    out = []
    for part in _split(text):
        name, _, alias = re.sub(r"^type\s+", "", part).partition(" as ")
        out.append({"name": name.strip(), "alias": alias.strip() or None})
    return out


def _callable(f: _File, at: int) -> tuple[list[str], str | None, int] | None:
    """(parameters, return type, end) of what has its parameter list at `at`."""
    close = f.pair.get(at)
    if close is None:
        return None
    m = re.compile(r"\s*(?::\s*(?P<type>[^;\n]*?(?=\s*(?:=>|\{[^{}]*$|\{\s*$|\{)))?)?\s*(?:=>)?\s*", re.M).match(f.code, close + 1)
    end = m.end()
    stop = f.pair.get(end, end) if f.code[end : end + 1] in ("{", "(") else f.code.find("\n", end)
    params = [re.sub(r"\s+", " ", p) for p in _split(f.text[at + 1 : close])]
    return params, (m.group("type") or "").strip() or None, stop if stop >= 0 else len(f.code)


def analyze(text: str) -> dict:
    """status, has_jsx, symbols, imports, exports, calls, renders and api_calls of one file."""
    f = _File(text)
    code, symbols = f.code, []

    def add(m, kind, name, at, end, parent=None, params=(), back=None, bases=(), is_async=False):
        head = re.sub(r"\s+", " ", f.text[m.start() : min(end, code.find("{", at) if "{" in code[at:end] else end)]).strip(" ={")
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        exported = bool(m.groupdict().get("export"))
        symbols.append({"name": name, "qualified_name": f"{parent}.{name}" if parent else name, "kind": kind, "parent": parent, "start_line": f.line(start), "end_line": f.line(max(end - 1, start) if end > start else start), "signature": head[:300], "docstring": f.above(start), "return_type": back, "is_exported": exported, "is_async": is_async, "bases": list(bases), "parameters": list(params), "span": (start, end)})

    for m in _FUNCTION.finditer(code):
        name = m.group("name") or ("default" if m.group("default") else None)
        got = _callable(f, m.end()) if name else None
        if got:
            add(m, "function", name, m.end(), got[2] + 1, None, got[0], got[1], (), bool(m.group("async")))
    for m in _CLASS.finditer(code):
        end = f.pair.get(m.end())
        if end is None:
            continue
        bases = [re.sub(r"<.*", "", b).strip() for part in re.split(r"\b(?:extends|implements)\b", m.group("heritage"))[1:] for b in _split(part)]
        name = m.group("name") or "default"
        add(m, "component" if bases and _REACT.match(bases[0]) else "class", name, m.end(), end + 1, None, (), None, bases)
        for k in _METHOD.finditer(code, m.end() + 1, end):
            inner = [p for p in f.pair if m.end() < p < k.start("name") < f.pair[p]]
            got = None if inner or k.group("name") in _NOT_METHODS else _callable(f, k.end())
            if got and (code[got[2] : got[2] + 1] == "}" or k.group("arrow") is not None or "=>" in code[k.end() : got[2]]):
                add(k, "method", k.group("name"), k.end(), got[2] + 1, name, got[0], got[1], (), "async" in k.group("mods") or bool(k.group("arrow")))
    for m in _VALUE.finditer(code):
        got = None
        if m.group("fn") is not None:
            at = m.end()
            if code[at : at + 1] == "(":
                got = _callable(f, at)
                tail = code[f.pair.get(at, at) + 1 : (got[2] if got else at) + 1]
                if got and not m.group("fn").startswith("function") and "=>" not in tail.split("{")[0]:
                    got = None
            else:
                arrow = re.compile(r"\s*=>\s*").match(code, at)
                end = f.pair.get(arrow.end(), code.find("\n", arrow.end())) if arrow else -1
                got = ([m.group("fn").strip()], None, end if end >= 0 else len(code))
        if got:
            add(m, "component" if m.group("wrap") else "function", m.group("name"), m.end(), got[2] + 1, None, got[0], got[1], (), bool(m.group("async")))
        elif m.group("export"):
            end = code.find(";", m.end())
            add(m, "variable", m.group("name"), m.end(), end if end >= 0 else m.end())
    for m in _SHAPE.finditer(code):
        end = f.pair.get(m.end() - 1) if m.group("open") == "{" else code.find(";", m.end())
        bases = _split(re.sub(r"^extends", "", m.group("heritage") or ""))
        add(m, {"type": "type_alias"}.get(m.group("kind"), m.group("kind")), m.group("name"), m.end(), (end if end and end >= 0 else m.end()) + 1, None, (), None, bases)

    top = sorted(symbols, key=lambda s: (s["span"][0], -s["span"][1]))

    def owner(at: int) -> str | None:
        inside = [s for s in top if s["span"][0] <= at < s["span"][1]]
        return min(inside, key=lambda s: s["span"][1] - s["span"][0])["qualified_name"] if inside else None

    for s in top:
        if s["parent"] is None and s["kind"] in ("function", "method", "class"):
            around = [o for o in top if o is not s and o["span"][0] <= s["span"][0] and s["span"][1] <= o["span"][1]]
            if around and s["kind"] == "function":
                up = min(around, key=lambda o: o["span"][1] - o["span"][0])
                s["parent"], s["qualified_name"] = up["qualified_name"], f"{up['qualified_name']}.{s['name']}"

    imports, exports, calls, renders, api = [], [], [], [], []
    for m in _IMPORT.finditer(code):
        module, what = f.literal(m.end()), m.group("what")
        if module is None:
            continue
        names = []
        if what:
            braces = re.search(r"\{(.*?)\}", what, re.S)
            rest = what.replace(braces.group(), "") if braces else what
            for part in _split(rest):
                space = re.match(r"\*\s*as\s+([\w$]+)", part)
                names.append({"name": "*", "alias": space.group(1)} if space else {"name": "default", "alias": part})
            names += _aliases(braces.group(1)) if braces else []
        imports.append({"module": module, "kind": "import" if what else "side_effect", "names": names, "line": f.line(m.start()), "is_type_only": bool(m.group("type"))})
    for m in _LOADED.finditer(code):
        module = f.literal(m.end())
        left = re.search(rf"(?:const|let|var)\s+(?:({_NAME})|\{{([^}}]*)\}})\s*=\s*(?:await\s+)?$", code[max(0, m.start() - 200) : m.start()])
        names = ([{"name": "*", "alias": left.group(1)}] if left.group(1) else _aliases(left.group(2).replace(":", " as "))) if left else []
        imports.append({"module": module, "kind": "require" if m.group("how") == "require" else "dynamic", "names": names, "line": f.line(m.start()), "is_type_only": False})
    for m in _EXPORT.finditer(code):
        source = f.literal(m.end()) if m.group("from") else None
        if m.group("default") or m.group("whole") or m.group("one"):
            exports.append({"name": m.group("default") or m.group("whole") or m.group("one"), "kind": "default" if m.group("default") else "commonjs", "source": None})
        elif m.group("common") is not None:
            exports += [{"name": p.split(":")[0].strip(), "kind": "commonjs", "source": None} for p in _split(m.group("common"))]
        elif m.group("names") is not None:
            exports += [{"name": a["alias"] or a["name"], "kind": "re_export" if source else "named", "source": source} for a in _aliases(m.group("names"))]
        elif source:
            exports.append({"name": m.group("space") or "*", "kind": "namespace", "source": source})
        if source:
            imports.append({"module": source, "kind": "re_export", "names": _aliases(m.group("names") or ""), "line": f.line(m.start()), "is_type_only": bool(m.group("type"))})
    named = {e["name"] for e in exports if e["kind"] in ("named", "default", "commonjs")}
    for s in top:
        s["is_exported"] |= s["parent"] is None and s["name"] in named
        if s["is_exported"] and s["name"] not in named:
            exports.append({"name": s["name"], "kind": "named", "source": None})
    heads = {s["span"][0] for s in top}
    declared = {m.start("name") for p in (_FUNCTION,) for m in p.finditer(code) if m.group("name")} | {s["span"][0] + code[s["span"][0] : s["span"][1]].find(s["name"]) for s in top if s["kind"] == "method"}
    for m in _CALL.finditer(code):
        callee = m.group("callee").replace("?.", ".")
        if callee.split(".")[0] not in _NOT_CALLS and m.start("callee") not in declared and m.start("callee") not in heads and len(callee) <= 200:
            calls.append({"callee": callee, "line": f.line(m.start()), "caller": owner(m.start()), "kind": "new" if m.group("new") else "call"})
    for m in _RENDER.finditer(code):
        renders.append({"component": m.group("name"), "line": f.line(m.start()), "caller": owner(m.start())})
    for m in _API.finditer(code):
        url = f.literal(m.end())
        if url and (m.group("method") or m.group("client") in ("fetch", "axios", "ky", "got")):
            api.append({"client": m.group("client"), "method": (m.group("method") or "get").upper(), "url": url, "line": f.line(m.start())})
    jsx = [m.start() for m in _JSX.finditer(code)]
    for s in top:
        if s["kind"] == "function" and s["name"][:1].isupper() and any(s["span"][0] <= j < s["span"][1] for j in jsx):
            s["kind"] = "component"
        del s["span"]
    return {"status": "parsed" if f.balanced else "partial", "has_jsx": bool(jsx), "symbols": top[:MOST_SYMBOLS], "imports": imports, "exports": exports, "calls": calls, "renders": renders, "api_calls": api}


def _analyzer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["status", "has_jsx", "symbols", "imports", "exports", "calls", "renders", "api_calls"]
    for batch in batches:
        rows = []
        for repo, path, text in zip(batch["repository_id"], batch["path"], batch["content"]):
            try:
                found = analyze(text or "")
            except (TimeoutError, RecursionError):
                found = {"status": "failed", "has_jsx": False} | {c: [] for c in columns[2:]}
            rows.append((repo, path, *(found[c] for c in columns)))
        yield pd.DataFrame(rows, columns=["repository_id", "path", *columns])


def analyze_ecmascript(files: DataFrame) -> DataFrame:
    """PARSED rows of (repository_id, path, content) scripts; null contents are empty files."""
    return files.select("repository_id", "path", "content").mapInPandas(_analyzer, PARSED)
