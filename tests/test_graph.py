from codelode.operators import graph, python_analysis, resolution

FILES = {
    "app/__init__.py": "",
    "app/base.py": "class Root:\n    def shared(self):\n        return 1\n\nclass Base(Root):\n    def own(self):\n        return self.shared()\n",
    "app/util.py": "def helper():\n    return 1\n\ndef helper():\n    return 2\n\ndef caller():\n    return helper()\n",
    "app/service.py": "from .base import Base\nfrom . import util\nfrom .util import helper as h\n\nclass Service(Base):\n    def run(self):\n        self.own()\n        self.shared()\n        self.missing()\n        util.helper()\n        h()\n        Service.run(self)\n\nhelper()\n",
}


def test_python_project(spark):
    files = spark.createDataFrame([("r", p, t) for p, t in FILES.items()], "repository_id string, path string, content string")
    parsed = python_analysis.analyze_python(files)
    symbols, imports = python_analysis.symbol_rows(parsed), python_analysis.import_rows(parsed)
    found = resolution.resolve_python_relative(imports, files)
    modules = found.filter("target <> ''").select("repository_id", "path", "ord", "target", "resolved_path")
    packages = found.filter("target = ''").select("repository_id", "path", "ord", "resolved_path")
    # a name that is a module itself is bound to that module
    named = imports.selectExpr("repository_id", "path", "ord", "kind", "inline(names)").withColumnRenamed("name", "target").join(modules, ["repository_id", "path", "ord", "target"]).selectExpr("repository_id", "path", "ord", "kind", "resolved_path", "array(named_struct('name', '*', 'alias', coalesce(alias, target))) names")
    rest = imports.join(packages, ["repository_id", "path", "ord"]).select("repository_id", "path", "ord", "kind", "resolved_path", "names")
    bound = rest.unionByName(named.selectExpr("repository_id", "path", "ord + 1000 ord", "kind", "resolved_path", "names"))
    calls = parsed.selectExpr("repository_id", "path", "inline(calls)")
    got = {(r["caller"], r["callee"]): (r["target_path"], r["target"], r["strategy"]) for r in graph.resolve_references(calls, symbols, bound).collect()}
    assert got == {
        ("Base.own", "self.shared"): ("app/base.py", "Root.shared", "self_inherited"),
        ("caller", "helper"): ("app/util.py", "helper", "same_file"),
        ("Service.run", "self.own"): ("app/base.py", "Base.own", "self_inherited"),
        ("Service.run", "self.shared"): ("app/base.py", "Root.shared", "self_inherited"),
        ("Service.run", "util.helper"): ("app/util.py", "helper", "namespace"),
        ("Service.run", "h"): ("app/util.py", "helper", "import"),
        ("Service.run", "Service.run"): ("app/service.py", "Service.run", "member"),
    }
    edges = graph.symbol_edges(graph.resolve_references(calls, symbols, bound)).collect()
    assert {(e["source"], e["target"], e["weight"]) for e in edges if e["source"] == "Service.run"} == {("Service.run", "Base.own", 1), ("Service.run", "Root.shared", 1), ("Service.run", "helper", 2)}
    assert graph.resolve_references(calls.limit(0), symbols, bound).count() == 0


def test_reexport_chains(spark):
    s = "repository_id string, path string, qualified_name string, name string, kind string, parent string, is_exported boolean, bases array<string>, start_line int"
    symbols = spark.createDataFrame([("r", "c.ts", "f", "f", "function", None, True, [], 1), ("r", "c.ts", "hidden", "hidden", "function", None, False, [], 2), ("r", "c.ts", "default", "default", "function", None, True, [], 3)], s)
    re = spark.createDataFrame([("r", "b.ts", "*", None, "c.ts"), ("r", "a.ts", "f", "g", "b.ts"), ("r", "c.ts", "*", None, "a.ts")], "repository_id string, path string, name string, alias string, target string")
    got = {(r["path"], r["name"]): (r["source"], r["qualified_name"]) for r in graph.exported(symbols, re).collect()}
    assert got[("a.ts", "g")] == ("c.ts", "f") and got[("b.ts", "f")] == ("c.ts", "f") and ("b.ts", "default") not in got and ("b.ts", "hidden") not in got


def test_import_edges(spark):
    rows = spark.createDataFrame([("r", "a", "b", 0, "inferred", "x", 1), ("r", "a", "b", 1, "confirmed", "y", 2), ("r", "a", "a", 2, "confirmed", "z", 3), ("r", "a", None, 3, None, "q", 4)], "repository_id string, path string, resolved_path string, ord int, confidence string, module string, line int")
    got = graph.import_edges(rows).collect()
    assert [(e["weight"], e["confidence"], e["specifiers"], e["lines"]) for e in got] == [(2, "confirmed", ["x", "y"], [1, 2])]
