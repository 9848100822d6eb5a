"""Catalog, resolution and graph operators on small tables."""

import json

from pyspark.sql import functions as F

from codelode.operators import catalog, graph, python_analysis, resolution

FILES = "id string, repository_id string, path string, size_bytes long"


def files(spark, *paths, repo="r"):
    return spark.createDataFrame([(f"f{i}", repo, p, 10 + i) for i, p in enumerate(paths)], FILES)


def test_notable_files(spark):
    df = files(spark, "README.md", "readme.txt", "docs/README.md", "COPYING", "a/package.json", "go.mod", "x.py")
    row = catalog.notable_files(df.unionByName(df)).first()
    assert (row["manifests"], row["readme"], row["license"]) == (["a/package.json", "go.mod"], "README.md", "COPYING")
    none = catalog.notable_files(files(spark, "x.py")).first()
    assert (none["manifests"], none["readme"], none["license"]) == (None, None, None)


def test_totals_and_sizes(spark):
    df = files(spark, "a/x", "a/y", "b/z")
    row = catalog.file_totals(df.unionByName(df.limit(1)), 11).first()
    assert (row["total_files"], row["total_size_bytes"], row["indexed_files"]) == (3, 33, 2)
    assert catalog.directory_size(df, "a/") == 21 and catalog.directory_size(df.limit(0)) == 0


def test_by_ids(spark):
    df, ids = files(spark, "a", "b"), spark.createDataFrame([("f1",), ("f1",), ("no",)], "id string")
    assert [r["path"] for r in catalog.by_ids(df, ids).collect()] == ["b"]
    assert [r["id"] for r in catalog.missing_ids(df, ids).collect()] == ["no"]


def test_edge_page_and_neighbours(spark):
    edges = spark.createDataFrame([("e1", "calls", 2, "f0", "gone", "s0", None), ("e2", "calls", 5, "f1", "f0", None, None), ("e3", "imports", 9, "f0", "f1", None, None)], "id string, relationship_type string, weight int, source_file_id string, target_file_id string, source_symbol_id string, target_symbol_id string")
    symbols = spark.createDataFrame([("s0", "A.b")], "id string, qualified_name string")
    got = {r["id"]: (r["source_path"], r["target_path"], r["source_symbol"]) for r in catalog.edge_page(edges, files(spark, "a", "b"), symbols, 2).collect()}
    assert got == {"e2": ("b", "a", None), "e1": ("a", "?", "A.b")}
    star = spark.createDataFrame([("n", f"m{i:02d}", 100 - i) for i in range(15)] + [("x", "n", 1)], "source string, target string, weight int")
    rows = catalog.neighbours(star, F.lit("n")).collect()
    out = [r for r in rows if r["direction"] == "outgoing"]
    assert len(out) == 12 and [r["more"] for r in out if r["more"]] == [4] and len(rows) == 13


def test_first_distinct(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, "y"), ("a", 4, "z"), ("b", 1, None)], "k string, o int, v string")
    assert {r["k"]: r["out"] for r in catalog.first_distinct(rows, ["k"], "v", "o", 2, "out").collect()} == {"a": ["y", "x"], "b": [None]}


def test_labels_dashboard_and_backfill(spark):
    rows = [("1", "p", "shop", "ada", "https://github.com/ada/shop", "github", "a" * 40, "completed", "main", None), ("2", "p", "lone", None, "https://host.org//team/lone", "local", None, "ready", "dev", "x")]
    df = spark.createDataFrame(rows, "id string, project_id string, name string, owner string, url string, source_type string, commit_sha string, status string, default_branch string, branch string")
    got = {r["id"]: tuple(r)[1:] for r in catalog.repository_labels(df).collect()}
    assert got == {"1": ("ada/shop", "aaaaaaa", f"https://github.com/ada/shop/commit/{'a' * 40}"), "2": ("lone", None, None)}
    assert tuple(catalog.dashboard(df.unionByName(df)).first()) == (1, 2, 1)
    new = {r["id"]: (r["branch"], r["status"], r["owner"]) for r in catalog.backfill(df).collect()}
    assert new == {"1": ("main", "completed", "ada"), "2": ("x", "completed", "team")}
    once = catalog.get_or_create(df, df.withColumn("name", F.lit("third")))
    assert once.count() == 3 and catalog.get_or_create(once, df).count() == 3


def test_compact(spark):
    df = spark.createDataFrame([("a", "", False, 0, ["x"])], "n string, e string, b boolean, i int, l array<string>")
    assert json.loads(df.select(catalog.compact(df, df.columns)).first()[0]) == {"n": "a", "l": ["x"]}


PROJECT = {
    "run.py": "import store\nfrom store import tools\nimport store.core\nimport yaml\n\ndef main():\n    store.core.save(1)\n    tools.clean('x')\n",
    "store/__init__.py": "from .core import save\n",
    "store/core.py": "from .base import Base\nfrom .tools import clean as tidy\n\ndef save(x):\n    tidy(x)\n    return Item()\n\nclass Item(Base):\n    def price(self):\n        self.check()\n        self.own()\n    def own(self):\n        pass\n",
    "store/base.py": "class Base:\n    def check(self):\n        pass\n",
    "store/tools.py": "from ..nothing import a\nfrom . import gone\n\ndef clean(x):\n    return clean(x)\n",
}


def test_python_project_graph(spark):
    sources = spark.createDataFrame([("r", p, t) for p, t in PROJECT.items()], "repository_id string, path string, content string")
    parsed = python_analysis.analyze_python(sources).cache()
    symbols, calls = python_analysis.symbol_rows(parsed), parsed.select("repository_id", "path", F.inline("calls"))
    imports = resolution.resolve_python(python_analysis.import_rows(parsed), sources.select("repository_id", "path"))
    edges = {(r["type"], r["source"] or r["source_path"], r["target"] or r["target_path"], r["confidence"]) for r in graph.code_graph(symbols, imports, calls).collect()}
    want = {
        ("imports", "run.py", "store/__init__.py", "confirmed"), ("imports", "run.py", "store/tools.py", "confirmed"), ("imports", "run.py", "store/core.py", "confirmed"), ("imports", "store/__init__.py", "store/core.py", "confirmed"),
        ("imports", "store/core.py", "store/base.py", "confirmed"), ("imports", "store/core.py", "store/tools.py", "confirmed"), ("imports", "store/tools.py", "store/__init__.py", "confirmed"),
        ("calls", "main", "clean", "inferred"), ("calls", "save", "clean", "inferred"), ("calls", "save", "Item", "inferred"), ("calls", "Item.price", "Base.check", "inferred"), ("calls", "Item.price", "Item.own", "inferred"),
        ("inherits", "Item", "Base", "inferred"),
    }
    assert edges - {("calls", "main", "save", "inferred")} == want
    listed = {r["caller"]: r["callees"] for r in graph.symbol_calls(calls).collect()}
    assert listed["Item.price"] == ["self.check", "self.own"] and listed["main"][0] == "store.core.save"
    status = {(r["path"], r["module"]): r["status"] for r in imports.filter("kind <> 'import' or module = 'yaml'").collect()}
    assert status[("run.py", "yaml")] == "external" and status[("store/tools.py", "nothing")] == "unresolved"
    rows = graph.code_graph(symbols, imports, calls)
    facts = {(r["facet"], r["value"]): r["n"] for r in catalog.repository_summary(symbols, parsed.select("repository_id", F.lit("python").alias("language"), F.col("status").alias("parse_status")), imports, rows).collect()}
    assert facts[("files_by_language", "python")] == 5 and facts[("relationships", "imports:inferred")] == 0 and facts[("relationships", "inherits:inferred")] == 1
    assert facts[("most_imported", "store/core.py")] == 2 and facts[("external_packages", "yaml")] == 1


def test_script_aliases(spark):
    configs = [("r", "tsconfig.base.json", '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["lib/*", "app/*"]}}}'), ("r", "web/tsconfig.json", '{// comment\n "extends": "../tsconfig.base", "compilerOptions": {},}'), ("r", "api/tsconfig.json", '{"compilerOptions": {"paths": {"~one": ["./one.ts"]}}}'), ("r", "bad/tsconfig.json", "{")]
    table = spark.createDataFrame(configs, "repository_id string, path string, content string")
    known = spark.createDataFrame([("r", p) for p in ("src/app/x.ts", "src/util/index.ts", "api/one.ts", "web/a.ts", "api/b.ts", *[c[1] for c in configs])], "repository_id string, path string")
    asked = [("web/a.ts", "@/x"), ("web/a.ts", "util"), ("web/a.ts", "react/jsx"), ("web/a.ts", "@scope/pkg/deep"), ("web/a.ts", "/abs"), ("web/a.ts", "node:fs"), ("api/b.ts", "~one"), ("bad/c.ts", "left-pad")]
    imports = spark.createDataFrame([("r", p, k, m) for k, (p, m) in enumerate(asked)], "repository_id string, path string, ord int, module string")
    got = {r["module"]: (r["resolved_path"], r["package"]) for r in resolution.resolve_js_bare(imports, known, table).collect()}
    assert got["@/x"] == ("src/app/x.ts", None) and got["util"] == ("src/util/index.ts", None) and got["~one"] == ("api/one.ts", None)
    assert got["react/jsx"] == (None, "react") and got["@scope/pkg/deep"] == (None, "@scope/pkg") and got["left-pad"] == (None, "left-pad")
    assert got["/abs"][0] is None and got["node:fs"][0] is None


def test_pattern_match(spark):
    rows = spark.createDataFrame([("@/*", "@/lib/api"), ("a*z", "a1z"), ("a*z", "az"), ("ab*ba", "aba"), ("same", "same"), ("same", "other"), ("*", "x")], "p string, n string")
    got = [r[0] for r in rows.select(resolution.pattern_match(F.col("p"), F.col("n"))).collect()]
    assert got == ["lib/api", "1", "", None, "", None, "x"]
