import json
import os

from codelode.operators import catalog, chunking, python_analysis, resolution
from codelode.session import discard, materialise, once_by_id, once_in_place, shared_dir
from codelode.sources import corpus
from codelode.streaming.reindex import reindexing

SYMBOL = dict(id="s", name="f", kind="function", qualified_name="f", start=3, end=5, parent=None)


def spans(chunks):
    return [(c["chunk_type"], c["first"], c["last"]) for c in chunks]


def test_windows_overlap_and_cover():
    text = "\n".join(f"x{n}" for n in range(150))
    got = chunking.text_chunks("a.txt", text)
    assert spans(got) == [("window", 1, 60), ("window", 53, 112), ("window", 105, 150)]
    assert chunking.text_chunks("a.txt", "  \n ") == [] and chunking.text_chunks("a.txt", "") == []


def test_windows_end_at_blank_lines():
    rows = [f"x{n}" for n in range(100)]
    rows[50] = ""
    assert spans(chunking.text_chunks("a.txt", "\n".join(rows)))[0] == ("window", 1, 50)


def test_markdown_sections():
    got = chunking.text_chunks("a.md", "intro\n# One\ntext\n## Two ##\nmore")
    assert [(c["first"], c["last"], c["symbol_name"]) for c in got] == [(1, 1, None), (2, 3, "One"), (4, 5, "Two ##")]
    assert chunking.text_chunks("b.md", "# only a remark") == []


def test_source_file():
    text = "import a\n\ndef f():\n    x = 1\n    return x\n\nlast = 1\n"
    assert spans(chunking.source_chunks(text, [SYMBOL])) == [("symbol", 3, 5), ("module", 1, 2), ("module", 6, 7)]


def test_large_class_is_cut_at_members():
    rows = ["class A:", "    '''doc'''"] + [f"    a{n} = 1" for n in range(70)] + ["    def m(self):", "        pass"] + ["", "    tail = 2"]
    symbols = [dict(id="1", name="A", kind="class", qualified_name="A", start=1, end=len(rows), parent=None), dict(id="2", name="m", kind="method", qualified_name="A.m", start=73, end=74, parent="A")]
    got = spans(chunking.source_chunks("\n".join(rows), symbols))
    assert got == [("symbol_header", 1, 72), ("symbol", 73, 74), ("module", 75, 76)]


def test_chunk_rows_have_stable_ids(spark):
    schema = "repository_id string, file_path string, language string, content string, symbols array<struct<id:string,name:string,kind:string,qualified_name:string,start_line:int,end_line:int,parent:string>>"
    moved = "\n\n" + "def f():\n    return 1"
    rows = [("r", "a.py", "python", "def f():\n    return 1", [("s", "f", "function", "f", 1, 2, None)]), ("r", "n.md", None, "# T\ntext", None), ("r", "e.md", None, None, None)]
    first = chunking.chunk_files(spark.createDataFrame(rows, schema)).collect()
    again = chunking.chunk_files(spark.createDataFrame([("r", "a.py", "python", moved, [("s", "f", "function", "f", 3, 4, None)])], schema)).collect()
    assert len(first) == 2 and {r["language"] for r in first} == {"python", "Text"}
    assert [r["id"] for r in first if r["chunk_type"] == "symbol"] == [r["id"] for r in again if r["chunk_type"] == "symbol"]
    assert all(r["token_count"] > 0 for r in first)


CODE = '''
from __future__ import annotations
import os, sys as system
from .models import User as U
from typing import TYPE_CHECKING
if TYPE_CHECKING:
    import heavy

__all__ = ["Service"]
__all__ += ["run"]

class Service(Base):
    """Does things."""

    @property
    def name(self) -> str:
        return self._name.strip()

# runs it
async def run(a, /, b: int = 1, *args, c=2, **kw):
    await helper(a)
'''


def test_python_analysis():
    got = python_analysis.analyze(CODE)
    by = {s["qualified_name"]: s for s in got["symbols"]}
    assert got["status"] == "parsed" and got["exports"] == ["Service", "run"]
    assert by["Service"]["docstring"] == "Does things." and by["Service"]["bases"] == ["Base"]
    assert by["Service.name"]["kind"] == "method" and by["Service.name"]["start_line"] == by["Service.name"]["end_line"] - 2
    assert by["run"]["is_async"] and by["run"]["docstring"] == "runs it" and by["run"]["is_exported"]
    assert [p["kind"] for p in by["run"]["parameters"]] == ["positional_only", "positional", "var_positional", "keyword_only", "var_keyword"]
    assert [(i["module"], i["level"], i["is_type_only"]) for i in got["imports"]][-1] == ("heavy", 0, True)
    assert {"callee": "helper", "line": 21, "caller": "run"} in got["calls"]


def test_python_analysis_of_broken_files(spark):
    got = python_analysis.analyze("def good():\n    pass\n\ndef bad(:\n    pass\n\ndef also():\n    pass\n")
    assert got["status"] == "partial" and [s["name"] for s in got["symbols"]] == ["good", "also"]
    rows = spark.createDataFrame([("r", "a.py", None), ("r", "b.py", "x ="), ("r", "c.py", "def f(): pass")], "repository_id string, path string, content string")
    assert {r["path"]: r["status"] for r in python_analysis.analyze_python(rows).collect()}["c.py"] == "parsed"


PATHS = ["app/__init__.py", "app/core.py", "app/models/__init__.py", "app/models/user.py", "lib/app/core.py", "web/a.ts", "web/b.tsx", "web/ui/index.ts", "web/tsconfig.json", "web/ui/deep/x.ts"]


def test_python_resolution(spark):
    files = spark.createDataFrame([("r", p) for p in PATHS], "repository_id string, path string")
    rows = [("r", "app/core.py", 0, "models", 1, [("user",)]), ("r", "app/models/user.py", 1, "", 2, [("core",)])]
    imports = spark.createDataFrame(rows, "repository_id string, path string, ord int, module string, level int, names array<struct<name:string>>")
    got = {(r["path"], r["target"]): r["resolved_path"] for r in resolution.resolve_python_relative(imports, files).collect()}
    assert got == {("app/core.py", ""): "app/models/__init__.py", ("app/core.py", "user"): "app/models/user.py", ("app/models/user.py", ""): "app/__init__.py", ("app/models/user.py", "core"): "app/core.py"}
    absolute = spark.createDataFrame([("r", "app/x.py", 0, "app.core", 0), ("r", "app/x.py", 1, "numpy.linalg", 0), ("r", "app/x.py", 2, "app.models.user", 0)], "repository_id string, path string, ord int, module string, level int")
    r = {x["ord"]: x for x in resolution.resolve_python_absolute(absolute, files).collect()}
    assert (r[0]["confidence"], r[0]["resolved_path"], r[0]["candidates"]) == ("inferred", "app/core.py", ["app/core.py", "lib/app/core.py"])
    assert (r[1]["status"], r[1]["package"]) == ("external", "numpy") and r[2]["confidence"] == "confirmed"


def test_js_resolution(spark):
    files = spark.createDataFrame([("r", p) for p in PATHS], "repository_id string, path string")
    mods = ["./b", "./ui", "./a.js", "../../x", "./none"]
    imports = spark.createDataFrame([("r", "web/a.ts", i, m) for i, m in enumerate(mods)], "repository_id string, path string, ord int, module string")
    got = {r["module"]: r["resolved_path"] for r in resolution.resolve_js_relative(imports, files).collect()}
    assert got == {"./b": "web/b.tsx", "./ui": "web/ui/index.ts", "./a.js": "web/a.ts", "../../x": None, "./none": None}
    near = resolution.nearest_config(files.filter("path like '%deep%'"), files.filter("path like '%tsconfig.json'")).collect()
    assert near[0]["config"] == "web/tsconfig.json"


def test_closure(spark):
    e = spark.createDataFrame([(n, n + 1) for n in range(8)] + [(1, 0)], "source int, target int")
    got = {(r["source"], r["target"]): r["steps"] for r in resolution.closure(e).collect()}
    assert got[(0, 4)] == 4 and (0, 5) not in got and (0, 0) not in got


def test_edges(spark):
    rows = spark.createDataFrame([(1, 2, 1, "inferred", "a", 9), (1, 2, 0, "confirmed", "b", 9), (3, 3, 2, "confirmed", "a", 1)], "source int, target int, ord int, confidence string, strategy string, line int")
    got = catalog.aggregate_edges(rows).collect()
    assert [(r["weight"], r["confidence"], r["strategies"], r["lines"]) for r in got] == [(2, "confirmed", ["b", "a"], [9])]


def test_stale_index():
    m = {"commit_sha": "a", "model_id": "h"}
    assert [catalog.stale_index(None, "a"), catalog.stale_index(m, "b"), catalog.stale_index(m, "a"), catalog.stale_index(m, "a", "x")] == ["index_not_built", "index_out_of_date", None, "dense_index_unavailable"]


def test_source_tree_and_versions(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_bytes(b"x\ny")
    (root / "bin.dat").write_bytes(b"\x01\x00\x02")
    (root / "node_modules" / "b.js").write_text("x")
    files = corpus.source_tree(spark, str(root), "r")
    assert sorted(r["path"] for r in files.collect()) == ["a.py", "bin.dat"]
    rows = corpus.index_rows(corpus.readable(files)).collect()
    assert [(r["path"], r["language"], r["line_count"], r["size_bytes"]) for r in rows] == [("a.py", "Python", 2, 3)]
    out = str(tmp_path / "index")
    corpus.write_version({"t": spark.range(3)}, out, {"commit_sha": "a"})
    corpus.write_version({"t": spark.range(5)}, out, {"commit_sha": "b"})
    assert corpus.read_version(spark, out, "t").count() == 5 and corpus.read_manifest(out)["commit_sha"] == "b"
    assert corpus.read_manifest(str(tmp_path / "none")) is None


def test_jsonc_and_query_sets(spark, tmp_path):
    assert corpus.parse_jsonc('{"a": "//x", /* c */ "b": [1, 2,], // d\n}') == {"a": "//x", "b": [1, 2]}
    assert corpus.parse_jsonc("{") is None
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"queries": [{"query": "x", "relevant_files": ["a"]}]}))
    assert corpus.query_set(spark, str(path)).collect()[0]["relevant"] == ["a"]


def test_reindexing_stream_replaces_repositories(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 1)], "repository_id string, v int").write.parquet(source)
    for value in (2, 3):
        stream = spark.readStream.schema("repository_id string, v int").parquet(source)
        reindexing(stream, lambda df: df, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        spark.createDataFrame([("a", value)], "repository_id string, v int").write.mode("append").parquet(source)
    got = {r["repository_id"]: r["v"] for r in spark.read.parquet(out).collect()}
    assert got == {"a": 2, "b": 1} and os.path.isdir(out)


def test_catalog_pages(spark):
    import pytest

    with pytest.raises(ValueError):
        catalog.page(spark.range(3), ["id"], 0)
    assert catalog.envelope(spark.range(3), ["id"], 2, 1)["total"] == 3


def test_python_many_faulty_blocks_and_symbols():
    faulty = "".join(f"print 'step {n}'\n" for n in range(60))
    got = python_analysis.analyze("import os\n" + faulty + "def late():\n    pass\n")
    assert got["status"] == "partial" and [s["name"] for s in got["symbols"]] == ["late"] and [i["module"] for i in got["imports"]] == ["os"]
    assert python_analysis.analyze(faulty)["symbols"] == []
    many = "".join(f"def f{n}(): pass\n" for n in range(5001))
    assert len(python_analysis.analyze(many)["symbols"]) == 5001 and len(python_analysis.analyze(many, 10)["symbols"]) == 10


def test_written_tables_lie_in_the_shared_folder_until_discarded(spark):
    df = materialise(spark.range(3), "t")
    path = df._written_at
    assert df.count() == 3 and path.startswith(shared_dir(spark)) and os.path.exists(path.removeprefix("file:"))
    discard(df)
    assert not os.path.exists(path.removeprefix("file:"))


def test_once_in_place(spark, tmp_path):
    rows = [(f"k{i % 40}", f"text {i % 40}", i % 3) for i in range(60)] + [(None, "x", 1)] * 3 + [("hot", "same", 0)] * 30
    spark.createDataFrame(rows, "id string, text string, n int").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = [tuple(r) for r in once_in_place(df.select("id", "text")).collect()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in once_by_id(df.select("id", "text")).collect()), key=str) and len(got) == 44
    assert once_in_place(df.filter("id = 'none'")).count() == 0
    assert once_in_place(spark.createDataFrame(rows, df.schema)).count() == 44
