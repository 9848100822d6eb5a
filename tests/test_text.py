import uuid

import pytest
from pyspark.sql import functions as F

from codelode.functions.languages import analyzer_of, ignored, language_of, worth_chunking
from codelode.functions.paths import CHUNK_NAMESPACE, ancestors, branch_ok, git_failure, normalise, relative_path_ok, repository_url, shared_prefix, uuid5
from codelode.functions.text import chunk_header, collapse, line_count, stem, tokens


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_stems(spark):
    words = ["files", "file", "string", "classes", "queries", "class", "parsed", "bus"]
    assert column(spark, words, stem) == ["fil", "file", "str", "class", "query", "class", "pars", "bus"]


def test_tokens(spark):
    got = column(spark, ["getUserByID user_id", "the _private 2fa", "x" * 41, "", None, "HTTPServer"], tokens)
    assert got[0] == ["get", "user", "id", "getuserbyid", "user", "id", "userid"]
    assert got[1] == ["private", "fa"]
    assert got[2] == [] and got[3] == [] and got[4] == []
    assert got[5] == ["http", "server", "httpserver"]


def test_lines_and_collapse(spark):
    assert column(spark, ["", "a", "a\n", "a\nb", "\n\n"], line_count) == [0, 1, 1, 2, 2]
    assert column(spark, ["  a \n b  "], collapse) == ["a b"]
    assert len(column(spark, ["ab " * 300], collapse)[0]) <= 300


def test_header(spark):
    df = spark.createDataFrame([("a.py", "python", "symbol", "function", "f"), ("a.py", "python", "module", None, None)], "p string, l string, c string, s string, n string")
    got = [r[0] for r in df.select(chunk_header(*[F.col(c) for c in "plcsn"])).collect()]
    assert got == ["a.py (python) - function f", "a.py (python)"]


def test_languages(spark):
    assert column(spark, ["a/b.PY", "Dockerfile", ".gitignore", "x", "a.tar.gz", "CMakeLists.txt", "m.d.ts"], language_of) == ["Python", "Dockerfile", None, None, None, "CMake", "TypeScript"]
    assert column(spark, ["a/node_modules/x.js", "dist.js", "src/a.js"], ignored) == [True, False, False]
    assert column(spark, ["a.json", "go.sum", "a.md", "a.bin", "a.py"], lambda c: worth_chunking(c, language_of(c))) == [False, False, True, False, True]
    assert column(spark, ["a.min.js", "a.TSX", "a.py", "a.go"], analyzer_of) == [None, "tsx", "python", None]


def test_paths(spark):
    assert column(spark, ["a/./b/../c", "../x", "a//b", "a/../../b"], normalise) == ["a/c", "../x", "a/b", "../b"]
    assert column(spark, ["a/b/c.py", "c.py"], ancestors) == [["", "a", "a/b"], [""]]
    assert column(spark, ["a/b/x", "z"], lambda c: shared_prefix(c, F.lit("a/b/c"))) == [2, 0]
    assert column(spark, ["repo|a", "ü"], lambda c: uuid5(CHUNK_NAMESPACE, c)) == [str(uuid.uuid5(uuid.UUID(CHUNK_NAMESPACE), x)) for x in ("repo|a", "ü")]


GOOD = ["https://github.com/a/b", "https://github.com/a/b.git", "https://www.github.com/A-b/c.d/", " https://github.com/a/b "]
BAD = ["", "http://github.com/a/b", "https://github.com/a", "https://github.com/a/b/c", "https://user:pw@github.com/a/b", "https://github.com:443/a/b", "https://github.com/a/b?x=1", "https://github.com/-a/b", "https://github.com/a/..", "git@github.com:a/b", "https://gitlab.com/a/b", "https://github.com/a b/c", "https://github.com/a/%2e"]


def test_urls(spark):
    got = column(spark, GOOD + BAD + [None], repository_url)
    assert [r["ok"] for r in got] == [True] * len(GOOD) + [False] * (len(BAD) + 1)
    assert got[2]["canonical_url"] == "https://github.com/a-b/c.d" and got[1]["name"] == "b"


@pytest.mark.parametrize("branch,ok", [("main", True), ("feature/x-1", True), ("v1.0", True), ("-x", False), ("a..b", False), ("a/.b", False), ("a.lock", False), ("a b", False), ("@", False), ("a@{1}", False), ("", False), ("x/", False), ("a;b", False)])
def test_branches(spark, branch, ok):
    assert column(spark, [branch], branch_ok) == [ok]


def test_other_checks(spark):
    assert column(spark, ["a/b", "/a", "a/../b", "", "a\\b", "x" * 1025, "./a"], relative_path_ok) == [True, False, False, False, False, False, False]
    assert column(spark, ["fatal: Remote branch x not found", "Repository not found", "Could not resolve host: x", "boom"], git_failure) == ["branch_not_found", "not_found", "network", "failed"]
