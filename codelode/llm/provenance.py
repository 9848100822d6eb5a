"""Problem 6: hand-written files told from generated, minified, vendored ones and data tables.

Belief propagation over the directory tree of each repository. Nodes are files and
directories, labels the five of LABELS. A file's own evidence is what it shows itself: its
name, recorded sizes, language, symbols and chunks. What the folders above it are called is
evidence of the directory nodes only and reaches the file as a message, through
COMPATIBILITY between a node and the one above; what siblings show reaches it through their
common directory. On a tree two passes are exact: messages are gathered from the leaves to
the root, then beliefs handed down.

Upwards a level is one aggregation by parent, so no task holds a directory or a repository:
messages are five doubles, summed map-side, and a directory with a third of all files costs
no more than its rows. Downwards needs no rounds: a directory meets all directories above
it in one join (as many rows as its path is deep) and folds the messages along its path.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import materialise, once_by_id

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
_H, _G, _M, _V, _B = range(5)
#: P(label of the child | label of the directory above). Rows: directory.
COMPATIBILITY = (
    (0.960, 0.014, 0.008, 0.012, 0.006),
    (0.010, 0.960, 0.010, 0.010, 0.010),
    (0.250, 0.040, 0.690, 0.015, 0.005),
    (0.005, 0.010, 0.005, 0.975, 0.005),
    (0.300, 0.010, 0.010, 0.010, 0.670),
)
#: How much of a child's message its parent, and so its siblings, believe; children are not independent
#: witnesses, so together they weigh as much as WITNESSES of them at most.
SIBLING, WITNESSES = 0.25, 8
#: How a root is labelled before anything is seen.
ROOT_PRIOR = (0.97, 0.01, 0.005, 0.01, 0.005)

#: Directories of third-party copies, of build output and of generators. Fixed values.
VENDOR_DIRS = (
    "vendor _vendor third_party third-party thirdparty 3rdparty 3rd_party node_modules bower_components jspm_packages site-packages pods carthage "
    "godeps _workspace extern external externals deps jspm web_modules pnpm-store .yarn .pnpm virtualenv venv .venv dist-packages gems cpan contrib_libs"
).split()
BUILD_DIRS = "dist build _build out target .next .nuxt .output .svelte-kit .angular .parcel-cache .turbo .cache coverage lcov-report htmlcov __pycache__ .tox .eggs storybook-static obj _site public_build cmake-build-debug cmake-build-release derived_data".split()
GENERATED_DIRS = "generated __generated__ autogen auto_generated codegen gen-src generated-sources generated-src __snapshots__ .generated _generated".split()
#: File names that only tools write. Fixed values.
LOCK_FILE = r"(?i)^(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb?|poetry\.lock|uv\.lock|pdm\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|go\.work\.sum|mix\.lock|flake\.lock|packages\.lock\.json|podfile\.lock|pubspec\.lock|deno\.lock|conda-lock\.yml|gradle\.lockfile|cartfile\.resolved|package\.resolved|\.terraform\.lock\.hcl)$"
GENERATED_NAME = (
    r"(?i)(?:\.pb\.(?:go|ts|js|cc|h|rb|swift|dart)|\.pb\.gw\.go|_pb2?(?:_grpc)?\.(?:pyi?|js|ts|rb|d\.ts)|_grpc\.pb\.\w+|\.g\.(?:dart|cs|ts)|\.freezed\.dart|\.gr\.dart|\.mocks\.dart|[._-](?:generated|autogen|autogenerated|codegen)\.\w+|\.gen\.\w+|_gen\.go|"
    r"^zz_generated[._].*|\.designer\.(?:cs|vb)|\.g\.i\.cs|^moc_.*\.cpp|^ui_.*\.h|\.tab\.[ch]|\.yy\.[ch]|\.snap|\.(?:js|mjs|cjs|css|ts)\.map|\.tsbuildinfo|\.min\.map|^mock_.*_gen\.go|_string\.go|_mock_gen\.go|\.api\.json\.ts)$"
)
MINIFIED_NAME = r"(?i)(?:[.-]min|\.bundle|\.packed|\.compressed|\.pack|[.-][0-9a-f]{6,20}(?:\.chunk)?|\.chunk|^\d+\.chunk|[.-][0-9a-f]{6,20}\.bundle)\.(?:js|mjs|cjs|css)$"
#: A published release carries its version or its flavour in the name.
RELEASE_NAME = r"(?i)(?:[-_.]v?\d+[._]\d+(?:[._]\d+)?(?:[-_.](?:slim|full|core|lite|umd|esm|cjs|iife|prod|production|development|min|all))*|\.v\d+(?:\.(?:umd|esm|cjs|iife|slim|min))?|\.(?:umd|iife|production|slim|esm-browser))\.(?:js|mjs|cjs|css|ts)$"
GENERATED_MARK = (
    r"(?im)\A(?:[^\n]*\n){0,6}?[ \t]*(?://|#|/\*+|\*|--|<!--|;|%|\"\"\"|''')[^\n\"'`]{0,80}?(?:code generated (?:by|from)|@generated\b|<auto-?generated|auto-?generated (?:file|by|from|code|with|using)|(?:this|the) (?:file|code|module|class) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?generated|"
    r"generated (?:by|from|with|using) [^\n]{0,80}(?:do not|don't|protoc|compiler|codegen|generator)|do not (?:edit|modify|change)(?: this file)?(?: by hand| manually| directly)?[^\n]{0,30}(?:generated|$)|generated automatically)"
)
VENDORED_MARK = r"(?im)\A(?:[^\n]*\n){0,4}?[ \t]*(?:/\*!|/\*\*?|//!?|#)?[ \t*]*(?:@license\b|[\w. -]{2,40} v?\d+\.\d+(?:\.\d+)?[ ,|*-][^\n]{0,80}(?:licen[cs]e|MIT|BSD|Apache|\(c\)|copyright)|(?:vendored|copied|imported|bundled) from (?:https?://|[\w.-]+ v?\d))"
#: One of these stands in every text that the mark's pattern matches.
GENERATED_WORDS = ("generated", "do not", "don't")
VENDORED_WORDS = ("license", "licence", "mit", "bsd", "apache", "(c)", "copyright", "vendored from", "copied from", "imported from", "bundled from")
#: Lines in which a mark must stand.
HEAD_LINES = 7
#: Bytes from which a source file without symbols is long, and bytes a line from which its lines are a table's.
LONG_FILE, TABLE_WIDTH = 28_000, 48
_SOURCE = r"(?i)\.(?:py|pyi|js|mjs|cjs|jsx|ts|tsx|mts|cts|c|h|cc|cpp|hpp|cs|go|rs|java|kt|kts|scala|rb|php|swift|m|mm|lua|pl|r|dart|vue|svelte|sh|ex|exs|hs|clj|jl)$"
_SCRIPT = r"(?i)\.(?:js|mjs|cjs|css)$"


def normal_path(path: Column) -> Column:
    """A path without untidy separators and leading parts."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(?:^|(?<=/))(?:\./)+", ""), r"^/+", "")


def chunk_evidence(chunks: DataFrame) -> DataFrame:
    """(repository_id, path, marked, foreign, data, letters, wide): what the chunks of each file show.

    Marks count in the first lines of a chunk only, so only these meet the patterns.
    """
    text = F.coalesce("content", F.lit(""))
    head = F.substring_index(text, "\n", HEAD_LINES)
    low = F.lower(head)
    some = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    lines = 1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = chunks.select(
        "repository_id",
        normal_path(F.col("file_path")).alias("path"),
        (some(GENERATED_WORDS) & head.rlike(GENERATED_MARK)).alias("marked"),
        (some(VENDORED_WORDS) & head.rlike(VENDORED_MARK)).alias("foreign"),
        F.length(F.regexp_replace(text, r"\s+", "")).cast("long").alias("letters"),
        F.length(F.regexp_replace(text, r"[^0-9,]+", "")).cast("long").alias("digits"),
        F.when(F.length(text) > 0, F.length(text) / lines).alias("wide"),
    )
    return rows.groupBy("repository_id", "path").agg(
        F.max("marked").alias("marked"), F.max("foreign").alias("foreign"), (F.sum("digits") / F.greatest(F.sum("letters"), F.lit(1))).alias("data"), F.sum("letters").alias("letters"), F.max("wide").alias("wide")
    )


def _cases(path: Column) -> list[tuple[Column, tuple[float, ...]]]:
    """(what a file shows, its likelihood for each label), over the columns of file_evidence."""
    name = F.element_at(F.split(path, "/"), -1)
    size, lines = F.coalesce("size_bytes", F.lit(0)), F.greatest(F.coalesce("line_count", F.lit(1)), F.lit(1))
    per_line = size / lines
    source, script = path.rlike(_SOURCE), path.rlike(_SCRIPT)
    plain = ~(source | script)
    marked, foreign = F.coalesce("marked", F.lit(False)), F.coalesce("foreign", F.lit(False))
    numeric = F.coalesce((F.col("data") > 0.6) & (F.col("letters") > 120), F.lit(False))
    # a file of parsed language without symbols, or an unparsed one whose lines are filled as a table's
    silent = F.coalesce(F.col("symbols") == 0, per_line >= TABLE_WIDTH)
    made = name.rlike(GENERATED_NAME)
    return [
        (name.rlike(LOCK_FILE), (0.0005, 1.0, 0.001, 0.05, 0.001)),
        (made, (0.001, 1.0, 0.01, 0.05, 0.01)),
        (name.rlike(MINIFIED_NAME), (0.002, 0.05, 1.0, 0.2, 0.01)),
        (name.rlike(RELEASE_NAME) & script, (0.002, 0.01, 0.05, 1.0, 0.01)),
        (marked, (0.001, 1.0, 0.01, 0.05, 0.02)),
        (foreign & source, (0.02, 0.05, 0.1, 1.0, 0.02)),
        (script & (per_line > 400) & ~numeric, (0.001, 0.1, 1.0, 0.1, 0.05)),
        (script & (per_line <= 200), (1.0, 1.0, 0.02, 1.0, 1.0)),
        (source & numeric, (0.001, 0.05, 0.01, 0.05, 1.0)),
        (source & (per_line > 1000) & ~script, (0.001, 0.1, 0.2, 0.1, 1.0)),
        (source & ~numeric & silent & (size > LONG_FILE) & (per_line <= 1000) & F.col("letters").isNull(), (0.002, 0.1, 0.01, 0.1, 1.0)),
        (plain, (1.0, 0.4, 0.001, 0.6, 0.001)),
        (~plain & ~made & ~marked, (1.0, 0.2, 0.3, 0.4, 0.3)),
        (~plain & ~script, (1.0, 1.0, 0.02, 1.0, 1.0)),
    ]


def _logs(mask: str, likelihoods: list[tuple[float, ...]]) -> str:
    """SQL for the log likelihood of each label as one array: the cases whose bit is set multiply."""
    bit = [f"getbit({mask}, {k})" for k in range(len(likelihoods))]
    sums = ["+".join(["0D"] + [f"{b} * {math.log(p[label])!r}D" for b, p in zip(bit, likelihoods) if p[label] != 1.0]) for label in range(5)]
    return f"array({', '.join(sums)})"


def _mask(cases: list[Column]) -> Column:
    """One bit for each case; each condition is evaluated once."""
    return reduce(lambda a, b: a + b, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(cases)])


def file_evidence(files: DataFrame, code_files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, repository_id, dir, e) for every file once, e the log likelihood of each label."""
    base = once_by_id(files.select("id", "repository_id", "path", "size_bytes", "line_count")).withColumn("path", normal_path(F.coalesce("path", F.lit(""))))
    parsed = code_files.select("repository_id", normal_path(F.col("path")).alias("path"), "symbol_count").groupBy("repository_id", "path").agg(F.max("symbol_count").alias("symbols"))
    joined = base.join(parsed, ["repository_id", "path"], "left").join(chunk_evidence(chunks), ["repository_id", "path"], "left")
    cases = _cases(F.col("path"))
    masked = joined.select("id", F.coalesce("repository_id", F.lit("")).alias("repository_id"), _parent("path", "").alias("dir"), _mask([c for c, _ in cases]).alias("shown"))
    return materialise(masked, "p6-files").select("id", "repository_id", "dir", F.expr(_logs("shown", [p for _, p in cases])).alias("e"))


def _parent(path: str, top: str | None) -> Column:
    return F.when(F.contains(F.col(path), F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(top))


# Messages are arrays of five logarithms. The expressions are SQL texts, so that Python hands over one each.


def _exp(logs: str) -> str:
    """exp of an array, the largest being 1."""
    return f"transform({logs}, x -> exp(x - array_max({logs})))"


def _add(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> x + y)"


def _times(a: str, factor: str) -> str:
    return f"transform({a}, x -> x * {factor})"


def _mixed(shares: str, weight: Callable[[int, int], float]) -> str:
    """log of the sums of shares, each weighed by weight(label out, label in)."""
    return "array(" + ", ".join("ln(" + " + ".join(f"{weight(out, k)!r}D * {shares}[{k}]" for k in range(5)) + ")" for out in range(5)) + ")"


_PRIOR = "array(" + ", ".join(f"{math.log(p)!r}D" for p in ROOT_PRIOR) + ")"


def _upwards(df: DataFrame, logs: str, out: str) -> DataFrame:
    """Adds the message to the directory above: for each of its labels, over the labels here."""
    shares = df.withColumn("shares__", F.expr(_exp(logs)))
    return shares.withColumn(out, F.expr(_mixed("shares__", lambda p, k: COMPATIBILITY[p][k]))).drop("shares__")


def _downwards(above: str, sent: str) -> str:
    """The message from the directory above, without what came from here."""
    rest = f"zip_with({above}, {sent}, (x, y) -> x - y)"
    # transforms of one element give a name to what is computed once
    shares = f"transform(array({rest}), r -> {_exp('r')})"
    return f"transform({shares}, s -> {_mixed('s', lambda k, p: COMPATIBILITY[p][k])})[0]"


def _sum5(column: str) -> list[Column]:
    return [F.sum(F.col(column)[k]).alias(f"s{k}") for k in range(5)]


def _directories(files: DataFrame) -> DataFrame:
    """(repository_id, dir, level, parent, declared, own, s0..s4, n): every directory, what its name tells, its files' messages summed and counted."""
    sums = files.groupBy("repository_id", "dir").agg(*_sum5("u"), F.count("*").alias("n"))
    above = F.array_except(_steps("dir"), F.array("dir"))
    empty = sums.select("repository_id", F.explode(above).alias("dir")).distinct().select("*", *[F.lit(0.0).alias(f"s{k}") for k in range(5)], F.lit(0).cast("long").alias("n"))
    nodes = sums.unionByName(empty).groupBy("repository_id", "dir").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(5)], F.sum("n").alias("n"))
    name = F.lower(F.element_at(F.split("dir", "/"), -1))
    cases = [(name.isin(*VENDOR_DIRS), (1e-4, 1e-3, 1e-3, 1.0, 1e-3)), (name.isin(*BUILD_DIRS), (1e-4, 1.0, 0.01, 1e-3, 1e-3)), (name.isin(*GENERATED_DIRS), (1e-4, 1.0, 1e-3, 1e-3, 1e-3))]
    named = nodes.withColumn("shown", _mask([c for c, _ in cases]))
    return named.select("repository_id", "dir", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).alias("level"), _parent("dir", "").alias("parent"), (F.col("shown") != 0).alias("declared"), F.expr(_logs("shown", [p for _, p in cases])).alias("own"), *[f"s{k}" for k in range(5)], "n")


def _steps(path: str) -> Column:
    """A directory and all above it, from the root on."""
    parts = F.split(path, "/")
    down = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.col(path) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), down))


def _beliefs(told: DataFrame) -> DataFrame:
    """(repository_id, dir, weight, a): what each directory is believed to be once all is heard, from what gather gives.

    Along the path from the root a belief b becomes d + log(C' exp(b - v)) at each step, v
    being what the step itself had told the one above.
    """
    asked = told.select("repository_id", "dir", F.posexplode(_steps("dir")).alias("at", "step"))
    met = asked.join(told.select("repository_id", F.col("dir").alias("step"), "d", "u", "weight", "declared"), ["repository_id", "step"])
    paths = met.groupBy("repository_id", "dir").agg(F.array_sort(F.collect_list(F.struct("at", "d", "u", "weight", "declared"))).alias("path"))
    above = "slice(path, 1, size(path) - 1)"
    own = "transform(x.u, y -> if(x.declared, 0D, y * up.weight))"
    steps = f"zip_with(slice(path, 2, size(path)), {above}, (x, up) -> struct(x.d AS d, {own} AS v))"
    belief = f"aggregate({steps}, {_add('path[0].d', _PRIOR)}, (b, x) -> {_add('x.d', _downwards('b', 'x.v'))})"
    return paths.select("repository_id", "dir", F.expr("element_at(path, -1).weight AS weight"), F.expr(belief).alias("a"))


def gather(nodes: DataFrame) -> DataFrame:
    """(repository_id, dir, parent, declared, weight, d, u) of every directory.

    d: evidence of its own and of all below, u: its message to the one above, weight: what its children's messages count for.

    One aggregation a level, from the deepest up; each is written to the shared folder, so a
    lost executor costs one level at most.
    """
    deepest = nodes.agg(F.max("level")).first()[0]
    keys = ["repository_id", "dir"]
    done: list[DataFrame] = []
    for level in range(deepest, -1, -1):
        here = nodes.filter(F.col("level") == level).drop("level")
        if done:
            # a directory whose own name tells what it is says nothing about the one above
            sent = done[-1].filter(~F.col("declared")).groupBy("repository_id", F.col("parent").alias("dir")).agg(*_sum5("u"), F.count("*").alias("n"))
            both = here.join(sent.select(*keys, *[F.col(f"s{k}").alias(f"t{k}") for k in range(5)], F.col("n").alias("m")), keys, "left")
            here = both.select(*keys, "parent", "declared", "own", *[(F.col(f"s{k}") + F.coalesce(f"t{k}", F.lit(0.0))).alias(f"s{k}") for k in range(5)], (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        here = here.withColumn("weight", F.when(F.col("n") > 0, SIBLING * F.least(F.lit(1.0), WITNESSES / F.col("n"))).otherwise(0.0))
        heard = here.withColumn("d", F.expr(_add("own", _times("array(s0, s1, s2, s3, s4)", "weight"))))
        told = _upwards(heard, "d", "u").select(*keys, "parent", "declared", "weight", "d", "u")
        done.append(materialise(told, "p6-level"))
    return reduce(lambda a, b: a.unionByName(b), done)


def label_files(files: DataFrame, code_files: DataFrame, chunks: DataFrame, propagate: bool = True) -> DataFrame:
    """(id, label, doubt) of every file of repository_files, label one of LABELS, doubt 1 - P(handwritten).

    A file is called handwritten unless the other labels together are more likely.
    propagate=False leaves the messages out, so that each file is judged by what it shows itself.

    A file counts once however often delivered, and rows without an id each. Null paths are
    files of no name in the root; null sizes, lines and languages tell nothing; files that
    code_files or code_chunks don't know go without their evidence; repositories may be null.
    """
    evidence = file_evidence(files, code_files, chunks)
    if propagate:
        heard = _upwards(evidence, "e", "u")
        nodes = materialise(_directories(heard), "p6-dirs")
        if nodes.isEmpty():
            return evidence.select("id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("doubt"))
        met = heard.join(_beliefs(gather(nodes)), ["repository_id", "dir"])
        both = met.select("id", F.expr(_add("e", _downwards("a", _times("u", "weight")))).alias("b"))
    else:
        both = evidence.select("id", F.expr(_add("e", _PRIOR)).alias("b"))
    shares = both.select("id", F.expr(_exp("b")).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    foreign = F.slice("s", 2, 4)
    best = F.element_at(F.array(*map(F.lit, LABELS[1:])), F.array_position(foreign, F.array_max(foreign)).cast("int"))
    return shares.select("id", F.when(F.col("s")[0] * 2 >= total, LABELS[0]).otherwise(best).alias("label"), F.round(1.0 - F.col("s")[0] / total, 6).alias("doubt"))
