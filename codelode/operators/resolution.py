"""Imports resolved to files by joins on candidate paths.

Instead of probing a set path by path, each import becomes its candidate paths in order of
preference; one equality join with the files finds those that exist and the first wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.paths import ancestors, directory, normalise, shared_prefix
from codelode.session import materialise
from codelode.sources.corpus import parse_jsonc

#: In order of preference. Fixed values.
JS_EXTENSIONS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
PY_FORMS = (".py", "/__init__.py", ".pyi")


def _first_existing(wanted: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, repository_id, candidate, ord), the existing candidate of lowest ord."""
    known = files.select("repository_id", F.col("path").alias("candidate")).distinct()
    return wanted.join(known, ["repository_id", "candidate"]).groupBy(*keys).agg(F.min_by("candidate", "ord").alias("resolved_path"))


def _up(path: Column, level: Column) -> Column:
    """The directory `level` steps above a file; null above the root."""
    parts = F.split(path, "/")
    depth = F.size(parts) - level
    return F.when(depth >= 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(depth, F.lit(0))), "/"))


def resolve_python_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, ord, target, resolved_path): the base package and every imported name that is a module."""
    base = _up(F.col("path"), F.col("level"))
    module = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    root = F.when(module == "", base).otherwise(F.when(base == "", module).otherwise(F.concat(base, F.lit("/"), module)))
    rows = imports.filter(F.col("level") > 0).withColumn("root", root).filter(F.col("root").isNotNull())
    names = F.transform("names", lambda n: F.struct(n["name"].alias("target"), F.concat(F.when(F.col("root") == "", "").otherwise(F.concat(F.col("root"), F.lit("/"))), n["name"]).alias("stem")))
    targets = F.concat(F.array(F.struct(F.lit("").alias("target"), F.col("root").alias("stem"))), names)
    spread = rows.select("repository_id", "path", "ord", F.inline(targets))
    forms = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("form")) for k, f in enumerate(PY_FORMS)])
    wanted = spread.select("*", F.inline(forms)).select("repository_id", "path", F.col("ord").alias("at"), "target", F.col("k").alias("ord"), F.when(F.col("stem") == "", F.ltrim(F.col("form"), F.lit("/"))).otherwise(F.concat("stem", "form")).alias("candidate"))
    return _first_existing(wanted, files, ["repository_id", "path", "at", "target"]).withColumnRenamed("at", "ord")


def python_modules(files: DataFrame) -> DataFrame:
    """(repository_id, module, path): every dotted name a Python file can be imported by.

    A suffix of the path counts where the directory before it is the root or no package.
    """
    py = files.filter(F.col("path").rlike(r"\.pyi?$")).select("repository_id", "path").distinct()
    stem = F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), r"(?:^|/)__init__$", "")
    parts = F.filter(F.split(stem, "/"), lambda p: p != "")
    rows = py.withColumn("parts", parts).filter((F.size("parts") > 0) & F.forall("parts", lambda p: p.rlike(r"^[A-Za-z_]\w*$")))
    spread = rows.select("repository_id", "path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("from"))
    named = spread.select("repository_id", "path", F.array_join(F.slice("parts", F.col("from"), F.size("parts")), ".").alias("module"), F.array_join(F.slice("parts", F.lit(1), F.col("from") - 1), "/").alias("above"))
    packages = py.filter(F.endswith("path", F.lit("__init__.py"))).select("repository_id", directory(F.col("path")).alias("above")).filter("above <> ''")
    return named.join(packages, ["repository_id", "above"], "left_anti").select("repository_id", "module", "path")


def resolve_python_absolute(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, ord, module, status, confidence, resolved_path, package, candidates).

    One file: confirmed. Several: inferred, the one sharing most leading directories, then the
    shortest, then the first by name. None: external, the package being the first part.
    """
    rows = imports.filter(F.col("level") == 0).select("repository_id", "path", "ord", "module")
    known = python_modules(files).select("repository_id", "module", F.col("path").alias("found"))
    best = F.struct(shared_prefix(directory(F.col("path")), F.col("found")).alias("s"), (-F.length("found")).alias("l"))
    hit = rows.join(known, ["repository_id", "module"]).withColumn("best", best)
    ranked = hit.groupBy("repository_id", "path", "ord", "module").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("found")).alias("candidates"), F.min_by("found", F.struct(-F.col("best.s"), -F.col("best.l"), F.col("found"))).alias("resolved_path"))
    out = rows.join(ranked, ["repository_id", "path", "ord", "module"], "left")
    return out.select(
        "repository_id", "path", "ord", "module",
        F.when(F.col("n").isNull(), "external").otherwise("resolved").alias("status"),
        F.when(F.col("n") == 1, "confirmed").when(F.col("n") > 1, "inferred").alias("confidence"),
        "resolved_path",
        F.when(F.col("n").isNull(), F.substring_index("module", ".", 1)).alias("package"),
        F.when(F.col("n") > 1, F.col("candidates")).alias("candidates"),
    )


def python_submodules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, ord, name, alias, resolved_path) of the names of absolute `from` imports that are modules themselves.

    `from pkg import part` means pkg/part.py where there is such a module; several files of one
    module name are told apart as for the package itself.
    """
    named = imports.filter((F.col("level") == 0) & (F.col("kind") == "from")).select("repository_id", "path", "ord", "module", F.posexplode("names").alias("at", "n"))
    asked = named.filter("n.name <> '*'").select("repository_id", "path", (F.col("ord") * 10000 + F.col("at")).alias("ord"), F.concat_ws(".", "module", "n.name").alias("module"), F.lit(0).alias("level"), F.col("ord").alias("of"), "n.name", "n.alias")
    found = resolve_python_absolute(asked, files).filter("resolved_path is not null").select("repository_id", "path", "ord", "resolved_path")
    return asked.join(found, ["repository_id", "path", "ord"]).select("repository_id", "path", F.col("of").alias("ord"), "name", "alias", "resolved_path")


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The import rows with status, confidence, package and resolved_path, and a row for each imported name that is a module.

    Relative imports that meet a file are confirmed, others unresolved. Rows of names come as plain
    imports of the whole module, as which the graph binds them.
    """
    keys = ["repository_id", "path", "ord"]
    imports = materialise(imports, "imports")
    absolute = resolve_python_absolute(imports, files).select(*keys, "status", "confidence", "package", "resolved_path")
    near = resolve_python_relative(imports, files)
    whole = near.filter("target = ''").select(*keys, "resolved_path")
    beside = imports.filter("level > 0").select(*keys).join(whole, keys, "left")
    beside = beside.select(*keys, F.when(F.col("resolved_path").isNull(), "unresolved").otherwise("resolved").alias("status"), F.when(F.col("resolved_path").isNotNull(), "confirmed").alias("confidence"), F.lit(None).cast("string").alias("package"), "resolved_path")
    rows = imports.join(absolute.unionByName(beside), keys, "left")
    parts = near.filter("target <> ''").select(*keys, F.col("target").alias("name"), F.col("resolved_path").alias("part"))
    alias = imports.select(*keys, F.inline("names"))
    relative_parts = parts.join(alias, [*keys, "name"]).select(*keys, "name", "alias", "part")
    every = python_submodules(imports, files).withColumnRenamed("resolved_path", "part").unionByName(relative_parts)
    modules = imports.drop("names", "kind").join(every, keys)
    named = modules.withColumn("names", F.array(F.struct("name", "alias"))).withColumn("kind", F.lit("import")).withColumn("status", F.lit("resolved")).withColumn("confidence", F.lit("confirmed"))
    named = named.withColumn("package", F.lit(None).cast("string")).withColumn("resolved_path", F.col("part")).select(*rows.columns)
    return rows.unionByName(named)


def _script_forms(target: Column) -> Column:
    """The files a script import may mean, in order: as written, with each extension, without its script extension, a directory's index."""
    bare = F.regexp_replace(target, r"\.[mc]?jsx?$", "")
    forms = [target] + [F.concat(target, F.lit(e)) for e in JS_EXTENSIONS] + [F.when(bare != target, F.concat(bare, F.lit(e))) for e in JS_EXTENSIONS] + [F.concat(target, F.lit("/index" + e)) for e in JS_EXTENSIONS]
    return F.array(*forms)


def resolve_js_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, ord, module, status, resolved_path) of `./` and `../` imports, see _script_forms."""
    rows = imports.filter(F.col("module").rlike(r"^\.{1,2}(?:/|$)"))
    joined = F.concat_ws("/", F.when(directory(F.col("path")) != "", directory(F.col("path"))), F.col("module"))
    rows = rows.select("repository_id", "path", "ord", "module", normalise(joined).alias("target"))
    wanted = rows.filter(~F.col("target").startswith("..")).select("repository_id", "path", F.col("ord").alias("at"), "module", F.posexplode(_script_forms(F.col("target"))).alias("ord", "candidate")).filter(F.col("candidate").isNotNull())
    found = _first_existing(wanted, files, ["repository_id", "path", "at", "module"]).withColumnRenamed("at", "ord")
    return rows.drop("target").join(found, ["repository_id", "path", "ord", "module"], "left").withColumn("status", F.when(F.col("resolved_path").isNull(), "unresolved").otherwise("resolved"))


#: How often a configuration may extend another one. A fixed value.
MOST_EXTENDS = 5
_CONFIG = "repository_id string, config string, parent string, base_url string, paths array<struct<pattern:string,targets:array<string>>>"


def _read_configs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, path, text in zip(batch["repository_id"], batch["path"], batch["content"]):
            data = parse_jsonc(text)
            if not isinstance(data, dict):
                continue
            options = data.get("compilerOptions")
            options = options if isinstance(options, dict) else {}
            extends, base, paths = data.get("extends"), options.get("baseUrl"), options.get("paths")
            parent = extends if isinstance(extends, str) and extends.startswith(".") else None
            listed = [{"pattern": p, "targets": [t for t in ts if isinstance(t, str)]} for p, ts in paths.items() if isinstance(ts, list)] if isinstance(paths, dict) else None
            rows.append((repo, path, parent, base if isinstance(base, str) else None, listed))
        yield pd.DataFrame(rows, columns=["repository_id", "config", "parent", "base_url", "paths"])


def script_configs(configs: DataFrame) -> DataFrame:
    """(repository_id, config, base, paths): what each of (repository_id, path, content) configurations means once it extends its parents.

    base: the directory that bare names start from, null where none is named; own values go
    before those of the parent; paths make the own directory the base where no other is known.
    Parents count that exist and are named relatively, MOST_EXTENDS deep; circles and
    unreadable files end the chain.
    """
    read = configs.select("repository_id", "path", "content").mapInPandas(_read_configs, _CONFIG)
    here = directory(F.col("config"))
    under = lambda p: F.when(here == "", p).otherwise(F.concat(here, F.lit("/"), p))
    parent = normalise(under(F.col("parent")))
    parent = F.when(parent.endswith(".json"), parent).otherwise(F.concat(parent, F.lit(".json")))
    own = read.select("repository_id", "config", parent.alias("parent"), normalise(under(F.col("base_url"))).alias("own_base"), F.col("paths").alias("own_paths"))
    own = materialise(own, "configs")
    told = own.select("repository_id", "config", F.coalesce("own_base", F.when(F.col("own_paths").isNotNull(), here)).alias("base"), F.col("own_paths").alias("paths"))
    for _ in range(MOST_EXTENDS):
        above = told.select("repository_id", F.col("config").alias("parent"), F.col("base").alias("up_base"), F.col("paths").alias("up_paths"))
        met = own.join(above, ["repository_id", "parent"], "left")
        told = materialise(met.select("repository_id", "config", F.coalesce("own_base", "up_base", F.when(F.col("own_paths").isNotNull(), here)).alias("base"), F.coalesce("own_paths", "up_paths").alias("paths")), "configs")
    return told


def pattern_match(pattern: Column, name: Column) -> Column:
    """What the one `*` of a path pattern stands for in a name, '' for a pattern without, null where it doesn't match."""
    head = F.substring_index(pattern, "*", 1)
    star = F.contains(pattern, F.lit("*"))
    tail = F.substring(pattern, F.length(head) + 2, F.length(pattern))
    fits = name.startswith(head) & name.endswith(tail) & (F.length(name) >= F.length(head) + F.length(tail))
    middle = F.substring(name, F.length(head) + 1, F.length(name) - F.length(head) - F.length(tail))
    return F.when(star & fits, middle).when(~star & (pattern == name), F.lit(""))


def resolve_js_bare(imports: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """(repository_id, path, ord, module, status, resolved_path, package) of imports that don't start with a dot.

    The nearest configuration's path patterns in their order, then its base directory; what meets
    no file is external, a package of that name. Absolute paths and protocols are external.
    """
    keys = ["repository_id", "path", "ord", "module"]
    rows = imports.filter(~F.col("module").rlike(r"^\.{1,2}(?:/|$)")).select(*keys)
    plain = rows.filter(~F.col("module").rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]*:)"))
    near = nearest_config(plain.select("repository_id", "path").distinct(), configs)
    told = plain.join(near, ["repository_id", "path"]).join(script_configs(configs), ["repository_id", "config"])
    root = F.coalesce("base", directory(F.col("config")))
    under = lambda p: F.when(root.isin("", "."), p).otherwise(F.concat(root, F.lit("/"), p))
    by_pattern = told.select(*keys, root.alias("root"), "config", "base", F.posexplode("paths").alias("k", "p")).withColumn("star", pattern_match(F.col("p.pattern"), F.col("module"))).filter("star is not null")
    by_pattern = by_pattern.select(*keys, "base", "config", "k", "star", F.posexplode("p.targets").alias("j", "t"))
    starred = F.concat(F.substring_index("t", "*", 1), F.when(F.contains("t", F.lit("*")), F.concat(F.col("star"), F.substring(F.col("t"), F.length(F.substring_index("t", "*", 1)) + 2, F.length("t")))).otherwise(""))
    wanted = by_pattern.select(*keys, F.struct(F.col("k").alias("k"), F.col("j").alias("j")).alias("way"), normalise(under(starred)).alias("target"))
    based = told.filter("base is not null").select(*keys, F.struct(F.lit(1 << 30).alias("k"), F.lit(0).alias("j")).alias("way"), normalise(under(F.col("module"))).alias("target"))
    forms = wanted.unionByName(based).select(*[F.col(k).alias("at") if k == "ord" else F.col(k) for k in keys], "way", F.posexplode(_script_forms(F.col("target"))).alias("form", "candidate")).filter("candidate is not null")
    found = _first_existing(forms.withColumn("ord", F.struct("way", "form")), files, ["repository_id", "path", "at", "module"]).withColumnRenamed("at", "ord")
    out = rows.join(found, keys, "left")
    return out.select(*keys, F.when(F.col("resolved_path").isNull(), "external").otherwise("resolved").alias("status"), "resolved_path", F.when(F.col("resolved_path").isNull(), js_package(F.col("module"))).alias("package"))


def js_package(module: Column) -> Column:
    """The package a bare import names: `@scope/name` or the first segment."""
    return F.when(module.startswith("@"), F.substring_index(module, "/", 2)).otherwise(F.substring_index(module, "/", 1))


def nearest_config(importers: DataFrame, configs: DataFrame) -> DataFrame:
    """(repository_id, path, config): the configuration file in the closest directory above, tsconfig before jsconfig."""
    up = importers.select("repository_id", "path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    have = configs.select("repository_id", directory(F.col("path")).alias("dir"), F.col("path").alias("config"))
    best = F.struct("depth", F.col("config").endswith("tsconfig.json"))
    return up.join(have, ["repository_id", "dir"]).groupBy("repository_id", "path").agg(F.max_by("config", best).alias("config"))


def closure(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(source, target, steps): what is reached over at most `depth` edges, by the fewest steps."""
    step = edges.select("source", "target").distinct()
    reached = now = step.withColumn("steps", F.lit(1))
    for n in range(2, depth + 1):
        now = now.select("source", F.col("target").alias("mid")).join(step.select(F.col("source").alias("mid"), "target"), "mid").select("source", "target").distinct().withColumn("steps", F.lit(n))
        reached = reached.unionByName(now)
    return reached.filter("source <> target").groupBy("source", "target").agg(F.min("steps").alias("steps"))
