"""The symbol graph: bindings, exports and references resolved to symbols by joins.

A reference may resolve in several ways; all ways are joined at once, each with its
priority, and the first that holds wins. Inheritance and re-export chains are bounded
closures.

Inputs, all with repository_id and path: symbols(qualified_name, name, kind, parent,
is_exported, bases, start_line), imports(ord, names(name, alias), kind, resolved_path),
calls(callee, line, caller).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.catalog import first_distinct
from codelode.session import materialise

DEPTH = 4
_FILE = ["repository_id", "path"]


def bindings(imports: DataFrame) -> DataFrame:
    """(repository_id, path, local, target, imported): what local names stand for; the last binding of a name wins.

    imported is `*` for a whole module.
    """
    rows = imports.filter(F.col("resolved_path").isNotNull()).select(*_FILE, "ord", "kind", F.col("resolved_path").alias("target"), F.posexplode("names").alias("at", "n"))
    whole = (F.col("n.name") == "*") | ((F.col("kind") == "import") & F.col("path").rlike(r"\.pyi?$"))
    local = F.coalesce("n.alias", "n.name")
    named = rows.select(*_FILE, "ord", "at", "target", local.alias("local"), F.when(whole, "*").otherwise(F.col("n.name")).alias("imported")).filter("local <> '*'")
    return named.groupBy(*_FILE, "local").agg(F.max_by(F.struct("target", "imported"), F.struct("ord", "at")).alias("b")).select(*_FILE, "local", "b.target", "b.imported")


def top_level(symbols: DataFrame) -> DataFrame:
    """(repository_id, path, name, qualified_name, kind): the last top-level definition of each name."""
    last = symbols.filter(F.col("parent").isNull()).groupBy(*_FILE, "name").agg(F.max_by(F.struct("qualified_name", "kind", "is_exported"), "start_line").alias("s"))
    return last.select(*_FILE, "name", "s.*")


def exported(symbols: DataFrame, reexports: DataFrame | None = None) -> DataFrame:
    """(repository_id, path, name, source, qualified_name, kind): what each file offers by name.

    reexports: (repository_id, path, name, alias, target) with name `*` for everything but the
    default. Chains are followed DEPTH steps; the nearest wins, then the first by path.
    Script files offer exported symbols only, Python files all top-level ones.
    """
    own = top_level(symbols).filter(F.col("is_exported") | F.col("path").rlike(r"\.pyi?$")).select(*_FILE, "name", F.col("path").alias("source"), "qualified_name", "kind", F.lit(0).alias("steps"))
    if reexports is None:
        return own.drop("steps")
    reached = now = own
    for step in range(1, DEPTH + 1):
        far = now.select("repository_id", F.col("path").alias("target"), F.col("name").alias("inner"), "source", "qualified_name", "kind")
        passed = reexports.join(far, ["repository_id", "target"]).filter(((F.col("name") == "*") & (F.col("inner") != "default")) | (F.col("name") == F.col("inner")))
        now = passed.select(*_FILE, F.when(F.col("name") == "*", F.col("inner")).otherwise(F.coalesce("alias", "name")).alias("name"), "source", "qualified_name", "kind", F.lit(step).alias("steps")).distinct()
        reached = reached.unionByName(now)
    first = reached.groupBy(*_FILE, "name").agg(F.min_by(F.struct("source", "qualified_name", "kind"), F.struct("steps", "source", "qualified_name")).alias("s"))
    return first.select(*_FILE, "name", "s.*")


def _members(symbols: DataFrame) -> DataFrame:
    """(repository_id, source, owner, member, qualified_name, kind) of symbols below another."""
    rows = symbols.filter(F.col("parent").isNotNull()).groupBy("repository_id", F.col("path").alias("source"), F.col("parent").alias("owner"), F.col("name").alias("member"))
    return rows.agg(F.max_by(F.struct("qualified_name", "kind"), "start_line").alias("s")).select("repository_id", "source", "owner", "member", "s.*")


def inheritance(symbols: DataFrame, bound: DataFrame, offers: DataFrame) -> DataFrame:
    """(repository_id, path, qualified_name, base_path, base): classes with their resolved bases; generic parts are cut off."""
    plain = F.regexp_replace(F.col("b"), r"[\[<].*$", "")
    rows = symbols.filter(F.size("bases") > 0).select(*_FILE, "qualified_name", F.posexplode("bases").alias("ord", "b")).withColumn("b", plain)
    rows = rows.select(*_FILE, "qualified_name", "ord", F.substring_index("b", ".", 1).alias("root"), F.when(F.contains("b", F.lit(".")), F.substring_index("b", ".", -1)).alias("member"))
    classes = F.col("kind").isin("class", "component")
    local = top_level(symbols).filter(classes).select(*_FILE, F.col("name").alias("root"), F.col("path").alias("base_path"), F.col("qualified_name").alias("base"))
    here = rows.filter("member is null").join(local, [*_FILE, "root"]).select(*_FILE, "qualified_name", "ord", "base_path", "base", F.lit(0).alias("p"))
    through = rows.join(bound.withColumnRenamed("local", "root"), [*_FILE, "root"])
    wanted = through.select("*", F.when(F.col("imported") == "*", F.col("member")).when(F.col("member").isNull(), F.col("imported")).alias("want")).filter("want is not null")
    found = offers.filter(classes).select("repository_id", F.col("path").alias("target"), F.col("name").alias("want"), F.col("source").alias("base_path"), F.col("qualified_name").alias("base"))
    away = wanted.join(found, ["repository_id", "target", "want"]).select(*_FILE, "qualified_name", "ord", "base_path", "base", F.lit(1).alias("p"))
    best = here.unionByName(away).groupBy(*_FILE, "qualified_name", "ord").agg(F.min_by(F.struct("base_path", "base"), F.struct("p", "base_path", "base")).alias("s"))
    return best.select(*_FILE, "qualified_name", "ord", "s.*").filter((F.col("path") != F.col("base_path")) | (F.col("qualified_name") != F.col("base")))


def inherited_members(symbols: DataFrame, bases: DataFrame) -> DataFrame:
    """(repository_id, path, owner, member, source, qualified_name, steps): own members (0) and those of bases up to DEPTH."""
    own = _members(symbols)
    at = symbols.filter(F.col("kind").isin("class", "component")).select(*_FILE, F.col("qualified_name").alias("owner"), F.col("path").alias("source"), F.col("qualified_name").alias("up"), F.lit(0).alias("steps"), F.lit("").alias("way"))
    chain = [at]
    link = bases.select("repository_id", F.col("path").alias("source"), F.col("qualified_name").alias("up"), "ord", "base_path", "base")
    for step in range(1, DEPTH + 1):
        nxt = chain[-1].join(link, ["repository_id", "source", "up"])
        chain.append(nxt.select(*_FILE, "owner", F.col("base_path").alias("source"), F.col("base").alias("up"), F.lit(step).alias("steps"), F.concat("way", F.format_string("/%04d", "ord")).alias("way")))
    whole = reduce(lambda a, b: a.unionByName(b), chain)
    seen = whole.join(own.select("repository_id", "source", F.col("owner").alias("up"), "member", "qualified_name"), ["repository_id", "source", "up"])
    # depth first: the first base's own chain before the second base
    first = seen.groupBy(*_FILE, "owner", "member").agg(F.min_by(F.struct("source", "qualified_name", "steps"), F.struct("way", "steps")).alias("s"))
    return first.select(*_FILE, "owner", "member", "s.*")


def resolve_references(calls: DataFrame, symbols: DataFrame, imports: DataFrame, reexports: DataFrame | None = None) -> DataFrame:
    """(repository_id, path, caller, line, callee, target_path, target, strategy) of the calls that resolve.

    Calls outside any symbol are left out. `self`, `this` and `cls` take exactly one member.
    Strategies in order: self, self_inherited, same_file, import, namespace, member.
    """
    # each is joined in several ways below; written once, so that no plan holds them all
    bound, offers = materialise(bindings(imports), "graph-bound"), materialise(exported(symbols, reexports), "graph-offers")
    bases = materialise(inheritance(symbols, bound, offers), "graph-bases")
    members = materialise(inherited_members(symbols, bases), "graph-members")
    rows = calls.filter(F.col("caller").isNotNull()).withColumn("parts", F.split("callee", r"\."))
    rows = rows.select(*_FILE, "caller", "line", "callee", F.size("parts").alias("n"), F.element_at("parts", 1).alias("root"), F.try_element_at("parts", F.lit(2)).alias("member"))
    keys = [*_FILE, "caller", "line", "callee"]

    def way(df: DataFrame, priority: int, strategy, path: str = "source") -> DataFrame:
        s = strategy if not isinstance(strategy, str) else F.lit(strategy)
        return df.select(*keys, F.lit(priority).alias("p"), F.col(path).alias("target_path"), F.col("qualified_name").alias("target"), s.alias("strategy"))

    own = rows.filter((F.col("n") == 2) & F.col("root").isin("self", "this", "cls"))
    depth = F.size(F.split("caller", r"\."))
    up = own.withColumn("owner", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("caller", r"\."), F.lit(1), k), "."))))
    nearest = up.join(members, [*_FILE, "owner", "member"])
    nearest = nearest.groupBy(*keys).agg(F.max_by(F.struct("source", "qualified_name", "steps"), F.length("owner")).alias("s")).select(*keys, "s.*")
    ways = [way(nearest, 0, F.when(F.col("steps") == 0, "self").otherwise("self_inherited"))]
    plain = rows.filter(~F.col("root").isin("self", "this", "cls"))
    top = top_level(symbols).select(*_FILE, F.col("name").alias("root"), "qualified_name")
    ways.append(way(plain.filter("n = 1").join(top, [*_FILE, "root"]), 2, "same_file", "path"))
    through = plain.join(bound.withColumnRenamed("local", "root"), [*_FILE, "root"])
    offered = offers.select("repository_id", F.col("path").alias("target"), F.col("name").alias("want"), "source", "qualified_name")
    ways.append(way(through.filter("n = 1 and imported <> '*'").withColumn("want", F.col("imported")).join(offered, ["repository_id", "target", "want"]), 3, "import"))
    ways.append(way(through.filter("n = 2 and imported = '*'").withColumn("want", F.col("member")).join(offered, ["repository_id", "target", "want"]), 4, "namespace"))
    of_class = members.select("repository_id", F.col("path").alias("where"), "owner", "member", "source", "qualified_name")
    local = plain.filter("n = 2").join(top.withColumnRenamed("qualified_name", "owner"), [*_FILE, "root"]).withColumn("where", F.col("path"))
    ways.append(way(local.join(of_class, ["repository_id", "where", "owner", "member"]), 5, "member"))
    away = through.filter("n = 2 and imported <> '*'").withColumn("want", F.col("imported")).join(offered.select("repository_id", "target", "want", F.col("source").alias("where"), F.col("qualified_name").alias("owner")), ["repository_id", "target", "want"])
    ways.append(way(away.join(of_class, ["repository_id", "where", "owner", "member"]), 6, "member"))
    every = reduce(lambda a, b: a.unionByName(b), ways)
    return every.groupBy(*keys).agg(F.min_by(F.struct("target_path", "target", "strategy"), F.struct("p", "target_path", "target")).alias("s")).select(*keys, "s.*")


def symbol_edges(resolved: DataFrame, kind: str = "calls") -> DataFrame:
    """(kind, repository_id, source_path, source, target_path, target, weight, strategy, expressions, lines); edges to itself drop out."""
    rows = resolved.filter((F.col("path") != F.col("target_path")) | (F.col("caller") != F.col("target")))
    rows = rows.select("repository_id", F.col("path").alias("source_path"), F.col("caller").alias("source"), "target_path", "target", "strategy", "callee", "line")
    keys = ["repository_id", "source_path", "source", "target_path", "target"]
    whole = rows.groupBy(*keys).agg(F.count("*").alias("weight"), F.min_by("strategy", F.struct("line", "callee")).alias("strategy"))
    whole = whole.join(first_distinct(rows, keys, "callee", "line", 5, "expressions"), keys, "left").join(first_distinct(rows.withColumn("at", F.col("line")), keys, "line", "at", 10, "lines"), keys, "left")
    return whole.select(F.lit(kind).alias("kind"), *whole.columns)


def import_edges(imports: DataFrame) -> DataFrame:
    """(repository_id, source, target, weight, confidence, specifiers, lines) between files."""
    rows = imports.filter(F.col("resolved_path").isNotNull() & (F.col("path") != F.col("resolved_path")))
    rows = rows.select("repository_id", F.col("path").alias("source"), F.col("resolved_path").alias("target"), "ord", "confidence", "module", "line")
    keys = ["repository_id", "source", "target"]
    whole = rows.groupBy(*keys).agg(F.count("*").alias("weight"), F.when(F.bool_or(F.col("confidence") == "confirmed"), "confirmed").otherwise("inferred").alias("confidence"))
    return whole.join(first_distinct(rows, keys, "module", "ord", 10, "specifiers"), keys, "left").join(first_distinct(rows, keys, "line", "ord", 20, "lines"), keys, "left")


def inheritance_edges(symbols: DataFrame, imports: DataFrame, reexports: DataFrame | None = None) -> DataFrame:
    """Edges of kind `inherits` from a class to each base that is a class of the repository, see symbol_edges."""
    bases = inheritance(symbols, bindings(imports), exported(symbols, reexports))
    rows = bases.groupBy("repository_id", F.col("path").alias("source_path"), F.col("qualified_name").alias("source"), F.col("base_path").alias("target_path"), F.col("base").alias("target")).agg(F.count("*").alias("weight"))
    return rows.select(F.lit("inherits").alias("kind"), *rows.columns)


def code_graph(symbols: DataFrame, imports: DataFrame, calls: DataFrame, renders: DataFrame | None = None, reexports: DataFrame | None = None) -> DataFrame:
    """(type, repository_id, source_path, source, target_path, target, weight, confidence) of the whole graph.

    Types: imports between files (source and target null) as sure as the import's resolution;
    calls and renders between symbols and inherits between classes, all inferred, since what a
    name stands for at run time is not known. Calls outside any symbol and edges of a node to
    itself are left out. renders: rows like calls, the callee being the component.
    """
    imports, symbols = materialise(imports, "graph-imports"), materialise(symbols, "graph-symbols")
    between = import_edges(imports).select(F.lit("imports").alias("type"), "repository_id", F.col("source").alias("source_path"), F.lit(None).cast("string").alias("source"), F.col("target").alias("target_path"), F.lit(None).cast("string").alias("target"), "weight", "confidence")
    columns = ["repository_id", "source_path", "source", "target_path", "target", "weight", F.lit("inferred").alias("confidence")]
    parts = [between]
    for kind, rows in (("calls", calls), ("renders", renders)):
        if rows is not None:
            resolved = materialise(resolve_references(rows, symbols, imports, reexports), "graph-resolved")
            parts.append(symbol_edges(resolved, kind).select(F.col("kind").alias("type"), *columns))
    parts.append(inheritance_edges(symbols, imports, reexports).select(F.col("kind").alias("type"), *columns))
    return reduce(lambda a, b: a.unionByName(b), parts)


def symbol_calls(calls: DataFrame, most: int = 50) -> DataFrame:
    """(repository_id, path, caller, callees): the first distinct callees of each symbol in order of their lines."""
    return first_distinct(calls.filter(F.col("caller").isNotNull()), [*_FILE, "caller"], "callee", "line", most, "callees")
