"""Catalog queries over repositories, files, symbols, jobs and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.languages import LICENSE_PREFIXES, MANIFESTS, NON_PROGRAMMING, README_PREFIXES
from codelode.functions.paths import ancestors
from codelode.functions.text import contains_ci
from codelode.session import once_by_id


def page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in a total order. Limits run from 1 to 20000."""
    if not 1 <= limit <= 20000 or offset < 0:
        raise ValueError("limit not in 1..20000 or offset below 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def envelope(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> dict:
    """{items, total, limit, offset}."""
    return {"items": page(df, order, limit, offset), "total": df.count(), "limit": limit, "offset": offset}


def newest_first(df: DataFrame) -> list[Column]:
    return [F.desc("created_at"), F.col("id")]


def find_symbols(symbols: DataFrame, files: DataFrame, query: str | None = None, kind: str | None = None, prefix: str | None = None, exported: bool | None = None) -> DataFrame:
    """Symbols with their file's path, filtered; see symbol_order."""
    s = once_by_id(symbols)
    if query:
        s = s.filter(contains_ci(F.col("name"), query) | contains_ci(F.col("qualified_name"), query))
    if kind:
        s = s.filter(F.lower(F.trim("kind")) == kind)
    if exported:
        s = s.filter("is_exported")
    paths = once_by_id(files).select(F.col("id").alias("file_id"), "path")
    if prefix:
        paths = paths.filter(F.startswith("path", F.lit(prefix)))
    return s.join(paths, "file_id")


def symbol_order(query: str) -> list[Column]:
    """Exact name first, then the shorter name, name, path, line."""
    return [(F.lower("name") != query.lower()).asc(), F.length("name").asc(), F.col("name"), F.col("path"), F.col("start_line")]


def file_list(repository_files: DataFrame, code_files: DataFrame, analyzed: bool = False, prefix: str | None = None) -> DataFrame:
    """Every indexed file with what the parser found in it."""
    f, c = once_by_id(repository_files), once_by_id(code_files)
    if prefix:
        f = f.filter(F.startswith("path", F.lit(prefix)))
    c = c.select("repository_id", "path", F.col("id").alias("code_id"), "parse_status", "symbol_count", "import_count")
    out = f.join(c, ["repository_id", "path"], "inner" if analyzed else "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return out.select("id", "repository_id", "path", "language", "size_bytes", "line_count", "parse_status", zero("symbol_count"), zero("import_count"), F.col("code_id").isNotNull().alias("analyzed"))


def not_analyzed(repository_files: DataFrame, code_files: DataFrame) -> DataFrame:
    return once_by_id(repository_files).join(code_files.select("repository_id", "path"), ["repository_id", "path"], "left_anti")


def language_stats(files: DataFrame, *keys: str) -> DataFrame:
    """Files and bytes by language."""
    return once_by_id(files).filter(F.col("language").isNotNull()).groupBy(*keys, "language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def primary_language(files: DataFrame) -> DataFrame:
    """(repository_id, language): most bytes among programming languages, else among all; ties to the later name."""
    stats = language_stats(files, "repository_id")
    order = F.struct((~F.col("language").isin(*NON_PROGRAMMING)).alias("p"), "bytes", "language")
    return stats.groupBy("repository_id").agg(F.max_by("language", order).alias("language"))


def language_share(files: DataFrame, keep: int = 4) -> DataFrame:
    """Share of bytes of the first languages, the rest as Other (n), by repository."""
    stats = language_stats(files, "repository_id")
    w = Window.partitionBy("repository_id")
    ranked = stats.withColumn("r", F.row_number().over(w.orderBy(F.desc("bytes"), "language"))).withColumn("k", F.count("*").over(w)).withColumn("whole", F.sum("bytes").over(w))
    rest = (F.col("r") > keep) & (F.col("k") > keep + 1)
    name = F.when(rest, F.format_string("Other (%d)", F.col("k") - keep)).otherwise(F.col("language"))
    return ranked.groupBy("repository_id", name.alias("label")).agg(F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / F.max("whole"), 6).alias("share"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job of each repository."""
    w = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("id"))
    return once_by_id(jobs).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def active_jobs(jobs: DataFrame) -> DataFrame:
    return once_by_id(jobs).filter(F.col("status").isin("queued", "running"))


def several_active(jobs: DataFrame) -> DataFrame:
    """(repository_id, active): repositories with more than one active job."""
    return active_jobs(jobs).groupBy("repository_id").agg(F.count("*").alias("active")).filter("active > 1")


def outline(symbols: DataFrame) -> DataFrame:
    """(id, qualified_name, parent_name, children): each symbol with its parent and the names below it, by line."""
    s = once_by_id(symbols)
    nested = s.filter(F.col("parent_symbol_id").isNotNull())  # top-level symbols need not meet the parents
    up = s.select(F.col("id").alias("parent_symbol_id"), F.col("qualified_name").alias("parent_name"))
    down = nested.groupBy(F.col("parent_symbol_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]).alias("children"))
    named = nested.join(up, "parent_symbol_id", "left").select("id", "qualified_name", "parent_name")
    top = s.filter(F.col("parent_symbol_id").isNull()).select("id", "qualified_name", F.lit(None).cast("string").alias("parent_name"))
    return named.unionByName(top).join(down, "id", "left").select("id", "qualified_name", "parent_name", "children")


def directory_rollup(files: DataFrame) -> DataFrame:
    """(repository_id, dir, files, bytes) of every directory, what lies deeper included."""
    f = once_by_id(files)
    return f.select("repository_id", F.explode(ancestors(F.col("path"))).alias("dir"), "size_bytes").groupBy("repository_id", "dir").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def edges_of(edges: DataFrame, node: Column, direction: str = "both") -> DataFrame:
    """Edges leaving or reaching a node, with the neighbour; `both` as a union of two equality filters."""
    out = edges.filter(F.col("source") == node).withColumn("direction", F.lit("outgoing")).withColumn("neighbour", F.col("target"))
    back = edges.filter(F.col("target") == node).withColumn("direction", F.lit("incoming")).withColumn("neighbour", F.col("source"))
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back)


def first_distinct(rows: DataFrame, keys: list[str], value: str, order: str, n: int, out: str) -> DataFrame:
    """(keys, out): the first n distinct values of each group in the order of `order`.

    Each value's first place is found by an aggregate and only n of a group are gathered, so no
    list grows with its group.
    """
    firsts = rows.groupBy(*keys, value).agg(F.min(order).alias("at__"))
    ranked = firsts.withColumn("r__", F.row_number().over(Window.partitionBy(*keys).orderBy("at__", value))).filter(F.col("r__") <= n)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r__", value))), lambda x: x[value]).alias(out))


def aggregate_edges(rows: DataFrame, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Import or call rows (keys, ord, confidence, strategy, line) as edges.

    weight counts the rows, one confirmed row confirms the edge, strategies and lines are the
    first distinct ones (10 each); edges from a node to itself drop out.
    """
    rows = rows.filter(F.col(keys[0]) != F.col(keys[1]))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("weight"), F.when(F.bool_or(F.col("confidence") == "confirmed"), "confirmed").otherwise("inferred").alias("confidence"))
    for value, out in (("strategy", "strategies"), ("line", "lines")):
        whole = whole.join(first_distinct(rows, list(keys), value, "ord", 10, out), list(keys), "left")
    return whole


def symbol_summary(symbols: DataFrame) -> DataFrame:
    """(repository_id, one column for each kind): symbols by kind with zeros."""
    kinds = ["function", "method", "class", "component", "interface", "type_alias", "enum", "variable"]
    s = once_by_id(symbols).withColumn("k", F.lower(F.trim("kind")))
    return s.groupBy("repository_id").agg(*[F.count_if(F.col("k") == k).alias(k) for k in kinds])


def skipped(files: DataFrame, max_bytes: int = 1 << 20, max_path: int = 1024) -> DataFrame:
    """(reason, files) of the files an index leaves out."""
    reason = F.when(F.length("path") > max_path, "path_too_long").when(F.col("size_bytes") > max_bytes, "too_large").when(F.col("size_bytes").isNull(), "unreadable")
    return once_by_id(files).withColumn("reason", reason).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("files"))


def stale_index(manifest: dict | None, commit: str | None, model: str | None = None) -> str | None:
    """The refusal an index earns, None where it may be used."""
    if not manifest:
        return "index_not_built"
    if manifest.get("commit_sha") != commit:
        return "index_out_of_date"
    if model is not None and manifest.get("model_id") != model:
        return "dense_index_unavailable"
    return None


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is among the ids of a one-column table; ids without a row give none."""
    return once_by_id(df, key).join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def missing_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The ids that no row has."""
    return ids.select(F.col(ids.columns[0]).alias(key)).distinct().join(df.select(key), key, "left_anti")


def file_totals(files: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """(repository_id, total_files, total_size_bytes, indexed_files); indexed are the files within the size limit."""
    f = once_by_id(files)
    return f.groupBy("repository_id").agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"), F.count_if(F.col("size_bytes") <= max_bytes).alias("indexed_files"))


def directory_size(files: DataFrame, prefix: str = "") -> int:
    """Bytes of all files below a directory."""
    below = files if not prefix else files.filter(F.startswith("path", F.lit(prefix.rstrip("/") + "/")))
    return below.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]


def notable_files(files: DataFrame, most: int = 50) -> DataFrame:
    """(repository_id, manifests, readme, license): manifests at any depth, the first top-level read-me and licence.

    Paths come in their order; `most` manifests are listed. Repositories with none of them have a row of nulls.
    """
    f = once_by_id(files).select("repository_id", "path")
    name = F.element_at(F.split("path", "/"), -1)
    top, low = ~F.contains("path", F.lit("/")), F.lower(name)
    begins = lambda prefixes: reduce(lambda a, b: a | b, [low.startswith(x) for x in prefixes])
    first = lambda when: F.min(F.when(when, F.col("path")))
    whole = f.groupBy("repository_id").agg(first(top & begins(README_PREFIXES)).alias("readme"), first(top & begins(LICENSE_PREFIXES)).alias("license"))
    listed = first_distinct(f.filter(name.isin(*MANIFESTS)).withColumn("ord", F.col("path")), ["repository_id"], "path", "ord", most, "manifests")
    return whole.join(listed, "repository_id", "left").select("repository_id", "manifests", "readme", "license")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(facet, value, chunks): chunks by type and by language."""
    c = once_by_id(chunks)
    sets = c.select(F.explode(F.array(F.struct(F.lit("chunk_type").alias("facet"), F.col("chunk_type").alias("value")), F.struct(F.lit("language").alias("facet"), F.col("language").alias("value")))).alias("x"))
    return sets.select("x.*").groupBy("facet", "value").agg(F.count("*").alias("chunks"))


def edge_page(edges: DataFrame, files: DataFrame, symbols: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of edges by type, weight descending and id, with the paths and names of both ends; an unknown path is `?`."""
    one = page(edges, [F.col("relationship_type"), F.desc("weight"), F.col("id")], limit, offset)
    for end in ("source", "target"):
        path = once_by_id(files).select(F.col("id").alias(f"{end}_file_id"), F.col("path").alias(f"{end}_path"))
        name = once_by_id(symbols).select(F.col("id").alias(f"{end}_symbol_id"), F.col("qualified_name").alias(f"{end}_symbol"))
        one = one.join(path, f"{end}_file_id", "left").join(name, f"{end}_symbol_id", "left").withColumn(f"{end}_path", F.coalesce(f"{end}_path", F.lit("?")))
    return one


def symbols_of_file(symbols: DataFrame, file_id: str) -> DataFrame:
    """A file's symbols by first line, the longer one first."""
    return once_by_id(symbols).filter(F.col("file_id") == file_id).orderBy("start_line", F.desc("end_line"), "id")


def imports_of_file(imports: DataFrame, file_id: str) -> DataFrame:
    """A file's imports by line and module."""
    return imports.filter(F.col("file_id") == file_id).orderBy("start_line", "module")


def symbol_ranks(symbols: DataFrame) -> DataFrame:
    """(id, place): the place of each symbol in its file, see symbols_of_file."""
    w = Window.partitionBy("file_id").orderBy("start_line", F.desc("end_line"), "id")
    return once_by_id(symbols).select("id", F.row_number().over(w).alias("place"))


def neighbours(edges: DataFrame, node: Column, shown: int = 12) -> DataFrame:
    """(direction, neighbour, more): all neighbours where at most `shown`, else the first ones and one row that counts the rest."""
    rows = edges_of(edges, node).select("direction", "neighbour", "weight")
    w = Window.partitionBy("direction")
    ranked = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc("weight"), "neighbour"))).withColumn("n", F.count("*").over(w))
    keep = (F.col("n") <= shown) | (F.col("r") < shown)
    first = ranked.filter(keep).select("direction", F.col("neighbour").cast("string").alias("neighbour"), F.lit(None).cast("long").alias("more"))
    rest = ranked.filter(~keep).groupBy("direction").agg(F.count("*").alias("more")).select("direction", F.lit(None).cast("string").alias("neighbour"), "more")
    return first.unionByName(rest)


def dashboard(repositories: DataFrame) -> DataFrame:
    """(projects, repositories, completed) in one row."""
    r = once_by_id(repositories)
    return r.agg(F.count_distinct("project_id").alias("projects"), F.count("*").alias("repositories"), F.count_if(F.col("status") == "completed").alias("completed"))


def repository_labels(repositories: DataFrame) -> DataFrame:
    """(id, full_name, short_sha, commit_url): owner/name, seven digits of the commit, its address on the code host."""
    hosted = F.col("source_type") == "github"
    return once_by_id(repositories).select(
        "id",
        F.when(F.coalesce("owner", F.lit("")) != "", F.concat_ws("/", "owner", "name")).otherwise(F.col("name")).alias("full_name"),
        F.substring("commit_sha", 1, 7).alias("short_sha"),
        F.when(hosted & F.col("commit_sha").isNotNull(), F.concat("url", F.lit("/commit/"), "commit_sha")).alias("commit_url"),
    )


def compact(df: DataFrame, columns: list[str]) -> Column:
    """JSON of some columns without those that are null, false, empty or 0."""
    kinds = dict(df.dtypes)
    empty = {"boolean": lambda c: ~c, "string": lambda c: c == ""}
    kept = []
    for c in columns:
        kind, col = kinds[c], F.col(c)
        none = F.size(col) == 0 if kind.startswith(("array", "map")) else empty[kind](col) if kind in empty else col == 0 if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") else F.lit(False)
        kept.append(F.when(~none, col).alias(c))
    return F.to_json(F.struct(*kept))


def get_or_create(have: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """`have` with those rows of `wanted` whose key it lacks; doing it again adds nothing."""
    return have.unionByName(wanted.dropDuplicates([key]).join(have.select(key), key, "left_anti").select(*have.columns))


def backfill(repositories: DataFrame) -> DataFrame:
    """Rows of an earlier layout brought up to date: a branch where it lacks one, `ready` as completed, the owner from the address."""
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/]+/+([^/]+)", 1)
    return repositories.withColumns(
        {
            "branch": F.coalesce("branch", "default_branch"),
            "status": F.when(F.col("status") == "ready", "completed").otherwise(F.col("status")),
            "owner": F.coalesce("owner", F.when(path != "", path)),
        }
    )


def repository_summary(symbols: DataFrame, files: DataFrame, imports: DataFrame, edges: DataFrame, shown: int = 10, packages: int = 15) -> DataFrame:
    """(repository_id, facet, value, n) of every repository in one table.

    Facets: files_by_language, parse_status, symbols_by_kind, imports (by status), relationships
    (`type:confidence`, zeros included), most_imported (the `shown` paths with most importing edges),
    external_packages (the `packages` names that most files import).

    symbols(repository_id, kind), files(repository_id, language, parse_status), imports(repository_id,
    path, status, package), edges(repository_id, type, confidence, target_path). Top lists break ties by name.
    """
    count = lambda df, facet, value: df.groupBy("repository_id", value.alias("value")).agg(F.count("*").alias("n")).select("repository_id", F.lit(facet).alias("facet"), "value", "n")
    parts = [
        count(files, "files_by_language", F.col("language")),
        count(files, "parse_status", F.col("parse_status")),
        count(symbols, "symbols_by_kind", F.col("kind")),
        count(imports, "imports", F.col("status")),
    ]
    pairs = edges.select("repository_id", "type").distinct().select("*", F.explode(F.array(F.lit("confirmed"), F.lit("inferred"))).alias("confidence"))
    tally = edges.groupBy("repository_id", "type", "confidence").agg(F.count("*").alias("n"))
    related = pairs.join(tally, ["repository_id", "type", "confidence"], "left")
    parts.append(related.select("repository_id", F.lit("relationships").alias("facet"), F.concat_ws(":", "type", "confidence").alias("value"), F.coalesce("n", F.lit(0)).alias("n")))
    top = lambda df, n: df.withColumn("r", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("n"), "value"))).filter(F.col("r") <= n).drop("r")
    parts.append(top(count(edges.filter(F.col("type") == "imports"), "most_imported", F.col("target_path")), shown))
    by_file = imports.filter((F.col("status") == "external") & F.col("package").isNotNull()).select("repository_id", "path", "package").distinct()
    parts.append(top(count(by_file, "external_packages", F.col("package")), packages))
    return reduce(lambda a, b: a.unionByName(b), parts)
