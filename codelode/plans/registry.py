"""Driver queries of the code-intelligence operators, over whole tables, and their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.languages import EXTENSION_LANGUAGE, NON_PROGRAMMING, _FILENAMES, language_of, worth_chunking
from codelode.functions.paths import branch_ok, repository_url, sha_ok
from codelode.functions.text import STOPWORDS, line_count, tokens
from codelode.operators import catalog, chunking, ecmascript_analysis, evaluation, extensions, graph, python_analysis, resolution, retrieval, search_index
from codelode.session import dropping_shuffles, materialise, once_by_id, once_in_place, read_table, shared_dir, spread

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text").filter("text is not null"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """The query set: the title of every document whose id is divisible by 50."""
    return read_table(spark, d, "documents").filter("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return bm25_topk(spark, d)


def tokenizer_terms(spark: SparkSession, d: str) -> DataFrame:
    listed = _documents(spark, d).select(F.explode(tokens(F.col("text"))).alias("term"))
    return listed.groupBy("term").agg(F.count("*").alias("occurrences"))


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    n = docs.count()
    return retrieval.term_stats(retrieval.postings(docs), n).withColumn("idf", F.round("idf", 6))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_documents(spark, d), _titles(spark, d))


def bm25_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Each title should bring its own document back."""
    titles = _titles(spark, d)
    got = evaluation.ranked_files(bm25_topk(spark, d))
    cases = titles.join(got, "query_id", "left").select("query_id", "retrieved", F.array(F.col("query_id")).alias("relevant"))
    return evaluation.summary(evaluation.case_metrics(cases, 5))


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(_documents(spark, d), _titles(spark, d), retrieval.SearchOptions(strategy="hybrid"))


def search_reranked(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(_documents(spark, d), _titles(spark, d), retrieval.SearchOptions(strategy="hybrid_rerank"))


def _vectors(spark: SparkSession, d: str, first: int = 1, size: int = 64) -> tuple[DataFrame, DataFrame]:
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.slice("embedding", first, size).alias("embedding"))
    return v, v.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = _vectors(spark, d)
    return retrieval.dense(docs, asked, 10)


def _halves(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: retrieval.dense(*_vectors(spark, d, first, 32), 20) for name, first in (("front", 1), ("back", 33))}


def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(_halves(spark, d), "rrf", k=10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def fusion_weighted(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.fuse(_halves(spark, d), "weighted", {"front": 0.7, "back": 0.3})
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.nearest_percentiles(read_table(spark, d, "events"), "value", "event_type")


def file_language(spark: SparkSession, d: str) -> DataFrame:
    f = once_by_id(read_table(spark, d, "repository_files"))
    lang = language_of(F.col("path"))
    return f.select("id", lang.alias("detected"), worth_chunking(F.col("path"), lang).alias("chunked"))


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", line_count(F.col("text")).alias("lines"), F.sha2("text", 256).alias("sha256"))


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    found = catalog.find_symbols(read_table(spark, d, "code_symbols"), read_table(spark, d, "code_files"), "load")
    return catalog.page(found.select("id", "name", "path", "start_line"), [*catalog.symbol_order("load"), F.col("id")], 100)


def exported_classes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.find_symbols(read_table(spark, d, "code_symbols"), read_table(spark, d, "code_files"), kind="class", exported=True).select("id", "path")


def file_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.file_list(read_table(spark, d, "repository_files"), read_table(spark, d, "code_files"))


def files_not_analyzed(spark: SparkSession, d: str) -> DataFrame:
    return catalog.not_analyzed(read_table(spark, d, "repository_files"), read_table(spark, d, "code_files")).select("id")


def language_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.language_stats(read_table(spark, d, "repository_files"), "repository_id")


def primary_language(spark: SparkSession, d: str) -> DataFrame:
    return catalog.primary_language(read_table(spark, d, "repository_files"))


def language_share(spark: SparkSession, d: str) -> DataFrame:
    return catalog.language_share(read_table(spark, d, "repository_files"))


def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest_job(read_table(spark, d, "indexing_jobs")).select("repository_id", "id", "status")


def several_active(spark: SparkSession, d: str) -> DataFrame:
    return catalog.several_active(read_table(spark, d, "indexing_jobs"))


def jobs_page(spark: SparkSession, d: str) -> DataFrame:
    jobs = once_by_id(read_table(spark, d, "indexing_jobs"))
    rows = catalog.page(jobs.select("id", "status", "created_at"), catalog.newest_first(jobs), 20, 20)
    return rows.select("id", "status", F.unix_micros("created_at").alias("created_us"))


def symbol_outline(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.outline(read_table(spark, d, "code_symbols"))
    return out.select("id", "parent_name", F.coalesce(F.size("children"), F.lit(0)).alias("children"))


def symbol_ancestors(spark: SparkSession, d: str) -> DataFrame:
    s = once_by_id(read_table(spark, d, "code_symbols")).filter("parent_symbol_id is not null")
    return resolution.closure(s.select(F.col("id").alias("source"), F.col("parent_symbol_id").alias("target")))


def directory_rollup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.directory_rollup(read_table(spark, d, "repository_files"))


def symbol_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.symbol_summary(read_table(spark, d, "code_symbols"))


def skipped_files(spark: SparkSession, d: str) -> DataFrame:
    return catalog.skipped(read_table(spark, d, "repository_files"), 100_000, 60)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem")
    return rows.select(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_returnflag") == "R", "confirmed").otherwise("inferred").alias("confidence"), F.col("l_linestatus").alias("strategy"), F.col("l_linenumber").alias("line"),
    )


def edge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.aggregate_edges(_edges(spark, d))
    return out.select("source", "target", "weight", "confidence", F.array_join("strategies", ",").alias("strategies"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def edges_of_node(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.edges_of(catalog.aggregate_edges(_edges(spark, d)), F.lit(7))
    return out.select("direction", "neighbour", "weight")


def repository_checks(spark: SparkSession, d: str) -> DataFrame:
    r = once_by_id(read_table(spark, d, "repositories"))
    return r.select("id", repository_url(F.col("url"))["ok"].alias("url_ok"), branch_ok(F.col("branch")).alias("branch_ok"), sha_ok(F.col("commit_sha")).alias("sha_ok"))


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.documents_as_chunks(spread(read_table(spark, d, "documents").select("doc_id", "repository_id", "text")))
    return out.select("id", "file_path", "chunk_type", "qualified_name", "start_line", "end_line", "token_count")


def python_modules(spark: SparkSession, d: str) -> DataFrame:
    return resolution.python_modules(once_by_id(read_table(spark, d, "repository_files")))


def _sources(spark: SparkSession, d: str, *languages: str) -> DataFrame:
    """(repository_id, path, content): the chunks of each file put together again in order of their lines."""
    chunks = once_by_id(read_table(spark, d, "code_chunks")).filter(F.col("language").isin(*languages) & F.col("content").isNotNull())
    parts = chunks.groupBy("repository_id", F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "id", "content"))).alias("parts"))
    return spread(parts.select("repository_id", "path", F.array_join(F.transform("parts", lambda x: x["content"]), "\n").alias("content")))


def _python_parsed(spark: SparkSession, d: str) -> DataFrame:
    return materialise(python_analysis.analyze_python(_sources(spark, d, "python")), "python")


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    rows = python_analysis.symbol_rows(python_analysis.analyze_python(_sources(spark, d, "python")))
    return rows.select("repository_id", "path", "qualified_name", "kind", "start_line", "end_line", "signature", F.size("parameters").alias("parameters"))


def python_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = python_analysis.import_rows(_python_parsed(spark, d))
    files = once_by_id(read_table(spark, d, "repository_files"))
    return resolution.resolve_python(rows, files).select("repository_id", "path", "ord", "module", "level", "kind", "status", "confidence", "resolved_path", "package")


def _python_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(parsed, symbols, imports, edges) of all Python files."""
    parsed = _python_parsed(spark, d)
    symbols = python_analysis.symbol_rows(parsed)
    imports = materialise(resolution.resolve_python(python_analysis.import_rows(parsed), once_by_id(read_table(spark, d, "repository_files"))), "imports")
    return parsed, symbols, imports, graph.code_graph(symbols, imports, parsed.select("repository_id", "path", F.inline("calls")))


def python_graph(spark: SparkSession, d: str) -> DataFrame:
    return _python_graph(spark, d)[3]


def python_graph_summary(spark: SparkSession, d: str) -> DataFrame:
    parsed, symbols, imports, edges = _python_graph(spark, d)
    return catalog.repository_summary(symbols, parsed.select("repository_id", F.lit("python").alias("language"), F.col("status").alias("parse_status")), imports, materialise(edges, "edges"))


def python_calls(spark: SparkSession, d: str) -> DataFrame:
    out = graph.symbol_calls(_python_parsed(spark, d).select("repository_id", "path", F.inline("calls")))
    return out.select("repository_id", "path", "caller", F.array_join("callees", ",").alias("callees"))


def script_symbols(spark: SparkSession, d: str) -> DataFrame:
    rows = ecmascript_analysis.analyze_ecmascript(_sources(spark, d, "javascript", "typescript", "tsx")).select("repository_id", "path", F.inline("symbols"))
    return rows.select("repository_id", "path", "qualified_name", "kind", "start_line", "end_line", "is_exported", F.size("parameters").alias("parameters"))


def notable_files(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.notable_files(read_table(spark, d, "repository_files"))
    return out.select("repository_id", F.array_join("manifests", ",").alias("manifests"), "readme", "license")


def file_totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.file_totals(read_table(spark, d, "repository_files"))


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.chunk_counts(read_table(spark, d, "code_chunks"))


def symbol_places(spark: SparkSession, d: str) -> DataFrame:
    return catalog.symbol_ranks(read_table(spark, d, "code_symbols"))


def repository_labels(spark: SparkSession, d: str) -> DataFrame:
    return catalog.repository_labels(read_table(spark, d, "repositories"))


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    return catalog.dashboard(read_table(spark, d, "repositories"))


def repository_backfill(spark: SparkSession, d: str) -> DataFrame:
    return catalog.backfill(once_by_id(read_table(spark, d, "repositories"))).select("id", "branch", "status", "owner")


def symbols_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that chunks point to."""
    asked = read_table(spark, d, "code_chunks").filter("symbol_id is not null").select("symbol_id")
    return catalog.by_ids(read_table(spark, d, "code_symbols"), asked).select("id", "name")


def files_without_repository(spark: SparkSession, d: str) -> DataFrame:
    asked = read_table(spark, d, "repository_files").select("repository_id")
    return catalog.missing_ids(read_table(spark, d, "repositories").filter("status = 'completed'"), asked)


def edge_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return catalog.neighbours(catalog.aggregate_edges(_edges(spark, d)), F.lit(7))


def several_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Repositories with several jobs that came to an end, by the operator that looks for several active ones."""
    jobs = read_table(spark, d, "indexing_jobs")
    return catalog.several_active(jobs.withColumn("status", F.when(F.col("status").isin("completed", "failed"), "running").otherwise("ended")))


def _chunk_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with content, each once; those without an id are one. Copies are left out where they stand."""
    rows = read_table(spark, d, "code_chunks")
    with dropping_shuffles(spark):
        once = once_in_place(rows.filter("id is not null"))
    whole = once.unionByName(rows.filter("id is null").limit(1))
    return whole.filter("content is not null")


def _index(spark: SparkSession, d: str, provider: extensions.EmbeddingProvider | None = None) -> search_index.Index:
    """An index of all chunks in the shared folder."""
    root = os.path.join(shared_dir(spark), f"index-{uuid.uuid4().hex}")
    search_index.build_index(_chunk_corpus(spark, d), root, None, provider, copies=False)
    return search_index.IndexCache().load(spark, root)


def _names(chunks: DataFrame) -> DataFrame:
    """(query_id, query): the qualified name of every chunk that has one."""
    return chunks.filter("qualified_name is not null").select(F.col("id").alias("query_id"), F.concat_ws(" ", F.split("qualified_name", r"\.")).alias("query"))


def _symbol_queries(chunks: DataFrame) -> DataFrame:
    """The query set of index_bm25, as its SQL has it: the names of the chunks whose id, its first six digits read as a number, is divisible by 50."""
    rows = _names(chunks)
    return rows.filter(F.conv(F.substring("query_id", 1, 6), 16, 10).cast("long") % 50 == 0)


def index_terms(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms


def index_bm25(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return index.bm25(_symbol_queries(index.chunks), 10)


def index_search(spark: SparkSession, d: str) -> DataFrame:
    """What the names of all chunks find. A name is asked once, however many chunks bear it; one that the service refuses has no rows."""
    root = os.path.join(shared_dir(spark), f"index-{uuid.uuid4().hex}")
    provider = extensions.HashingProvider()
    search_index.build_index(_chunk_corpus(spark, d), root, None, provider, copies=False)
    service = search_index.SearchService(spark, provider)
    names = _names(service.cache.load(spark, root).chunks).filter(search_index.query_ok(F.col("query")))
    asked = names.select(F.col("query").alias("query_id"), "query").distinct()
    found = service.search(root, asked, retrieval.SearchOptions(strategy="hybrid"), columns=("file_path",)).results
    return names.join(found.withColumnRenamed("query_id", "query"), "query").select("query_id", "id", "file_path", "score", "rank")


def document_chunk_checks(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, fits, filled): whether each document's chunks keep the limits, and together hold every filled line but those of dropped separators."""
    out = chunking.documents_as_chunks(spread(read_table(spark, d, "documents").select("doc_id", "repository_id", "text")))
    lines = F.col("end_line") - F.col("start_line") + 1
    fits = (lines == 1) | ((lines <= chunking.MAX_LINES) & (F.length("content") + 1 <= chunking.MAX_CHARS))
    return out.groupBy("file_path").agg(F.bool_and(fits).alias("fits"), F.bool_and(F.col("content").rlike(r"\S")).alias("filled"), (F.count_distinct("id") == F.count("*")).alias("named"))


def queries() -> dict[str, Query]:
    every = (
        tokenizer_terms, bm25_term_stats, bm25_topk, bm25_evaluation, search_hybrid, search_reranked, dense_topk, fusion_rrf, fusion_weighted, latency_percentiles,
        file_language, document_lines, symbol_search, exported_classes, file_list, files_not_analyzed, language_stats, primary_language, language_share, latest_job,
        several_active, jobs_page, symbol_outline, symbol_ancestors, directory_rollup, symbol_summary, skipped_files, edge_aggregate, edges_of_node, repository_checks,
        document_chunks, document_chunk_checks, python_modules, python_symbols, python_imports, python_graph, python_graph_summary, python_calls, script_symbols,
        notable_files, file_totals, chunk_counts, symbol_places, repository_labels, dashboard, repository_backfill, symbols_by_ids, files_without_repository, edge_neighbours, several_jobs,
        index_terms, index_bm25, index_search,
    )
    return {f.__name__: f for f in every}


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _stem(t: str) -> str:
    return (
        f"CASE WHEN {t} LIKE '%ss' THEN {t} WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' WHEN length({t}) > 5 AND {t} LIKE '%sses' THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 5 AND {t} LIKE '%ing' THEN left({t}, length({t}) - 3) WHEN length({t}) > 5 AND {t} LIKE '%ed' THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 4 AND {t} LIKE '%es' THEN left({t}, length({t}) - 2) WHEN length({t}) > 3 AND {t} LIKE '%s' THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def _tokens_sql(source: str, prefix: str) -> str:
    """CTEs ending in {prefix}t(key, term) from a relation of (key, text)."""
    return f"""
{prefix}w AS (SELECT key, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*|\\p{{Nd}}+')) AS word FROM ({source})),
{prefix}p AS (SELECT key, word, regexp_extract_all(regexp_replace(word, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+|\\p{{Nd}}+') AS ps FROM {prefix}w WHERE length(word) <= 40),
{prefix}e AS (SELECT key, lower(unnest(ps)) AS t FROM {prefix}p UNION ALL SELECT key, lower(replace(word, '_', '')) FROM {prefix}p WHERE len(ps) > 1),
{prefix}t AS (SELECT key, {_stem("t")} AS term FROM {prefix}e WHERE length(t) BETWEEN 2 AND 40 AND t NOT IN ({_STOP}))"""


_DOCS = "SELECT doc_id AS key, text FROM documents WHERE text IS NOT NULL"
_BM25 = f"""
WITH {_tokens_sql(_DOCS, "d")},
{_tokens_sql("SELECT doc_id AS key, title AS text FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL", "q")},
tf AS (SELECT key, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT d.key, count(dt.term) AS dl FROM ({_DOCS}) d LEFT JOIN dt USING (key) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
df AS (SELECT term, ln(1 + (st.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term, st.n),
sc AS (SELECT q.key AS query_id, tf.key AS doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / st.a))), 6) AS score
       FROM (SELECT DISTINCT key, term FROM qt) q JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.key = tf.key, st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10)
"""
#: What a chunk is indexed by: header and content, and its path once more.
_CHUNKS = """SELECT id AS key, file_path || ' (' || language || ')' || CASE WHEN coalesce(qualified_name, '') <> '' THEN ' - ' || coalesce(symbol_type, chunk_type) || ' ' || qualified_name ELSE '' END
             || chr(10) || content || chr(10) || translate(file_path, '/.-', '   ') AS text FROM (SELECT DISTINCT ON (id) * FROM code_chunks) WHERE content IS NOT NULL"""
_F = "(SELECT DISTINCT ON (id) * FROM repository_files)"
_S = "(SELECT DISTINCT ON (id) * FROM code_symbols)"
_C = "(SELECT DISTINCT ON (id) * FROM code_files)"
_J = "(SELECT DISTINCT ON (id) * FROM indexing_jobs)"
_LANGS = ", ".join(f"('{e}', '{v}')" for e, v in EXTENSION_LANGUAGE.items())
_NAMES = ", ".join(f"('{e}', '{v}')" for e, v in _FILENAMES.items())
_NONPROG = ", ".join(f"'{x}'" for x in NON_PROGRAMMING)


def _half(name: str, first: int, last: int) -> str:
    dot = f"list_inner_product(q.embedding[{first}:{last}]::DOUBLE[], d.embedding[{first}:{last}]::DOUBLE[])"
    return f"{name} AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({dot}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({dot}, 6) DESC, d.vec_id)::INT AS rank FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 QUALIFY rank <= 20)"


_HALVES = f"WITH {_half('f', 1, 32)}, {_half('b', 33, 64)}"
_EDGES = "SELECT l_suppkey AS source, l_partkey AS target, l_orderkey * 10 + l_linenumber AS ord, l_returnflag = 'R' AS sure, l_linestatus AS strategy, l_linenumber AS line FROM lineitem WHERE l_suppkey <> l_partkey"


def oracle_sql() -> dict[str, str]:
    kinds = ["function", "method", "class", "component", "interface", "type_alias", "enum", "variable"]
    lang_stats = f"SELECT repository_id, language, count(*)::BIGINT AS files, sum(size_bytes)::BIGINT AS bytes FROM {_F} WHERE language IS NOT NULL GROUP BY ALL"
    return {
        "notable_files": f"""WITH f AS (SELECT repository_id, path, regexp_extract(path, '[^/]*$') AS name FROM {_F}),
            m AS (SELECT repository_id, string_agg(path, ',' ORDER BY path) AS manifests FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY path) AS r FROM (SELECT DISTINCT repository_id, path FROM f WHERE name IN ('package.json','pyproject.toml','requirements.txt','setup.py','setup.cfg','Pipfile','poetry.lock','go.mod','Cargo.toml','pom.xml','build.gradle','build.gradle.kts','Gemfile','composer.json','mix.exs','pubspec.yaml','Package.swift','CMakeLists.txt','Makefile','Dockerfile','docker-compose.yml'))) WHERE r <= 50 GROUP BY 1)
            SELECT f.repository_id, any_value(manifests) AS manifests, min(path) FILTER (NOT contains(path, '/') AND lower(name) LIKE 'readme%') AS readme,
                   min(path) FILTER (NOT contains(path, '/') AND regexp_matches(lower(name), '^(license|licence|copying)')) AS license FROM f LEFT JOIN m USING (repository_id) GROUP BY 1""",
        "file_totals": f"SELECT repository_id, count(*)::BIGINT AS total_files, sum(size_bytes)::BIGINT AS total_size_bytes, count(*) FILTER (size_bytes <= 1048576)::BIGINT AS indexed_files FROM {_F} GROUP BY 1",
        "chunk_counts": "WITH c AS (SELECT DISTINCT ON (id) * FROM code_chunks) SELECT 'chunk_type' AS facet, chunk_type AS value, count(*)::BIGINT AS chunks FROM c GROUP BY ALL UNION ALL SELECT 'language', language, count(*)::BIGINT FROM c GROUP BY ALL",
        "symbol_places": f"SELECT id, row_number() OVER (PARTITION BY file_id ORDER BY start_line, end_line DESC, id)::INT AS place FROM {_S}",
        "repository_labels": "SELECT id, CASE WHEN coalesce(owner, '') <> '' THEN owner || '/' || name ELSE name END AS full_name, left(commit_sha, 7) AS short_sha, CASE WHEN source_type = 'github' THEN url || '/commit/' || commit_sha END AS commit_url FROM repositories",
        "dashboard": "SELECT count(DISTINCT project_id)::BIGINT AS projects, count(*)::BIGINT AS repositories, count(*) FILTER (status = 'completed')::BIGINT AS completed FROM repositories",
        "repository_backfill": "SELECT id, coalesce(branch, default_branch) AS branch, CASE WHEN status = 'ready' THEN 'completed' ELSE status END AS status, coalesce(owner, nullif(regexp_extract(coalesce(url, ''), '^[a-z]+://[^/]+/+([^/]+)', 1), '')) AS owner FROM repositories",
        "symbols_by_ids": f"SELECT id, name FROM {_S} WHERE id IN (SELECT symbol_id FROM code_chunks WHERE symbol_id IS NOT NULL)",
        "files_without_repository": "SELECT DISTINCT repository_id AS id FROM repository_files WHERE repository_id NOT IN (SELECT id FROM repositories WHERE status = 'completed')",
        "edge_neighbours": f"""WITH g AS (SELECT source, target, count(*)::BIGINT AS weight FROM ({_EDGES}) GROUP BY ALL),
            e AS (SELECT 'outgoing' AS direction, target AS neighbour, weight FROM g WHERE source = 7 UNION ALL SELECT 'incoming', source, weight FROM g WHERE target = 7),
            r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY weight DESC, neighbour) AS r, count(*) OVER (PARTITION BY direction) AS n FROM e)
            SELECT direction, neighbour::VARCHAR AS neighbour, NULL::BIGINT AS more FROM r WHERE n <= 12 OR r < 12 UNION ALL SELECT direction, NULL, count(*)::BIGINT FROM r WHERE n > 12 AND r >= 12 GROUP BY 1""",
        "several_jobs": f"SELECT repository_id, count(*)::BIGINT AS active FROM {_J} WHERE status IN ('completed', 'failed') GROUP BY 1 HAVING count(*) > 1",
        "index_terms": f"WITH {_tokens_sql(_CHUNKS, 'c')} SELECT term, count(DISTINCT key)::BIGINT AS df FROM ct GROUP BY term",
        "index_bm25": f"""WITH {_tokens_sql(_CHUNKS, "d")},
            {_tokens_sql("SELECT id AS key, replace(qualified_name, '.', ' ') AS text FROM (SELECT DISTINCT ON (id) * FROM code_chunks) WHERE content IS NOT NULL AND qualified_name IS NOT NULL AND ('0x' || left(id, 6))::INT % 50 = 0", "q")},
            tf AS (SELECT key, term, count(*) AS tf FROM dt GROUP BY ALL),
            dl AS (SELECT k.key, count(dt.term) AS dl FROM ({_CHUNKS}) k LEFT JOIN dt USING (key) GROUP BY ALL),
            st AS (SELECT count(*) AS n, round(avg(dl), 2) AS a FROM dl),
            df AS (SELECT term, ln(1 + (st.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term, st.n),
            sc AS (SELECT q.key AS query_id, tf.key AS doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / st.a))), 6) AS score
                   FROM (SELECT DISTINCT key, term FROM qt) q JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.key = tf.key, st GROUP BY ALL)
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10""",
        "document_chunk_checks": "SELECT doc_id || '.md' AS file_path, true AS fits, true AS filled, true AS named FROM documents WHERE regexp_matches(text, '\\S')",
        "tokenizer_terms": f"WITH {_tokens_sql(_DOCS, 'd')} SELECT term, count(*)::BIGINT AS occurrences FROM dt GROUP BY term",
        "bm25_term_stats": f"WITH {_tokens_sql(_DOCS, 'd')}, n AS (SELECT count(*) AS n FROM ({_DOCS})) SELECT term, count(DISTINCT key)::BIGINT AS df, round(ln(1 + (n.n - count(DISTINCT key) + 0.5) / (count(DISTINCT key) + 0.5)), 6) AS idf FROM dt, n GROUP BY term, n.n",
        "bm25_topk": _BM25 + "SELECT query_id, doc_id, score, rank FROM bm",
        "bm25_evaluation": _BM25
        + """, r AS (SELECT d.doc_id AS query_id, max(CASE WHEN bm.doc_id = d.doc_id THEN rank END) AS rank, count(bm.doc_id) AS n FROM documents d LEFT JOIN bm ON bm.query_id = d.doc_id
            WHERE d.doc_id % 50 = 0 AND title IS NOT NULL GROUP BY ALL)
            SELECT count(*)::BIGINT AS cases, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS recall, round(avg(CASE WHEN rank <= 5 THEN 1.0 / least(n, 5) ELSE 0.0 END), 4)::DOUBLE AS precision,
            round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS hit, round(avg(coalesce(1.0 / rank, 0.0)), 4)::DOUBLE AS reciprocal_rank, round(avg(CASE WHEN rank <= 5 THEN 1.0 / log2(rank + 1) ELSE 0.0 END), 4)::DOUBLE AS ndcg FROM r""",
        "dense_topk": "SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) DESC, d.vec_id)::INT AS rank FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10",
        "fusion_rrf": _HALVES
        + ", u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS v FROM f UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM b), s AS (SELECT query_id, doc_id, round(sum(v)::DOUBLE, 9) AS score FROM u GROUP BY ALL) SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10",
        "fusion_weighted": _HALVES
        + ", u AS (SELECT query_id, doc_id, 0.7 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS v FROM f WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT query_id, doc_id, 0.3 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) FROM b WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(sum(v), 4)::DOUBLE AS score FROM u GROUP BY ALL",
        "latency_percentiles": "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, len(v)::BIGINT AS n, v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] AS p95 FROM s",
        "file_language": f"WITH l(e, v) AS (VALUES {_LANGS}), m(e, v) AS (VALUES {_NAMES}), p AS (SELECT id, path, regexp_extract(path, '[^/]*$') AS name FROM {_F}), x AS (SELECT p.id, p.path, p.name, coalesce(m.v, l.v) AS detected FROM p LEFT JOIN m ON m.e = p.name LEFT JOIN l ON l.e = lower(regexp_extract(p.name, '^.+(\\.[^.]*)$', 1))) SELECT id, detected, (detected IS NOT NULL OR regexp_matches(lower(path), '\\.(md|mdx|markdown|rst)$')) AND NOT (name IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'poetry.lock', 'uv.lock', 'Cargo.lock', 'composer.lock', 'Gemfile.lock', 'go.sum')) AND coalesce(detected NOT IN ('JSON', 'CSV'), true) AS chunked FROM x",
        "document_lines": "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::INT AS lines, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
        "symbol_search": f"SELECT s.id, name, path, start_line FROM {_S} s JOIN {_C} c ON c.id = s.file_id WHERE contains(lower(name), 'load') OR contains(lower(qualified_name), 'load') ORDER BY lower(name) <> 'load', length(name), name, path, start_line, s.id LIMIT 100",
        "exported_classes": f"SELECT s.id, path FROM {_S} s JOIN {_C} c ON c.id = s.file_id WHERE lower(trim(kind)) = 'class' AND is_exported",
        "file_list": f"SELECT f.id, f.repository_id, f.path, f.language, f.size_bytes, f.line_count, c.parse_status, coalesce(c.symbol_count, 0) AS symbol_count, coalesce(c.import_count, 0) AS import_count, c.id IS NOT NULL AS analyzed FROM {_F} f LEFT JOIN {_C} c USING (repository_id, path)",
        "files_not_analyzed": f"SELECT f.id FROM {_F} f ANTI JOIN code_files c USING (repository_id, path)",
        "language_stats": lang_stats,
        "primary_language": f"WITH s AS ({lang_stats}) SELECT repository_id, arg_max(language, ((language NOT IN ({_NONPROG})), bytes, language)) AS language FROM s GROUP BY 1",
        "language_share": f"WITH s AS ({lang_stats}), r AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY bytes DESC, language) AS r, count(*) OVER (PARTITION BY repository_id) AS k, sum(bytes) OVER (PARTITION BY repository_id) AS w FROM s) SELECT repository_id, CASE WHEN r > 4 AND k > 5 THEN 'Other (' || (k - 4) || ')' ELSE language END AS label, sum(bytes)::BIGINT AS bytes, round(sum(bytes) / max(w), 6)::DOUBLE AS share FROM r GROUP BY ALL",
        "latest_job": f"SELECT repository_id, id, status FROM {_J} QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) = 1",
        "several_active": f"SELECT repository_id, count(*)::BIGINT AS active FROM {_J} WHERE status IN ('queued', 'running') GROUP BY 1 HAVING count(*) > 1",
        "jobs_page": f"SELECT id, status, epoch_us(created_at) AS created_us FROM {_J} ORDER BY created_at DESC, id LIMIT 20 OFFSET 20",
        "symbol_outline": f"WITH s AS {_S} SELECT s.id, p.qualified_name AS parent_name, (SELECT count(*) FROM s c WHERE c.parent_symbol_id = s.id)::INT AS children FROM s LEFT JOIN s p ON p.id = s.parent_symbol_id",
        "symbol_ancestors": f"WITH RECURSIVE s AS (SELECT id AS source, parent_symbol_id AS target FROM {_S} WHERE parent_symbol_id IS NOT NULL), r AS (SELECT source, target, 1 AS steps FROM s UNION SELECT r.source, s.target, r.steps + 1 FROM r JOIN s ON s.source = r.target WHERE r.steps < 4) SELECT source, target, min(steps)::INT AS steps FROM r WHERE source <> target GROUP BY ALL",
        "directory_rollup": f"WITH f AS (SELECT repository_id, size_bytes, string_split(path, '/') AS p FROM {_F}), x AS (SELECT repository_id, size_bytes, unnest(list_transform(range(0, len(p)), lambda n: array_to_string(p[1:n], '/'))) AS dir FROM f) SELECT repository_id, dir, count(*)::BIGINT AS files, sum(size_bytes)::BIGINT AS bytes FROM x GROUP BY ALL",
        "symbol_summary": "SELECT repository_id, " + ", ".join(f"count(*) FILTER (lower(trim(kind)) = '{k}')::BIGINT AS {k}" for k in kinds) + f" FROM {_S} GROUP BY 1",
        "skipped_files": f"SELECT CASE WHEN length(path) > 60 THEN 'path_too_long' WHEN size_bytes > 100000 THEN 'too_large' ELSE 'unreadable' END AS reason, count(*)::BIGINT AS files FROM {_F} WHERE length(path) > 60 OR size_bytes > 100000 OR size_bytes IS NULL GROUP BY 1",
        "edge_aggregate": f"WITH e AS ({_EDGES}), g AS (SELECT source, target, count(*)::BIGINT AS weight, bool_or(sure) AS sure FROM e GROUP BY ALL), st AS (SELECT source, target, string_agg(strategy, ',' ORDER BY o) AS strategies FROM (SELECT source, target, strategy, min(ord) AS o FROM e GROUP BY ALL) GROUP BY ALL), ln AS (SELECT source, target, string_agg(line::VARCHAR, ',' ORDER BY o) AS lines FROM (SELECT source, target, line, min(ord) AS o FROM e GROUP BY source, target, line) GROUP BY ALL) SELECT source, target, weight, CASE WHEN sure THEN 'confirmed' ELSE 'inferred' END AS confidence, strategies, lines FROM g JOIN st USING (source, target) JOIN ln USING (source, target)",
        "edges_of_node": f"WITH g AS (SELECT source, target, count(*)::BIGINT AS weight FROM ({_EDGES}) GROUP BY ALL) SELECT 'outgoing' AS direction, target AS neighbour, weight FROM g WHERE source = 7 UNION ALL SELECT 'incoming', source, weight FROM g WHERE target = 7",
        "repository_checks": "SELECT id, coalesce(regexp_matches(url, '^https://(www\\.)?github\\.com/[A-Za-z0-9]([A-Za-z0-9]|-[A-Za-z0-9])*/[A-Za-z0-9._-]{1,100}/*$'), false) AS url_ok, coalesce(regexp_matches(branch, '^[A-Za-z0-9._/+#@-]{1,255}$') AND NOT regexp_matches(branch, '^[-/]|[/.]$|\\.lock$|\\.\\.|//|@\\{|(^|/)\\.') AND branch <> '@', false) AS branch_ok, coalesce(regexp_matches(commit_sha, '^[0-9a-f]{40}([0-9a-f]{24})?$'), false) AS sha_ok FROM repositories",
        "python_modules": f"""WITH py AS (SELECT DISTINCT repository_id, path FROM {_F} WHERE regexp_matches(path, '\\.pyi?$')),
            s AS (SELECT repository_id, path, list_filter(string_split(regexp_replace(regexp_replace(path, '\\.pyi?$', ''), '(^|/)__init__$', ''), '/'), lambda p: p <> '') AS p FROM py),
            x AS (SELECT repository_id, path, p, unnest(range(1, len(p) + 1)) AS n FROM s WHERE len(p) > 0 AND len(list_filter(p, lambda a: NOT regexp_matches(a, '^[A-Za-z_][A-Za-z0-9_]*$'))) = 0),
            y AS (SELECT repository_id, path, array_to_string(p[n:len(p)], '.') AS module, array_to_string(p[1:n - 1], '/') AS above FROM x)
            SELECT repository_id, module, path FROM y WHERE above = '' OR NOT EXISTS (SELECT 1 FROM py k WHERE k.repository_id = y.repository_id AND k.path = y.above || '/__init__.py')""",
    }
