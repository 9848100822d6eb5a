"""Ranked retrieval for batches of queries: BM25, dense, hybrid fusion, reranking.

Every function takes a DataFrame of queries and returns ranked rows
(query_id, doc_id, score, rank); one query is the case of one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructType

from codelode.functions.text import tokens
from codelode.operators import postings as postings_
from codelode.session import materialise, maybe_broadcast


class RetrievalError(ValueError):
    """An error with one of the codes that callers rely on."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass
class SearchOptions:
    """Bounds of a search; what is out of range is refused."""

    strategy: str = "hybrid"
    top_k: int = 10
    k1: float = 1.2
    b: float = 0.75
    fusion: str = "rrf"
    weights: dict[str, float] = field(default_factory=lambda: {"bm25": 0.5, "dense": 0.5})
    rrf_k: int = 60
    candidates: int = 50
    rerank_candidates: int = 20
    reranker: str | None = None

    def __post_init__(self):
        if self.strategy not in ("bm25", "dense", "hybrid", "hybrid_rerank"):
            raise RetrievalError("invalid_strategy", self.strategy)
        for name, low, high in (("top_k", 1, 50), ("rrf_k", 1, 1000), ("candidates", 1, 500), ("rerank_candidates", 1, 200)):
            if not low <= getattr(self, name) <= high:
                raise RetrievalError("invalid_option", f"{name} not in {low}..{high}")
        if any(not 0 <= w <= 10 for w in self.weights.values()):
            raise RetrievalError("invalid_option", "weights not in 0..10")
        if self.fusion not in ("rrf", "weighted"):
            raise RetrievalError("invalid_option", self.fusion)


def top_k(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best rows of each query by score, ties by doc_id. Scores are rounded first, so a
    sum in another order can't change a rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("score", F.bround("score", digits)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): term frequencies and document length. One shuffle, pre-aggregated."""
    listed = docs.select("doc_id", tokens(F.col(text)).alias("tokens"))
    return listed.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf)."""
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def corpus_stats(docs: DataFrame, text: str = "text") -> tuple[int, float]:
    """(documents, average length)."""
    row = docs.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
    return int(row["n"]), float(row["a"] or 0.0)


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, text: str = "text") -> DataFrame:
    """(query_id, doc_id, score) over the distinct terms of each query, positive scores only.

    Only terms that some query holds are exploded into rows, before any shuffle; the rest of
    a document counts by its length alone.
    """
    # the token lists are written once and read by every step that follows
    listed = materialise(docs.select("doc_id", tokens(F.col(text)).alias("tokens")), "bm25-tokens")
    row = listed.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("a")).first()
    n, avgdl = int(row["n"]), float(row["a"] or 0.0)
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    vocabulary = asked.select("term").distinct()
    rows = listed.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(maybe_broadcast(vocabulary), "term", "left_semi")
    tf = rows.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))
    weighted = tf.join(maybe_broadcast(term_stats(tf, n)), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(max(avgdl, 1e-12))))
    return weighted.withColumn("part", part).join(maybe_broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")).filter("score > 0")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    return top_k(bm25_scores(docs, queries, **options), k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; cosine on unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _block_scores(ids: list, vectors: np.ndarray, k: int, kind: pa.DataType):
    """For batches of (doc_id, embedding) the task's k best documents of each query, by score of six digits and id."""
    # hashed vectors of short queries hold a few numbers only, and go out as these
    size, dims = vectors.shape[1], np.nonzero(vectors)
    ends = np.cumsum(np.bincount(dims[0], minlength=len(ids)))[:-1]
    at, values = dims[1].astype(np.int32), vectors[dims]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vector = np.split(at, ends), np.split(values, ends)
        top = postings_.Best(pa.array(ids, kind), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.sort_indices(batch.column(0), null_placement="at_start")
            doc = batch.column(0).take(order)
            m = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            m = np.ascontiguousarray(m[order.to_numpy()].T)
            found = []
            for first in range(0, len(ids), 128):
                some, whole = range(first, min(first + 128, len(ids))), None
                if sum(len(held[q]) for q in some) * 8 > len(some) * len(m):
                    block = np.zeros((len(some), size))
                    for q in some:
                        block[q - first, held[q]] = vector[q]
                    whole = block @ m
                for q in some:
                    score = whole[q - first] if whole is not None else vector[q] @ m[held[q]]
                    places = np.flatnonzero(score >= top.low[q] - 1e-6)
                    if len(places):
                        places, kept = postings_.best(places, np.round(score[places], 6), k)
                        found.append((q, places, kept))
            top.add(doc, found)
        yield from top.batches()

    return run


#: Queries compared with the corpus at once; more of them go in further blocks.
QUERY_BLOCK = 16384


def dense(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact inner-product search over (doc_id, embedding), negatives included.

    The queries of a block are one matrix that every task multiplies with its batches, keeping
    what is among a query's k best so far, so the shuffle carries k rows a query and task at most.
    """
    dims = docs.select(F.size("embedding").alias("n")).filter("n >= 0").agg(F.min("n"), F.max("n")).first()
    if dims[0] != dims[1]:
        raise RetrievalError("dense_index_unavailable", "vectors differ in length")
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    out = None
    block: list = []

    def add(block: list, out):
        kind = queries.schema["query_id"].dataType
        schema = StructType().add("query_id", kind).add("doc_id", docs.schema["doc_id"].dataType).add("score", "double")
        score = _block_scores([r[0] for r in block], np.array([r[1] for r in block]), k, to_arrow_type(kind))
        some = docs.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding").mapInArrow(score, schema)
        return some if out is None else out.unionByName(some)

    for row in asked.toLocalIterator():
        block.append((row[0], np.array(row[1], np.float64)))
        if len(block) == QUERY_BLOCK:
            out, block = add(block, out), []
    if block or out is None:
        if not block:
            return asked.select("query_id", F.col("query_id").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        out = add(block, out)
    return top_k(out, k)


def embed_documents(docs: DataFrame, text: str = "text", max_chars: int | None = None) -> DataFrame:
    """(doc_id, embedding): hashed token vectors of 256 dimensions.

    The whole text counts; max_chars, where a caller gives it, keeps a prefix.
    """
    whole = F.col(text) if max_chars is None else F.substring(F.col(text), 1, max_chars)
    return docs.select("doc_id", whole.alias("text")).mapInArrow(postings_.embedder(), StructType().add("doc_id", docs.schema["doc_id"].dataType).add("embedding", ArrayType(DoubleType())))


def fuse(lists: dict[str, DataFrame], method: str = "rrf", weights: dict[str, float] | None = None, rrf_k: int = 60, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank, components) of several ranked lists.

    rrf: sum of weight / (rrf_k + rank). weighted: sum of weight times the score scaled to
    0..1 within its list and query, 1 where all scores are equal. A source without a weight
    counts 1.
    """
    weights = weights or {}
    parts = None
    for name, ranked in lists.items():
        w = float(weights.get(name, 1.0))
        if method == "rrf":
            value = F.lit(w) / (F.lit(rrf_k) + F.col("rank"))
        else:
            q = Window.partitionBy("query_id")
            low, high = F.min("score").over(q), F.max("score").over(q)
            value = F.lit(w) * F.when(high - low < 1e-12, 1.0).otherwise((F.col("score") - low) / (high - low))
        part = ranked.select("query_id", "doc_id", value.alias("value"), F.struct(F.lit(name).alias("k"), F.col("score").cast("double").alias("v")).alias("c"))
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("query_id", "doc_id").agg(F.sum("value").alias("score"), F.map_from_entries(F.array_sort(F.collect_list("c"))).alias("components"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = merged.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def keyword_score(query: Column, text: Column) -> Column:
    """Share of the text's tokens that the query holds, and share of the query's terms that the text holds."""
    q, d = F.array_distinct(tokens(query)), tokens(text)
    held = F.size(F.filter(d, lambda t: F.array_contains(q, t))) / F.size(d)
    score = held + F.size(F.array_intersect(q, d)) / F.size(q)
    return F.when((F.size(q) > 0) & (F.size(d) > 0), F.round(score, 6)).otherwise(0.0)


#: Rerankers by name: functions of (query, text) columns.
RERANKERS: dict[str, Callable[[Column, Column], Column]] = {"keyword": keyword_score}


def reranker(name: str | None) -> Callable[[Column, Column], Column]:
    """By name; the first in alphabetical order where none is named."""
    if not RERANKERS:
        raise RetrievalError("reranker_unavailable")
    name = name or min(RERANKERS)
    if name not in RERANKERS:
        raise RetrievalError("unknown_reranker", name)
    return RERANKERS[name]


def rerank(ranked: DataFrame, queries: DataFrame, docs: DataFrame, name: str | None = None, depth: int = 20, k: int = 10, text: str = "text") -> DataFrame:
    """The first `depth` rows of each query ordered anew; a document without a row has no text."""
    first = ranked.filter(F.col("rank") <= max(depth, k)).select("query_id", "doc_id", F.col("score").alias("first_stage_score"), F.col("rank").alias("first_stage_rank"))
    full = first.join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", F.col(text).alias("body")), "doc_id", "left")
    scored = full.withColumn("score", reranker(name)(F.col("query"), F.coalesce("body", F.lit(""))))
    return top_k(scored.select("query_id", "doc_id", "score", "first_stage_score", "first_stage_rank"), k)


def search(docs: DataFrame, queries: DataFrame, options: SearchOptions | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """Run one strategy over a batch of (query_id, query) rows against (doc_id, text)."""
    o = options or SearchOptions()
    depth = max(o.candidates, o.rerank_candidates, o.top_k) if o.strategy.startswith("hybrid") else o.top_k
    if o.reranker and not o.strategy.startswith("hybrid"):
        depth = max(o.rerank_candidates, o.top_k)
    lists = {}
    if o.strategy != "dense":
        lists["bm25"] = bm25(docs, queries, depth, k1=o.k1, b=o.b)
    if o.strategy != "bm25":
        # embedded once, though the search reads the vectors several times
        vectors = embeddings if embeddings is not None else materialise(embed_documents(docs), "vectors")
        asked = embed_documents(queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))).withColumnRenamed("doc_id", "query_id")
        lists["dense"] = dense(vectors, asked, depth)
    ranked = next(iter(lists.values())) if len(lists) == 1 else fuse(lists, o.fusion, o.weights, o.rrf_k)
    if o.strategy == "hybrid_rerank" or o.reranker:
        return rerank(ranked, queries, docs, o.reranker, o.rerank_candidates, o.top_k)
    return ranked.filter(F.col("rank") <= o.top_k).select("query_id", "doc_id", "score", "rank")


def hydrate(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked rows with their documents; missing documents drop out and ranks close up."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return maybe_broadcast(ranked).join(docs, "doc_id").withColumn("rank", F.row_number().over(w))
