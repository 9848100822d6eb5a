import math

import pytest
from pyspark.sql import functions as F

from codelode.operators import evaluation, retrieval
from codelode.operators.retrieval import RetrievalError, SearchOptions

DOCS = [(1, "parse the configuration file"), (2, "send email to the user"), (3, "parse parse parse tokens"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_bm25_against_formula(spark, docs):
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(docs, queries(spark, "parse parse", "nothing")).collect()}
    dl = {1: 3, 2: 3, 3: 4, 4: 0, 5: 0}
    avg = sum(dl.values()) / 5
    idf = math.log(1 + (5 - 2 + 0.5) / 2.5)
    want = {d: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[d] / avg)), 6) for d, tf in ((1, 1), (3, 3))}
    assert got == {(0, d): pytest.approx(s, abs=2e-6) for d, s in want.items()}


def test_bm25_empty(spark, docs):
    assert retrieval.bm25(docs.limit(0), queries(spark, "parse")).count() == 0
    assert retrieval.bm25(docs, queries(spark, "parse").limit(0)).count() == 0


def test_dense_ties_and_negatives(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["doc_id"], r["score"]) for r in retrieval.dense(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, -1.0)]
    assert [r["doc_id"] for r in retrieval.dense(v, q, 1).collect()] == [1]


def ranked(spark, rows):
    return spark.createDataFrame([(0, d, s, k + 1) for k, (d, s) in enumerate(rows)], "query_id int, doc_id string, score double, rank int")


def test_fusion(spark):
    a, b = ranked(spark, [("a", 12.0), ("b", 8.0), ("c", 2.0)]), ranked(spark, [("c", 0.9), ("a", 0.6), ("d", 0.5)])
    half = {"bm25": 0.5, "dense": 0.5}
    rrf = retrieval.fuse({"bm25": a, "dense": b}, weights=half).orderBy("rank").collect()
    assert [r["doc_id"] for r in rrf] == ["a", "c", "b", "d"]
    assert rrf[0]["score"] == pytest.approx(0.5 / 61 + 0.5 / 62, abs=1e-9)
    assert rrf[0]["components"] == {"bm25": 12.0, "dense": 0.6}
    weighted = {r["doc_id"]: r["score"] for r in retrieval.fuse({"bm25": a, "dense": b}, "weighted", half).collect()}
    assert weighted["a"] == pytest.approx(0.625) and weighted["d"] == 0.0
    single = retrieval.fuse({"bm25": ranked(spark, [("x", 3.0)])}, "weighted").collect()
    assert single[0]["score"] == 1.0


def test_rerank_and_search(spark, docs):
    q = queries(spark, "parse configuration")
    out = retrieval.search(docs, q, SearchOptions(strategy="hybrid_rerank", top_k=2)).orderBy("rank").collect()
    assert out[0]["doc_id"] == 1 and len(out) == 2
    one = retrieval.search(docs, q, SearchOptions(strategy="bm25")).orderBy("rank").collect()
    only = retrieval.search(docs, q, SearchOptions(strategy="hybrid", weights={"bm25": 1.0, "dense": 0.0})).orderBy("rank").collect()
    assert only[0]["doc_id"] == one[0]["doc_id"] == 1
    with pytest.raises(RetrievalError) as error:
        retrieval.reranker("none such")
    assert error.value.code == "unknown_reranker"
    for bad in ({"top_k": 0}, {"top_k": 51}, {"rrf_k": 1001}, {"candidates": 501}, {"strategy": "x"}, {"weights": {"bm25": 11}}):
        with pytest.raises(RetrievalError):
            SearchOptions(**bad)


def test_hydrate_closes_ranks(spark, docs):
    rows = spark.createDataFrame([(0, 9, 3.0, 1), (0, 1, 2.0, 2), (0, 2, 1.0, 3)], "query_id int, doc_id long, score double, rank int")
    assert [(r["doc_id"], r["rank"]) for r in retrieval.hydrate(rows, docs).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_metrics(spark):
    cases = spark.createDataFrame([(["a", "b", "c"], ["b", "z"]), (["a"], []), (None, ["a"])], "retrieved array<string>, relevant array<string>")
    r = evaluation.case_metrics(cases, 2).collect()
    assert (r[0]["recall"], r[0]["precision"], r[0]["hit"], r[0]["reciprocal_rank"]) == (0.5, 0.5, 1.0, 0.5)
    assert r[0]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert all(x[m] == 0.0 for x in r[1:] for m in ("recall", "precision", "hit", "reciprocal_rank", "ndcg"))
    assert evaluation.misses(evaluation.case_metrics(cases, 2)).count() == 2


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 21)] + [("a", None), ("b", 5.0)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in evaluation.nearest_percentiles(df, "v", "k").collect()}
    assert got == {"a": (11.0, 19.0), "b": (5.0, 5.0)}


def test_unique_files(spark):
    rows = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (0, "x", 3)], "query_id int, doc_id string, rank int")
    assert evaluation.ranked_files(rows).collect()[0]["retrieved"] == ["x", "y"]


def test_dense_sees_the_whole_text(spark):
    filler = "alpha beta gamma " * 200  # the term stands only after character 2,000
    docs = spark.createDataFrame([(1, filler), (2, filler + "zebra " * 400)], "doc_id long, text string")
    v = {r["doc_id"]: r["embedding"] for r in retrieval.embed_documents(docs).collect()}
    assert v[1] != v[2]
    short = {r["doc_id"]: r["embedding"] for r in retrieval.embed_documents(docs, max_chars=2000).collect()}
    assert short[1] == short[2]
    got = retrieval.search(docs, queries(spark, "zebra"), SearchOptions(strategy="dense", top_k=1)).collect()
    assert [r["doc_id"] for r in got] == [2] and got[0]["score"] > 0.5


def test_embedding_is_unit(spark, docs):
    v = {r["doc_id"]: r["embedding"] for r in retrieval.embed_documents(docs).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1.0) and sum(map(abs, v[4])) == 0.0
    assert F is not None
