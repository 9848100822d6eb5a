"""Postings by blocks: the disk an index takes, tokens as the JVM has them, scores against all pairs."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from codelode.functions.text import chunk_index_text, chunk_index_tokens, tokens
from codelode.operators import postings, retrieval, search_index
from codelode.session import shared_dir

CHUNK = "id string, repository_id string, file_path string, language string, chunk_type string, symbol_type string, qualified_name string, start_line int, end_line int, content string"


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.fixture(scope="module")
def many(spark):
    """1,500 chunks, some alike but for their id, one delivered twice, one with a word 300 times, one without words, one without content."""
    r = random.Random(7)
    words = [a + b for a in ("load", "open", "close", "user", "Row", "cache", "Token", "HTTP") for b in ("", "Ids", "_page", "Server", "ing", "2")] + [f"w{n}" for n in range(200)]
    rows = []
    for n in range(1500):
        text = rows[n - 1][9] if n % 5 == 4 else " ".join(r.choices(words, k=80))
        rows.append((str(uuid.UUID(int=r.getrandbits(128))), "r", f"src/part{n % 7}/file-{n % 50}.py", "python", "symbol", "function", f"Name{n % 90}.open_{n % 11}", n, n + 3, text))
    rows[10] = (*rows[10][:9], "cache " * 300)
    rows[11] = (*rows[11][:9], "= ( ) é ü")
    rows[12] = (*rows[12][:9], None)
    return spark.createDataFrame([*rows, rows[20]], CHUNK).repartition(5)


def test_an_index_is_written_once(spark, many, tmp_path):
    """Neither tokens nor postings are kept besides, and postings take less than half of their text."""
    before = set(os.listdir(shared_dir(spark)))
    root = str(tmp_path / "i")
    manifest = search_index.build_index(many, root)
    assert set(os.listdir(shared_dir(spark))) == before
    text = many.dropDuplicates(["id"]).agg(F.sum(F.octet_length("content"))).first()[0]
    assert _size(os.path.join(root, manifest["version"], "postings")) < text / 2
    assert manifest["chunks"] == 1500 and manifest["chunks_by_type"] == {"symbol": 1500}
    lists = many.dropDuplicates(["id"]).select(chunk_index_tokens(many).alias("t"))
    assert manifest["average_length"] == round(lists.agg(F.avg(F.size("t"))).first()[0], 2)
    want = {r["term"]: r["df"] for r in lists.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    assert {r["term"]: r["df"] for r in search_index.IndexCache().load(spark, root).terms.collect()} == want


def test_words_as_the_tokenizer_has_them(spark):
    texts = ["getUserByID HTTPServer2 parse_JSONFile __init__ a b2 classes boxes glasses flies running used is", "٣٤ 12ab3 ab٣ Ünder naïve x_1__Y", "A" * 41 + " " + "b" * 40, "", None, "the-of/and it's i18n\r\nDONE tries_Passes addresses"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("want")).collect()
    for r in rows:
        assert [x for w in postings._WORD.findall(r["t"] or "") for x in postings.word_terms(w)] == r["want"]


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_blocks_rank_as_all_pairs(spark, many, tmp_path_factory, k):
    """Equal scores go by id over all blocks; a query asked in words that nothing holds has no rows."""
    root = str(tmp_path_factory.mktemp("ranked"))
    search_index.build_index(many, root)
    index = search_index.IndexCache().load(spark, root)
    assert index.postings.filter("term is null").count() > 1
    asked = spark.createDataFrame([(1, "openIds cache"), (2, "Name7 open_3 file"), (3, "zzz"), (4, "w5 w5 w17 token server"), (5, None)], "query_id int, query string")
    docs = many.dropDuplicates(["id"])
    docs = docs.select(F.col("id").alias("doc_id"), chunk_index_text(docs).alias("text"))
    got, want = index.bm25(asked, k).collect(), retrieval.bm25(docs, asked, k).collect()
    assert {r["query_id"] for r in got} == {1, 2, 4} and len(got) == len(want)
    if k <= 10:
        assert {(r["query_id"], r["rank"]): r["doc_id"] for r in got} == {(r["query_id"], r["rank"]): r["doc_id"] for r in want}
    scores = lambda rows: {(r["query_id"], r["doc_id"]): r["score"] for r in rows}
    assert scores(got) == pytest.approx(scores(want), abs=5e-4)  # the index's average length has two digits
    assert search_index.IndexCache().load(spark, root).bm25(asked.filter("query_id = 3"), k).isEmpty()


def test_a_search_keeps_its_results_only(spark, many, tmp_path):
    """Vectors are written once, in the version; of the phases' tables the results alone stay."""
    root = str(tmp_path / "s")
    before = set(os.listdir(shared_dir(spark)))
    search_index.build_index(many, root, None, search_index.HashingProvider())
    assert set(os.listdir(shared_dir(spark))) == before
    asked = spark.createDataFrame([(1, "openIds cache"), (2, "token server")], "query_id int, query string")
    found = search_index.SearchService(spark).search(root, asked).results
    left = set(os.listdir(shared_dir(spark))) - before
    assert [x.rsplit("-", 1)[0] for x in left] == ["search-hydrate"] and found.count() == 20


def test_vectors_tie_by_id_over_batches(spark):
    """What a task held back of a query is never among its best: scores equal to six digits go by id."""
    r = random.Random(3)
    docs = spark.createDataFrame([(f"{r.getrandbits(40):010x}", [r.choice((0.6, 0.6000000004, -0.8)), 0.0, 0.8, *[0.0] * 29]) for _ in range(400)], "doc_id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0] + [0.0] * 31), (2, [0.1] * 32)], "query_id int, embedding array<double>")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = {(x["query_id"], x["rank"]): (x["doc_id"], x["score"]) for x in retrieval.dense(docs, asked, 7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = docs.collect()
    for q in asked.collect():
        every = sorted((-round(sum(a * b for a, b in zip(q["embedding"], d["embedding"])), 6), d["doc_id"]) for d in rows)
        assert [got[q["query_id"], n + 1] for n in range(7)] == [(d, -s) for s, d in every[:7]]
