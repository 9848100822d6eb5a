"""What can be replaced: analyzers, embedding providers, vector stores and retrievers, each with the one that comes along.

Rerankers are functions of columns, see retrieval.RERANKERS.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import ecmascript_analysis, python_analysis, retrieval


class LanguageAnalyzer(ABC):
    """Symbols, imports and calls of the files of some languages."""

    languages: tuple[str, ...] = ()

    @abstractmethod
    def analyze(self, files: DataFrame) -> DataFrame:
        """One row for each (repository_id, path, content) file, with arrays of what it holds."""


class PythonAnalyzer(LanguageAnalyzer):
    languages = ("python",)

    def analyze(self, files: DataFrame) -> DataFrame:
        return python_analysis.analyze_python(files)


class ScriptAnalyzer(LanguageAnalyzer):
    languages = ("javascript", "typescript", "tsx")

    def analyze(self, files: DataFrame) -> DataFrame:
        return ecmascript_analysis.analyze_ecmascript(files)


class EmbeddingProvider(ABC):
    """Vectors of documents and queries. query_prefix goes before each query; max_chars, where set, keeps so much of a text."""

    model_id = ""
    dimensions = 0
    query_prefix = ""
    max_chars: int | None = None

    @abstractmethod
    def embed_documents(self, docs: DataFrame) -> DataFrame:
        """(doc_id, embedding) of (doc_id, text) rows, vectors of length one."""

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        """(query_id, embedding) of (query_id, query) rows."""
        text = F.concat(F.lit(self.query_prefix), F.coalesce("query", F.lit("")))
        return self.embed_documents(queries.select(F.col("query_id").alias("doc_id"), text.alias("text"))).withColumnRenamed("doc_id", "query_id")


class HashingProvider(EmbeddingProvider):
    """Signed feature hashing of tokens; the same everywhere, nothing to be loaded."""

    model_id = "hashing-256"
    dimensions = 256

    def embed_documents(self, docs: DataFrame) -> DataFrame:
        return retrieval.embed_documents(docs, max_chars=self.max_chars)


class VectorStore(ABC):
    """Vectors by id."""

    @abstractmethod
    def add(self, vectors: DataFrame) -> None: ...

    @abstractmethod
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    @abstractmethod
    def save(self, path: str) -> None: ...

    @abstractmethod
    def size(self) -> int: ...


class FlatStore(VectorStore):
    """All vectors compared exactly."""

    def __init__(self, vectors: DataFrame | None = None):
        self.vectors = vectors

    def add(self, vectors: DataFrame) -> None:
        more = vectors.select("doc_id", "embedding")
        self.vectors = more if self.vectors is None else self.vectors.unionByName(more)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.dense(self.vectors, queries, k)

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(path)

    def size(self) -> int:
        return 0 if self.vectors is None else self.vectors.count()


class Retriever(ABC):
    """Ranked rows (query_id, doc_id, score, rank) for (query_id, query) rows."""

    @abstractmethod
    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...
