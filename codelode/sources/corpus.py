"""Reading source trees and writing versioned indexes."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.languages import ignored, language_of
from codelode.session import dropping_shuffles

MAX_FILE_BYTES = 1024 * 1024


def source_tree(spark: SparkSession, root: str, repository_id: str = "") -> DataFrame:
    """(repository_id, path, size_bytes, bytes) of every file below root outside ignored directories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:") + "/"
    path = F.substring_index(F.regexp_replace("path", r"^file:/+", "/"), base, -1)
    rows = files.select(F.lit(repository_id).alias("repository_id"), path.alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("bytes"))
    return rows.filter(~ignored(F.col("path")))


def readable(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files within the size limit without a NUL in their first 8192 bytes, as text with replacement of bad bytes."""
    binary = F.contains(F.substring("bytes", 1, 8192), F.lit(bytearray(b"\0")))
    return files.filter((F.col("size_bytes") <= max_bytes) & ~binary).withColumn("content", F.make_valid_utf8(F.col("bytes").cast("string")))


def index_rows(files: DataFrame) -> DataFrame:
    """(repository_id, path, language, size_bytes, line_count, content_sha256) of readable files."""
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = ((F.col("size_bytes") > 0) & ~F.endswith(text, F.lit("\n"))).cast("int")
    return files.select("repository_id", "path", language_of(F.col("path")).alias("language"), "size_bytes", (ends + open_end).cast("int").alias("line_count"), F.sha2("bytes", 256).alias("content_sha256"))


def _path(spark: SparkSession, *parts: str):
    """(file context, path) of a name on whatever file system it lies."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(*parts))
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()), path


def _write_text(spark: SparkSession, text: str, *parts: str) -> None:
    fs = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(*parts)).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(*parts)), True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def _read_text(spark: SparkSession, *parts: str) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(*parts))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    held = fs.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    held.close()
    return text


def write_table(df: DataFrame, root: str, version: str, name: str) -> DataFrame:
    """One table of a version that the manifest doesn't name yet, read back."""
    path = os.path.join(root, version, name)
    with dropping_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_version(tables: dict[str, DataFrame], root: str, manifest: dict, spark: SparkSession | None = None, version: str | None = None) -> str:
    """Write tables as one new version and switch the manifest to it last; readers see the old or the new one whole.

    root may lie on any file system that Spark reaches. version: where some of its tables are written already.
    """
    version = version or uuid.uuid4().hex
    for name, df in tables.items():
        write_table(df, root, version, name)
    spark = spark or next(iter(tables.values())).sparkSession
    _write_text(spark, json.dumps(manifest | {"version": version}), root, f"{version}.json")
    context, new = _path(spark, root, f"{version}.json")
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    context.rename(new, _path(spark, root, "manifest.json")[1], how)
    return version


def read_manifest(root: str, spark: SparkSession | None = None) -> dict | None:
    """The manifest, None where there is none or it can't be read."""
    spark = spark or SparkSession.getActiveSession()
    try:
        text = _read_text(spark, root, "manifest.json")
        found = json.loads(text) if text else None
        return found if isinstance(found, dict) else None
    except ValueError:
        return None


def read_version(spark: SparkSession, root: str, table: str) -> DataFrame:
    manifest = read_manifest(root, spark)
    if not manifest:
        raise FileNotFoundError("index_not_built")
    return spark.read.parquet(os.path.join(root, manifest["version"], table))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant) of a JSON list of cases, bare or under `queries`."""
    with open(path) as f:
        cases = json.load(f)
    cases = cases["queries"] if isinstance(cases, dict) else cases
    rows = [(k, c["query"], list(c.get("relevant_files", []))) for k, c in enumerate(cases)]
    return spark.createDataFrame(rows, "query_id int, query string, relevant array<string>")


def parse_jsonc(text: str | None) -> dict | list | None:
    """JSON with comments and trailing commas outside strings; None where it is invalid."""
    if text is None:
        return None
    token = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|,(?=\s*(?:(?://[^\n]*\s*|/\*.*?\*/\s*)*)[\]}])', re.S)
    try:
        return json.loads(token.sub(lambda m: m.group() if m.group()[0] == '"' else " ", text))
    except ValueError:
        return None
