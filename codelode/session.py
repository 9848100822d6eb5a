"""Session, shared-folder and physical-plan helpers used by every module."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that any operator of this package broadcasts by hint.
BROADCAST_BYTES = 8 << 20


def local_session(cores: str = "*", shuffle: int = 8, app: str = "codelode", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet carries its own schema, nothing is inferred from rows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where that setting is absent and the master is local (tests), the machine is the whole
    cluster, and a folder of it is made and set. Elsewhere its absence is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if path:
        if have.isEmpty():
            sc.setCheckpointDir(path)
        return path
    if not have.isEmpty():
        return have.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="codelode-")
    sc.setCheckpointDir(path)
    return path


_WRITTEN: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def _remove_all() -> None:
    """What the process wrote goes when it ends, if its session still runs then."""
    try:
        spark = SparkSession.getActiveSession()
        for path in list(_WRITTEN) if spark is not None else ():
            _remove(spark, path)
    except Exception:  # noqa: BLE001 - the gateway may be gone already
        pass


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet into the shared folder and read back.

    Cheaper than checkpoint() for wide rows (columnar, compressed) and it survives
    the loss of any executor. The table stays until it is discarded or the process ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads, nor any DataFrame that is handed out."""
    for df in tables:
        _remove(df.sparkSession, df._written_at)


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written within leave no shuffle files behind; else these stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver was started from. Once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_codelode_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="codelode-"), "codelode.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("codelode", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._codelode_shipped = True


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where Catalyst's estimate is below the limit."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


#: Inputs estimated below this many bytes are dealt out to all cores before heavy row work.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is so small that it would be read as one split.

    Larger inputs come in enough splits and stay as they are.
    """
    if estimated_bytes(df) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once_by_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key, however often a row was delivered.

    Rows whose key is null stay, each on its own. Copies are dropped map-side
    before the shuffle, so a key that holds a third of all rows costs nothing.
    """
    mark = "__row__"
    kept = df.withColumn(mark, F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates([key, mark]).drop(mark)


def once_in_place(df: DataFrame, key: str = "id") -> DataFrame:
    """As once_by_id, but wide rows stay where they are while the copies are few.

    Over keys alone it is found at which places (file and row) copies stand; these places are
    left out of the scan by a broadcast if they take BROADCAST_BYTES at most, and beyond that,
    or where df is no scan of files, rows are dropped by a shuffle.
    """
    try:
        placed = df.select("*", F.xxhash64(F.col("_metadata.file_path")).alias("__file__"), F.col("_metadata.row_index").alias("__at__"))
    except AnalysisException:
        return once_by_id(df, key)
    keys = placed.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.struct("__file__", "__at__").alias("place"))
    first = keys.groupBy("k").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select("k", "first")
    copies = materialise(keys.join(first, "k").filter("place <> first").select("place.*"), "copies")
    if copies.count() * 64 > BROADCAST_BYTES:
        return once_by_id(df, key)
    return placed.join(F.broadcast(copies), ["__file__", "__at__"], "left_anti").drop("__file__", "__at__")
