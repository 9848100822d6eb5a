"""Structured Streaming sinks: a repository's rows replaced batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def replace_partitions(df: DataFrame, path: str, key: str = "repository_id") -> None:
    """Replace exactly the partitions that df holds; a batch delivered twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def reindexing(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "repository_id") -> DataStreamWriter:
    """A writer that rebuilds the repositories of each micro-batch and replaces their rows."""

    def each(batch: DataFrame, _: int) -> None:
        replace_partitions(build(batch), path, key)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def latest_status(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(job_id, latest): each job's newest status, for update-mode sinks; late events within the delay count."""
    return events.withWatermark("updated_at", delay).groupBy(F.col("id").alias("job_id")).agg(F.max_by(F.struct("status", "stage"), "updated_at").alias("latest"))
