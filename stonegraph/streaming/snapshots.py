"""Incremental reading: files that arrived since the last run, by a file stream that stops when it has caught up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def catch_up(spark: SparkSession, source: str, *, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, pattern: str = "*.parquet", files_a_batch: int = 1000) -> DataFrame:
    """Runs ``transform`` over the Parquet files of ``source`` not yet read and appends the rows to ``sink``; returns all of the sink.

    ``checkpoint`` remembers what was read; both folders should be shared by
    the cluster. ``transform`` must be one that a stream allows (no state is
    added here).
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return spark.read.parquet(sink)
