"""Row-local operators on streams: the same column functions over ``readStream``, append mode, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.serving import converted, micro_batch

__all__ = ["converted", "micro_batch", "read_documents", "write_responses"]


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def write_responses(stream: DataFrame, path: str, checkpoint: str):
    """What has arrived, answered once and appended as Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
