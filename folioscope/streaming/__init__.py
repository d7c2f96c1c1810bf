"""The layout operators on streams of documents: nothing crosses documents, so each micro-batch is complete in itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources.layout import schema


def stream_layout(spark: SparkSession, path: str, table: str, files: int = 100, fmt: str = "parquet") -> DataFrame:
    """A layout table as a stream of files, `files` a batch at most."""
    return spark.readStream.schema(schema(table)).format(fmt).option("maxFilesPerTrigger", files).load(path)


def run_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """operator on every micro-batch, appended to Parquet under the batch's number, so that a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
