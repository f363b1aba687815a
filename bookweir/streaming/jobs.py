"""Running streams: per-result callbacks, extraction of new pages, drained runs."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from bookweir.operators.books import extract_books
from bookweir.session import use_checkpoint_dir

_log = logging.getLogger(__name__)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared checkpoint folder."""
    return f"{use_checkpoint_dir(spark)}/bookweir-{name}-{uuid.uuid4().hex}"


def stream_table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, per_trigger: int = 64
) -> DataFrame:
    """Files of one table as they land in `folder`."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )


def on_results(
    results: DataFrame, folder: str, callback: Callable[[DataFrame, int], None] | None = None
) -> DataStreamWriter:
    """Write every new batch of results below `folder`, then call back with what was written.

    A failed write fails the batch, which is run again; an error in the callback is
    logged and the stream goes on. A repeated batch replaces itself.
    """

    def call(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if callback is None:
            return
        try:
            callback(batch.sparkSession.read.schema(batch.schema).parquet(path), batch_id)
        except Exception:
            _log.exception("callback failed for batch %s", batch_id)

    return results.writeStream.foreachBatch(call)


def extract_new_pages(pages: DataFrame) -> DataFrame:
    """Books of new pages as a stream.

    Extraction never leaves a page's row, so the batch job runs on a stream as
    it is; `links` does too.
    """
    return extract_books(pages)


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run a stream over everything that has landed, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained_table(stream: DataFrame, name: str) -> DataFrame:
    """Rows a stream appends for everything that has landed, as a table."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    drain(stream.writeStream.format("parquet").option("path", f"{folder}/rows"), f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drained_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Last row per key of a stream in update mode, after everything that has landed."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    drain(stream.writeStream.outputMode("update").foreachBatch(write), f"{folder}/state")
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")


def drained_snapshot(stream: DataFrame, name: str) -> DataFrame:
    """Last state of a running aggregate after everything that has landed."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        latest[0] = batch_id

    latest = [None]
    drain(stream.writeStream.outputMode("complete").foreachBatch(replace), f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch={latest[0]}")
