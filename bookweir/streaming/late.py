"""Rows that come too late for the windows of a stream, kept and counted instead of lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from bookweir.functions.times import epoch_micros, interval_micros
from bookweir.streaming.counters import WATERMARK


def split_late(results: DataFrame, folder: str, watermark: str = WATERMARK, ts: str = "ts") -> DataStreamWriter:
    """Write every trigger's rows below `folder`, told apart by whether they are late.

    A row is late if its time lies before the latest time of all earlier triggers less the
    watermark; a row without a time never is. What isn't late can go on to windows with the same
    watermark, which then drop nothing. Each trigger saves the latest time so far beside its
    rows, so a restarted stream goes on from there and a repeated trigger replaces itself.
    """
    delay = interval_micros(watermark)

    def call(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, None
        if batch_id:
            seen = spark.read.schema("seen long").parquet(f"{folder}/seen/{batch_id - 1}").collect()[0].seen
        at = epoch_micros(F.col(ts))
        late = F.lit(False) if seen is None else F.coalesce(at < F.lit(seen - delay), F.lit(False))
        path = f"{folder}/rows/batch={batch_id}"
        batch.withColumn("late", late).write.mode("overwrite").parquet(path)
        written = spark.read.schema(batch.schema).parquet(path)
        latest = written.agg(F.greatest(F.max(at), F.lit(seen).cast("long")).alias("seen"))
        latest.write.mode("overwrite").parquet(f"{folder}/seen/{batch_id}")

    return results.writeStream.foreachBatch(call)


def split_rows(spark: SparkSession, folder: str, results: DataFrame) -> DataFrame:
    """All rows that `split_late` has written, with `late` and the trigger's `batch`."""
    schema = results.schema.add("late", "boolean").add("batch", "long")
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def late_counts(rows: DataFrame) -> DataFrame:
    """Rows and late rows per source, as a counter beside those of the metrics."""
    return rows.groupBy("source").agg(F.count("*").alias("requests"), F.count_if("late").alias("late"))
