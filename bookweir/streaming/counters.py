"""Metrics kept up to date on a stream of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweir.operators.metrics import BYTES_BOUNDS, SECONDS_BOUNDS, rate_step, rates_of_steps, step_counts

WATERMARK = "10 minutes"


def _cell(prefix: str, bound: float) -> str:
    return f"{prefix}_{bound}".replace(".", "_")


def stream_step_counts(
    results: DataFrame, length: str = "5 minutes", slide: str = "10 seconds", watermark: str = WATERMARK
) -> DataFrame:
    """Results by (step, source, status) on a stream; rows later than the watermark are dropped.

    One count per step, from which `rates_of_steps` makes the sliding windows, open ones
    too, wherever they are read. Run it in update mode.
    """
    timed = results.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return step_counts(timed, rate_step(length, slide)).select(
        F.col("step.start").cast("timestamp_ntz").alias("start"), "source", "status", "n"
    )


def stream_request_rate(counts: DataFrame, length: str = "5 minutes", slide: str = "10 seconds") -> DataFrame:
    """Sliding request rate by (source, status) from the latest counts by step."""
    return rates_of_steps(counts.withColumn("step", F.struct("start")), length, slide)


def stream_counters(results: DataFrame) -> DataFrame:
    """One running row per (source, status, error type) holding every counter and bucket.

    The state is as small as the label sets; `metric_rows` turns a snapshot of it
    into the metric tables.
    """
    seconds, size = F.col("response_time_ms") / 1000, F.col("data_size_bytes")
    return results.groupBy("source", "status", F.col("error_code").alias("error_type")).agg(
        F.count("*").alias("requests"),
        F.sum(seconds).alias("seconds_sum"),
        F.count("response_time_ms").alias("seconds_count"),
        *[F.count_if(seconds <= b).alias(_cell("seconds", b)) for b in SECONDS_BOUNDS],
        F.sum(size).cast("double").alias("bytes_sum"),
        F.count("data_size_bytes").alias("bytes_count"),
        *[F.count_if(size <= b).alias(_cell("bytes", b)) for b in BYTES_BOUNDS],
        F.count_if("has_book").alias("books"),
    )


def _histogram_rows(snapshot: DataFrame, metric: str, prefix: str, labels: list[str], bounds: list) -> DataFrame:
    cells = {str(b): F.sum(_cell(prefix, b)) for b in bounds}
    cells["+Inf"] = F.sum(f"{prefix}_count")
    grouped = snapshot.groupBy(*labels).agg(
        *[value.cast("double").alias(le) for le, value in cells.items()],
        F.sum(f"{prefix}_sum").alias("sum"),
        F.sum(f"{prefix}_count").cast("double").alias("count"),
    )
    return grouped.unpivot(labels, [f"`{name}`" for name in [*cells, "sum", "count"]], "le", "value").select(
        F.lit(metric).alias("metric"), *_labels(labels), "le", "value"
    )


def _labels(labels: list[str]):
    return [
        (F.col(name) if name in labels else F.lit(None).cast("string")).alias(name)
        for name in ("source", "status", "error_type")
    ]


def metric_rows(snapshot: DataFrame) -> DataFrame:
    """A snapshot of `stream_counters` as (metric, labels, le, value) rows.

    `le` is null for counters; for histograms it is a bound, `sum` or `count`.
    """

    def counter(metric: str, value: str, labels: list[str], rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy(*labels).agg(F.sum(value).cast("double").alias("value"))
        return grouped.select(
            F.lit(metric).alias("metric"), *_labels(labels), F.lit(None).cast("string").alias("le"), "value"
        )

    failed = F.col("status") == "failed"
    parts = [
        counter("requests_total", "requests", ["source", "status"], snapshot),
        counter("success_total", "requests", ["source"], snapshot.filter(F.col("status") == "success")),
        counter("failure_total", "requests", ["source", "error_type"], snapshot.filter(failed)),
        counter("books_extracted_total", "books", ["source"], snapshot.filter("books > 0")),
        _histogram_rows(snapshot, "request_duration_seconds", "seconds", ["source", "status"], SECONDS_BOUNDS),
        _histogram_rows(snapshot, "data_size_bytes", "bytes", ["source"], BYTES_BOUNDS),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows
