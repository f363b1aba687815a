"""Run and job statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweir.functions.times import epoch_micros


def _ratio(count: Column, total: Column) -> Column:
    """`count / total` with a denominator of at least one."""
    return count / F.greatest(F.lit(1.0), total.cast("double"))


def run_stats(results: DataFrame, now: Column | None = None, outside_fetch: Column | None = None) -> DataFrame:
    """Uptime, totals, success rate and request rate of a run.

    `status` is the fetch status, before extraction. Uptime runs from the first
    result to `now`, by default the last result. Rows marked `outside_fetch`
    (errors raised around the fetch) count as failed but not as requests.
    """
    outside = F.coalesce(outside_fetch, F.lit(False)) if outside_fetch is not None else F.lit(False)
    micros = epoch_micros(F.col("ts"))
    end = epoch_micros(now) if now is not None else F.max(micros)
    counted = results.agg(
        ((end - F.min(micros)) / 1e6).alias("uptime_seconds"),
        F.count_if(~outside).alias("total_requests"),
        F.count_if(~outside & (F.col("status") == "success")).alias("successful_requests"),
        F.count_if(outside | (F.col("status") != "success")).alias("failed_requests"),
    )
    return counted.withColumns(
        {
            "success_rate": _ratio(F.col("successful_requests"), F.col("total_requests")),
            "requests_per_second": _ratio(F.col("total_requests"), F.col("uptime_seconds")),
        }
    )


def throughput(results: DataFrame, now: Column | None = None) -> DataFrame:
    """The gauges rps, success rate and uptime as (metric, value) rows; none before any uptime."""
    stats = run_stats(results, now).filter(F.col("uptime_seconds") > 0)
    names = ["uptime_seconds", "requests_per_second", "success_rate"]
    return stats.select([F.col(name).cast("double") for name in names]).unpivot([], names, "metric", "value")


def job_status(results: DataFrame) -> DataFrame:
    """Totals and success rate per job."""
    counted = results.groupBy("job_id").agg(
        F.count("*").alias("total_tasks"),
        F.count_if(F.col("status") != "failed").alias("completed_tasks"),
        F.count_if(F.col("status") == "failed").alias("failed_tasks"),
    )
    return counted.withColumn("success_rate", _ratio(F.col("completed_tasks"), F.col("total_tasks")))


def job_performance(results: DataFrame, order: tuple[str, ...] = ("ts", "log_id")) -> DataFrame:
    """Mean response time, duration, last error and error count per job.

    Keeping a text per job takes a sorting aggregate, so the last error is
    looked for among the failed rows only; all other figures are hashed.
    """
    micros = epoch_micros(F.col("ts"))
    ended = micros + F.round(F.col("response_time_ms") * 1000).cast("bigint")
    figures = results.groupBy("job_id").agg(
        F.avg("response_time_ms").alias("average_response_time_ms"),
        ((F.max(ended) - F.min(micros)) / 1e6).alias("total_duration_seconds"),
        F.count("error_code").alias("error_count"),
    )
    errors = results.filter(F.col("error_code").isNotNull())
    last = errors.groupBy("job_id").agg(F.max_by("error_code", F.struct(*order)).alias("last_error"))
    return figures.join(last, "job_id", "left")
