"""Scrape requests: expansion to tasks, validation, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweir.functions.times import epoch_millis
from bookweir.functions.urls import is_http_url
from bookweir.schemas import REQUEST_RANGES, SOURCES


def expand_requests(requests: DataFrame) -> DataFrame:
    """One task row per URL, carrying every other request column."""
    rest = [name for name in requests.columns if name != "urls"]
    return requests.select(*rest, F.posexplode("urls").alias("pos", "url"))


def request_reasons() -> F.Column:
    """Reasons to reject a task row, an empty array if none."""
    low, high = REQUEST_RANGES["priority"]
    return F.array_compact(
        F.array(
            F.when(~is_http_url("url"), F.lit("url is no http url")),
            F.when(~F.coalesce(F.col("source").isin(SOURCES), F.lit(False)), F.lit("unknown source")),
            F.when(~F.coalesce(F.col("priority").between(low, high), F.lit(False)), F.lit("priority out of range")),
        )
    )


def validate_requests(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into accepted tasks and rejected ones with `reasons`."""
    checked = tasks.withColumn("reasons", request_reasons())
    bad = F.size("reasons") > 0
    return checked.filter(~bad).drop("reasons"), checked.filter(bad)


def request_summary(tasks: DataFrame) -> DataFrame:
    """Receipt per request: task count, source, priority and the task ids.

    The id list is as long as the request's own URL list, which was one row.
    """
    ids = F.sort_array(F.collect_list(F.struct("pos", "task_id")))
    grouped = tasks.groupBy("request_id", "source", "priority").agg(
        F.count("*").alias("task_count"), F.transform(ids, lambda t: t["task_id"]).alias("task_ids")
    )
    return grouped.select(
        "request_id",
        F.concat(F.lit("batch_"), F.col("task_count").cast("string")).alias("job_id"),
        "task_count",
        F.lit("started").alias("status"),
        F.format_string("Started scraping %d URLs from %s", "task_count", "source").alias("message"),
        "source",
        "priority",
        "task_ids",
    )


def attach_context(batch: DataFrame, ts: str = "ts") -> DataFrame:
    """Pair `urls` with `job_ids` and `sources` by position; gaps get a batch id / `unknown`."""
    millis = epoch_millis(F.col(ts)).cast("string")
    pos = F.col("pos")
    rows = batch.select("*", F.posexplode("urls").alias("pos", "url"))
    given_job = F.nullif(F.get("job_ids", pos), F.lit(""))
    given_source = F.nullif(F.get("sources", pos), F.lit(""))
    rest = [name for name in batch.columns if name not in ("urls", "job_ids", "sources")]
    return rows.select(
        *rest,
        "pos",
        "url",
        F.coalesce(given_job, F.concat_ws("_", F.lit("batch"), millis, pos.cast("string"))).alias("job_id"),
        F.coalesce(given_source, F.lit("unknown")).alias("source"),
    )
