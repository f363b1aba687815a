"""The whole path of a crawl as one job: requests and fetches in, results and their statistics out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweir.operators import outcomes
from bookweir.operators.books import completeness, extract_books
from bookweir.sources.requests import expand_requests, validate_requests

# Fixed value: how the message of a result without a readable page begins.
EXTRACTION_FAILED = "Book data extraction failed: the page can't be read"


def scrape_results(fetches: DataFrame) -> DataFrame:
    """One result per fetch: status, error fields, size and book.

    `fetches` has page_id, url, source, http_status, exception_class, html and
    any further columns. The pages are read once and the raw text is dropped
    there, so no later step moves it.
    """
    judged = outcomes.error_fields(outcomes.classify_fetch(fetches.withColumn("body", F.col("html")))).drop("body")
    sized = judged.withColumn("data_size_bytes", F.octet_length("html").cast("bigint"))
    readable = (F.col("status") == "success") & (F.col("data_size_bytes") > 0)
    found = extract_books(sized.withColumn("html", F.when(readable, F.col("html"))), unreadable="_unreadable")
    lacking = (F.col("status") == "success") & (F.col("data_size_bytes") > 0) & F.col("metadata").isNull()
    reason = F.when(lacking & F.col("_unreadable"), F.lit(EXTRACTION_FAILED)).otherwise(F.col("error_message"))
    found = found.withColumn("error_message", reason).drop("_unreadable")
    return found.withColumn("status", F.when(lacking, "partial").otherwise(F.col("status"))).withColumn(
        "data_completeness", F.when(F.col("metadata").isNotNull(), completeness()).otherwise(F.lit(0.0))
    )


def scrape_batch(requests: DataFrame, fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of the accepted tasks, and the rejected tasks with reasons.

    `fetches` names the task it belongs to by request_id and pos, so a URL that
    was asked for many times never meets its copies. Tasks meet results after
    extraction, when a row is small. A fetch of a rejected task is no result, so only those of accepted
    ones are extracted; told by their two key columns, before pages that `fetches` joins meet them.
    A task without a fetch has a null status.
    Any other column that both have keeps its name in the results and is `task_...` of the task.
    """
    accepted, rejected = validate_requests(expand_requests(requests))
    # Null-safe, so that the optimizer adds no filter of its own and both joins read the tasks that are shuffled once.
    keys = accepted.select(F.col("request_id").alias("_request_id"), F.col("pos").alias("_pos"))
    same = F.col("request_id").eqNullSafe(F.col("_request_id")) & F.col("pos").eqNullSafe(F.col("_pos"))
    wanted = fetches.join(keys, same, "left_semi")
    results = scrape_results(wanted).drop("source", "url")
    clashing = (set(accepted.columns) & set(results.columns)) - {"request_id", "pos"}
    accepted = accepted.withColumnsRenamed({name: f"task_{name}" for name in clashing})
    return accepted.join(results, ["request_id", "pos"], "left"), rejected
