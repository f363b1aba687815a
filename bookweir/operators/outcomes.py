"""Fetch outcomes: status, error fields, sizes, ids, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweir.functions.times import epoch_micros, epoch_millis
from bookweir.schemas import ENABLED_SOURCES, SOURCES

BODY_CHARS_IN_MESSAGE = 200


def fetch_status() -> Column:
    """2xx without an exception is a success, anything else a failure."""
    fetched = F.col("exception_class").isNull() & F.col("http_status").between(200, 299)
    return F.when(F.coalesce(fetched, F.lit(False)), F.lit("success")).otherwise(F.lit("failed"))


def classify_fetch(log: DataFrame) -> DataFrame:
    return log.withColumn("status", fetch_status())


def error_fields(log: DataFrame) -> DataFrame:
    """`error_code` and `error_message` of failed fetches, null for successful ones.

    `body` is the response text; `exception_message`, if there is one, the text
    of the exception.
    """
    status = F.col("http_status").cast("string")
    raised = F.col("exception_class").isNotNull()
    message = F.col("exception_message") if "exception_message" in log.columns else F.lit(None).cast("string")
    http_message = F.concat(
        F.lit("HTTP "), status, F.lit(": "), F.substring(F.coalesce("body", F.lit("")), 1, BODY_CHARS_IN_MESSAGE)
    )
    failed = fetch_status() == "failed"
    return log.withColumn(
        "error_code", F.when(failed, F.when(raised, F.col("exception_class")).otherwise(F.concat(F.lit("HTTP_"), status)))
    ).withColumn("error_message", F.when(failed, F.when(raised, message).otherwise(http_message)))


def payload_size(fetches: DataFrame, body: str = "body", start: str = "started_at", end: str = "ended_at") -> DataFrame:
    """UTF-8 size of the body and latency in milliseconds."""
    micros = epoch_micros(F.col(end)) - epoch_micros(F.col(start))
    return fetches.withColumn("data_size_bytes", F.octet_length(body).cast("bigint")).withColumn(
        "response_time_ms", micros / 1000
    )


def completed(results: DataFrame, reference_lists: bool = False) -> DataFrame:
    """Results that did not fail; with `reference_lists` every result that was returned at all."""
    return results if reference_lists else results.filter(F.col("status") != "failed")


def failed(results: DataFrame, reference_lists: bool = False) -> DataFrame:
    """Failed results; with `reference_lists` none, since failures are returned as values there."""
    return results.filter(F.lit(False) if reference_lists else F.col("status") == "failed")


def outcomes(done: DataFrame, lost: DataFrame) -> DataFrame:
    """Completed and failed results as one set."""
    return done.unionByName(lost, allowMissingColumns=True)


def results_with_books(results: DataFrame, books: DataFrame) -> DataFrame:
    """Attach the extracted book (null: none) by page."""
    found = books.select("page_id", F.struct(*[c for c in books.columns if c != "page_id"]).alias("book"))
    return results.join(found, "page_id", "left")


def finalize_status(results: DataFrame, books: DataFrame) -> DataFrame:
    """Status after extraction: a fetched body without a book is `partial`.

    An empty body stays `success` with a null book.
    """
    has_body = F.coalesce(F.col("data_size_bytes") > 0, F.lit(False))
    lacking = (F.col("status") == "success") & has_body & F.col("book").isNull()
    return results_with_books(results, books).withColumn(
        "status", F.when(lacking, F.lit("partial")).otherwise(F.col("status"))
    )


def with_ids(results: DataFrame, ts: str = "ts", *unique: str) -> DataFrame:
    """`result_id` `<source>_<epoch ms>` and a collision-free `result_key`.

    `unique` names the columns that tell two results of one source and
    millisecond apart.
    """
    readable = F.concat(F.col("source"), F.lit("_"), epoch_millis(F.col(ts)).cast("string"))
    parts = [F.col("source"), epoch_micros(F.col(ts)).cast("string"), *[F.col(c).cast("string") for c in unique]]
    return results.withColumn("result_id", readable).withColumn("result_key", F.sha2(F.concat_ws("|", *parts), 256))


def source_catalog(results: DataFrame, enabled: str | list[str] = ENABLED_SOURCES) -> DataFrame:
    """Every known source with its enabled flag and observed rows.

    `enabled` is a list or the comma-separated setting.
    """
    names = enabled.split(",") if isinstance(enabled, str) else list(enabled)
    spark = results.sparkSession
    sources = spark.createDataFrame([(name, name in names) for name in SOURCES], "source string, enabled boolean")
    seen = results.groupBy("source").agg(F.count("*").alias("rows"))
    return sources.join(seen, "source", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
