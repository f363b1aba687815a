"""Counters, histograms and gauges as tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweir.functions.times import epoch_micros, from_micros, interval_micros

# Histogram bounds.
SECONDS_BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]
BYTES_BOUNDS = [100, 1000, 10000, 100000, 1000000]

_SECOND, _DAY = 1_000_000, 86_400_000_000


def _counter(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("value"))


def requests_total(results: DataFrame) -> DataFrame:
    return _counter(results, "source", "status")


def success_total(results: DataFrame) -> DataFrame:
    return _counter(results.filter(F.col("status") == "success"), "source")


def failure_total(results: DataFrame) -> DataFrame:
    rows = results.filter(F.col("status") == "failed")
    return _counter(rows.withColumnRenamed("error_code", "error_type"), "source", "error_type")


def books_extracted(books: DataFrame, source: str = "source") -> DataFrame:
    return _counter(books, source)


def histogram(rows: DataFrame, value: Column, labels: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative buckets with `+Inf`, sum and count per label set.

    One aggregation holds a counter per bound; only its result is unpivoted.
    """
    cells = {str(bound): F.count_if(F.col("_value") <= bound) for bound in bounds}
    cells["+Inf"] = F.count("_value")
    counted = (
        rows.select(*labels, value.alias("_value"))
        .filter(F.col("_value").isNotNull())
        .groupBy(*labels)
        .agg(F.sum("_value").cast("double").alias("sum"), F.count("*").alias("count"), *[c.alias(n) for n, c in cells.items()])
    )
    quoted = [F.col(f"`{name}`") for name in cells]
    return counted.unpivot([*labels, "sum", "count"], quoted, "le", "bucket")


def duration_histogram(results: DataFrame) -> DataFrame:
    return histogram(results, F.col("response_time_ms") / 1000, ["source", "status"], SECONDS_BOUNDS)


def size_histogram(results: DataFrame) -> DataFrame:
    return histogram(results, F.col("data_size_bytes"), ["source"], BYTES_BOUNDS)


def delay_histogram(audited: DataFrame, label: str = "domain") -> DataFrame:
    """Delays of the requests the limiter held back."""
    held = audited.filter(F.col("delay_seconds") > 0)
    return histogram(held, F.col("delay_seconds"), [label], SECONDS_BOUNDS)


def active_requests(results: DataFrame) -> DataFrame:
    """Open requests at every instant at which one starts or ends.

    A request is open during [ts, ts + response time], both ends included.
    """
    started = epoch_micros(F.col("ts"))
    ended = started + F.round(F.col("response_time_ms") * 1000).cast("bigint")
    timed = results.filter(F.col("ts").isNotNull() & F.col("response_time_ms").isNotNull())
    edges = timed.select(
        F.inline(
            F.array(
                F.struct(started.alias("at_us"), F.lit(1).alias("opened"), F.lit(0).alias("closed")),
                F.struct(ended.alias("at_us"), F.lit(0).alias("opened"), F.lit(1).alias("closed")),
            )
        )
    )
    return _levels(edges).select("at_us", "at", (F.col("before") + F.col("opened")).alias("active"))


def queue_sizes(tasks: DataFrame, job: str = "job_id") -> DataFrame:
    """Pending tasks at every instant at which some are queued or started.

    All tasks of a job are queued when its first one starts, and a task leaves the queue at
    its own `ts`. Arrivals are one row per job, so no task meets its job again.
    """
    at = epoch_micros(F.col("ts"))
    timed = tasks.filter(F.col("ts").isNotNull())
    queued = timed.groupBy(job).agg(F.min(at).alias("at_us"), F.count("*").alias("opened"))
    edges = queued.select("at_us", "opened", F.lit(0).alias("closed")).unionByName(
        timed.select(at.alias("at_us"), F.lit(0).alias("opened"), F.lit(1).alias("closed"))
    )
    return _levels(edges).select("at_us", "at", (F.col("before") + F.col("opened") - F.col("closed")).alias("queue_size"))


def _levels(edges: DataFrame) -> DataFrame:
    """How many are open before every instant of `edges` (at_us, opened, closed).

    Edges are summed per instant first. The running sum then goes by calendar -
    days, seconds of a day, instants of a second - so no window sees more than
    the number of days, 86,400 or a million rows, whatever the log holds. The
    three levels share one shuffle of the instants: times are made non-null, or
    the joins would filter each copy in its own way.
    """
    instants = edges.groupBy("at_us").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))

    def unit(time: str, size: int) -> Column:
        return F.coalesce(F.floor(F.col(time) / size), F.lit(0))

    instants = instants.withColumns({"second": unit("at_us", _SECOND), "net": F.col("opened") - F.col("closed")})
    seconds = instants.groupBy("second").agg(F.sum("net").alias("net"))
    seconds = seconds.withColumn("day", unit("second", _DAY // _SECOND))
    days = seconds.groupBy("day").agg(F.sum("net").alias("net"))

    before_day = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before_second = Window.partitionBy("day").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    before_instant = Window.partitionBy("second").orderBy("at_us").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(net: str, window) -> Column:
        return F.coalesce(F.sum(net).over(window), F.lit(0))

    days = days.select("day", earlier("net", before_day).alias("day_level"))
    seconds = (
        seconds.withColumn("in_day", earlier("net", before_second))
        .join(days, "day")
        .select("second", (F.col("day_level") + F.col("in_day")).alias("second_level"))
    )
    level = F.col("second_level") + earlier("net", before_instant)
    return instants.join(seconds, "second").select(
        "at_us", from_micros(F.col("at_us")).alias("at"), "opened", "closed", level.alias("before")
    )


def active_peak(results: DataFrame) -> DataFrame:
    """The highest number of open requests and when it was first reached."""
    series = active_requests(results)
    return series.agg(
        F.max("active").alias("peak"), F.min_by("at", F.struct(-F.col("active"), F.col("at_us"))).alias("first_at")
    )


def rate_step(length: str, slide: str) -> str:
    """The longest time that both lengths are multiples of."""
    return f"{math.gcd(interval_micros(length), interval_micros(slide))} microseconds"


def step_counts(results: DataFrame, step: str) -> DataFrame:
    """Results by (step, source, status); batch or stream."""
    return results.groupBy(F.window("ts", step).alias("step"), "source", "status").agg(F.count("*").alias("n"))


def rates_of_steps(steps: DataFrame, length: str, slide: str) -> DataFrame:
    """Sliding windows from counts by step: each count goes to the windows that it lies in."""
    windows = steps.groupBy(F.window("step.start", length, slide).alias("w"), "source", "status").agg(
        F.sum("n").alias("requests")
    )
    seconds = (epoch_micros(F.col("w.end")) - epoch_micros(F.col("w.start"))) / 1e6
    return windows.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "source",
        "status",
        "requests",
        (F.col("requests") / seconds).alias("rate"),
    )


def request_rate(results: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Requests per second by (source, status) over sliding windows.

    Rows are counted per step first; counts, not rows, then go to the windows.
    """
    return rates_of_steps(step_counts(results, rate_step(length, slide)), length, slide)
