"""The task queue as a table, and jobs seen through their tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweir.functions.times import epoch_micros


# Counts that one pass over the queue keeps.
_COUNTS = 1 << 16


def _as_long(tasks: DataFrame, name: str) -> Column:
    """A column as a whole number in the same order, null before all others."""
    kind = tasks.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = epoch_micros(F.col(name))
    elif isinstance(kind, (T.IntegralType, T.DateType)):
        value = (F.unix_date(F.col(name)) if isinstance(kind, T.DateType) else F.col(name)).cast("bigint")
    else:
        raise ValueError(f"{name} must be a whole number, a date or a time to rank by")
    return F.coalesce(value, F.lit(-(1 << 63)))


def _cut(ranked: DataFrame, k: int) -> tuple[list[int], int] | None:
    """The rank at which the first k end, and how many of the tasks with just that rank are in.

    The rank has one number for every level that was needed: one, if no task of that
    priority is in. None if there are k tasks or fewer. Every pass counts tasks
    in ranges of equal width, of which only the one where k falls goes on; one row comes back.
    """
    rows, end, left = ranked, [], k
    for rank in _RANKS:
        lo, hi, n = rows.agg(F.min(rank), F.max(rank), F.count(F.lit(1))).collect()[0]
        if n <= left:
            return None
        while lo < hi:
            width = -(-(hi - lo + 1) // _COUNTS)
            part = F.expr(f"(cast({rank} AS decimal(20, 0)) - {lo}BD) div {width}BD")
            counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
            up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
            running = counts.withColumn("upto", F.sum("n").over(up_to)).filter(F.col("upto") > left)
            found = running.agg(F.min_by(F.struct("part", (F.col("upto") - F.col("n")).alias("before")), "part").alias("c")).collect()[0].c
            left -= found.before
            lo, hi = lo + found.part * width, min(hi, lo + (found.part + 1) * width - 1)
            rows = rows.filter(F.col(rank).between(lo, hi))
        end.append(lo)
        if not left:
            break
    return end, left


_RANKS = ("_first", "_second", "_third")


def take(tasks: DataFrame, k: int, arrival: str = "arrival_seq") -> tuple[DataFrame, DataFrame]:
    """The first k tasks by priority, then arrival, and all others; nulls come first.

    The queue isn't sorted or moved. A few counting passes over its ranks narrow down where
    the first k end; two filters part it there. Tasks of equal rank are told apart by a
    hash of the whole task, and of equal tasks so many as needed fall on one side.
    """
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in tasks.columns]
    ranked = tasks.select(
        F.struct(*columns).alias("_task"),
        _as_long(tasks, "priority").alias("_first"),
        _as_long(tasks, arrival).alias("_second"),
        F.xxhash64(F.to_json(F.struct(*columns))).alias("_third"),
    )
    cut = _cut(ranked, max(0, k))
    if cut is None:
        return tasks, tasks.limit(0)
    end, inside = cut
    place = F.struct(*[F.col(r) for r in _RANKS[: len(end)]])
    at = F.struct(*[F.lit(v).cast("bigint").alias(r) for v, r in zip(end, _RANKS)])
    head, rest = ranked.filter(place < at), ranked.filter(place >= at if not inside else place > at)
    if inside:  # equal tasks, counted and given out as often as they belong to a side
        equal = ranked.filter(place == at).groupBy("_third").agg(F.first("_task").alias("_task"), F.count(F.lit(1)).alias("n"))

        def given(times: Column) -> DataFrame:
            some = F.when(times > 0, F.sequence(F.lit(1).cast("bigint"), times))
            return equal.select("_task", F.explode(some))

        head = head.select("_task").unionByName(given(F.lit(inside).cast("bigint")).select("_task"))
        rest = rest.select("_task").unionByName(given(F.col("n") - inside).select("_task"))
    return head.select("_task.*"), rest.select("_task.*")


def task_state(log: DataFrame, now: Column) -> DataFrame:
    """`state` of every logged request at the moment `now`."""
    started = epoch_micros(F.col("ts"))
    ended = started + F.round(F.col("response_time_ms") * 1000).cast("bigint")
    moment = epoch_micros(now)
    succeeded = F.coalesce(F.col("http_status").between(200, 299), F.lit(False)) & F.col("exception_class").isNull()
    return log.withColumn(
        "state",
        F.when(started > moment, F.lit("pending"))
        .when(ended > moment, F.lit("running"))
        .when(succeeded, F.lit("completed"))
        .otherwise(F.lit("failed")),
    )


def queue_depth(tasks: DataFrame) -> DataFrame:
    """How many tasks are pending, running, completed and failed."""
    states = ("pending", "running", "completed", "failed")
    return tasks.agg(*[F.count_if(F.col("state") == state).alias(f"{state}_tasks") for state in states])


def job_lifecycle(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Status, progress and times of every job from its tasks and their results.

    Both sides go through one grouping, so a job with very many tasks combines
    before the shuffle.
    """
    no_time = F.lit(None).cast(results.schema["ts"].dataType)
    no_text = F.lit(None).cast("string")
    rows = tasks.select("job_id", no_text.alias("status"), no_time.alias("ts")).unionByName(
        results.select("job_id", "status", "ts")
    )
    done = F.col("completed_count") + F.col("failed_count")
    counted = rows.groupBy("job_id").agg(
        F.count_if(F.col("status").isNull()).alias("total_count"),
        F.count_if(F.col("status") != "failed").alias("completed_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_result_at"),
    )
    finished = (done >= F.col("total_count")) & (done > 0)
    return counted.select(
        "job_id",
        F.when(done == 0, F.lit("pending"))
        .when(~finished, F.lit("running"))
        .when(F.col("completed_count") == 0, F.lit("failed"))
        .otherwise(F.lit("completed"))
        .alias("status"),
        F.least(F.lit(1.0), done / F.greatest(F.lit(1), F.col("total_count"))).alias("progress"),
        "completed_count",
        "failed_count",
        "total_count",
        "started_at",
        F.when(finished, F.col("last_result_at")).alias("completed_at"),
    )
