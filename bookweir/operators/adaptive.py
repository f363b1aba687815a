"""The adaptive limiter: rolling response figures and the rate they lead to."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweir.functions.times import epoch_micros
from bookweir.operators.ordered import CELL, with_context_blocks, with_key_position


@dataclass(frozen=True)
class AdaptiveConfig:
    """Thresholds and weights of the adaptive limiter."""

    requests_per_second: float = 10.0
    max_response_time: float = 5.0
    min_response_time: float = 0.1
    max_error_rate: float = 0.1
    min_requests_per_second: float = 0.1
    history: int = 100
    warm_up: int = 10
    keep: float = 0.7


BLOCK_ROWS = 65_536


def _step(config: AdaptiveConfig) -> int:
    """Rows after which a weight has fallen below 1e-30: a full step forgets what came before it."""
    if not 0 <= config.keep < 1:
        raise ValueError("keep must be at least 0 and less than 1")
    return max(1, math.ceil(30 / -math.log10(config.keep))) if config.keep else 1


def _measured(rows: DataFrame, key: str, seconds: Column, success: Column, ts: str) -> DataFrame:
    """With `_us`, the response time in whole nanoseconds and the error as 0 or 1, which sum up exactly."""
    return rows.withColumns(
        {
            "_us": epoch_micros(F.col(ts)),
            "_nanos": F.round(seconds * 1e9).cast("bigint"),
            "_error": F.when(F.coalesce(success, F.lit(False)), 0).otherwise(1).cast("bigint"),
        }
    )


def _with_rolling(blocks: DataFrame, config: AdaptiveConfig) -> DataFrame:
    """Means over the key's last rows: a running sum less the one `history` rows back, whatever the history."""
    order = Window.partitionBy("_block", "_key").orderBy("_pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("_nanos").isNotNull().cast("bigint")
    sums = {"_nanos_sum": F.sum("_nanos"), "_nanos_n": F.sum(known), "_errors": F.sum("_error")}
    summed = blocks.withColumns({name: F.coalesce(total.over(so_far), F.lit(0)) for name, total in sums.items()})
    back = {name: F.col(name) - F.coalesce(F.lag(name, config.history).over(order), F.lit(0)) for name in sums}
    rolled = summed.withColumns(back).withColumn("_seen", F.least(F.col("_pos") + 1, F.lit(config.history)))
    mean = F.when(F.col("_nanos_n") > 0, F.col("_nanos_sum") / F.col("_nanos_n") / 1e9)
    return rolled.withColumns({"avg_response_time": mean, "avg_error_rate": F.col("_errors") / F.col("_seen")})


def rolling_response(
    rows: DataFrame,
    key: str,
    seconds: Column,
    success: Column,
    ts: str = "ts",
    tie: str = "log_id",
    config: AdaptiveConfig = AdaptiveConfig(),
    cell: str = CELL,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean response time and error rate over the key's last responses, as many as the history has.

    Response times count to the nanosecond; one that is null counts for the error rate only.
    """
    measured = _measured(rows, key, seconds, success, ts)
    placed = with_key_position(measured, key, "_us", ["_us", tie], cell)
    blocks = _with_rolling(with_context_blocks(placed, max(block_rows, 2 * config.history), config.history), config)
    return blocks.filter(~F.col("_context")).select(*rows.columns, "avg_response_time", "avg_error_rate")


def adaptive_rate(
    rows: DataFrame,
    key: str,
    seconds: Column,
    success: Column,
    ts: str = "ts",
    tie: str = "log_id",
    config: AdaptiveConfig = AdaptiveConfig(),
    cell: str = CELL,
    block_rows: int = BLOCK_ROWS,
    saved: DataFrame | None = None,
) -> DataFrame:
    """Add the adaptation factor and current rate after every response.

    The smoothed factor is a weighted sum, so running sums give it without a
    loop: weights restart after a step of rows, as long as `keep` asks for, and
    the sum at the end of one step is all the next one needs. Context rows carry
    both the rolling figures and that sum over a block's edge, so a hot key is
    spread over as many blocks as it has rows for.

    Keys go on where an earlier run left them if `saved` (`adaptive_state`) is given: their
    last responses come first, as rows that smooth nothing and only say what the factor is.
    """
    step = _step(config)
    measured = _measured(rows, key, seconds, success, ts).withColumn("_known", F.lit(None).cast("double"))
    front = None
    if saved is not None:
        recent = saved.select(F.col("key").alias(key), F.col("factor").alias("_known"), F.posexplode("recent").alias("_us", "r"))
        recent = recent.join(rows.select(key).distinct(), key, "left_semi")
        measured = measured.unionByName(
            recent.select(key, F.col("_us").cast("bigint"), F.col("r.nanos").alias("_nanos"), F.col("r.error").alias("_error"), "_known"),
            allowMissingColumns=True,
        )
        front = F.col("_known").isNotNull()
    placed = with_key_position(measured, key, "_us", ["_us", tie], cell, front)
    context = 2 * step + config.history
    blocks = _with_rolling(with_context_blocks(placed, max(block_rows, 2 * context), context), config)
    speed = F.least(
        F.lit(1.0),
        config.max_response_time / F.greatest(F.col("avg_response_time"), F.lit(config.min_response_time)),
    )
    new_factor = (speed + 1.0 - F.col("avg_error_rate") / config.max_error_rate) / 2
    place = F.col("_pos") % step
    is_new = F.col("_known").isNull()
    stepped = blocks.withColumns(
        {
            "_step": F.floor(F.col("_pos") / step),
            "_factor": F.when(is_new & (F.col("_seen") >= config.warm_up), new_factor),
            "_weight": F.pow(F.lit(config.keep), place),
        }
    )
    so_far = Window.partitionBy("_block", "_key", "_step").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    share = 1 - config.keep
    summed = stepped.withColumns(
        {
            "_own": F.sum(share * F.col("_factor") / F.col("_weight")).over(so_far) * F.col("_weight"),
            "_fade": F.pow(F.lit(config.keep), F.count("_factor").over(so_far)),
            "_given": F.max("_known").over(so_far),
        }
    )
    earlier = Window.partitionBy("_block", "_key").orderBy("_step", "_pos").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.col("_own"), F.lit(0.0)) + F.col("_fade") * F.coalesce(F.col("_given"), F.lit(1.0))
    settled = F.col("_own").isNotNull() | F.col("_given").isNotNull()
    at_step_end = F.when((place == step - 1) & settled, ended)
    before = F.last(at_step_end, ignorenulls=True).over(earlier)
    started = summed.withColumn("_start", F.coalesce(F.col("_given"), before, F.lit(1.0)))
    factor = F.coalesce(F.col("_own"), F.lit(0.0)) + F.col("_fade") * F.col("_start")
    base = F.lit(config.requests_per_second)
    rate = F.when(F.col("_seen") < config.warm_up, base).otherwise(
        F.greatest(F.lit(config.min_requests_per_second), base * F.col("adaptation_factor"))
    )
    return (
        started.filter(~F.col("_context") & is_new)
        .withColumn("adaptation_factor", factor)
        .withColumn("current_rate", rate)
        .select(*rows.columns, "avg_response_time", "avg_error_rate", "adaptation_factor", "current_rate")
    )


def adaptive_state(
    adapted: DataFrame,
    key: str,
    seconds: Column,
    success: Column,
    ts: str = "ts",
    tie: str = "log_id",
    config: AdaptiveConfig = AdaptiveConfig(),
    saved: DataFrame | None = None,
) -> DataFrame:
    """What the next run has to know of every key: columns key, factor and recent, the last responses in order.

    Keys without new responses keep their `saved` state.
    """
    rows = _measured(adapted, key, seconds, success, ts)
    latest = Window.partitionBy("key").orderBy(F.col("run").desc(), F.col("_us").desc(), F.col("tie").desc())
    narrow = rows.select(
        F.col(key).alias("key"), F.lit(1).alias("run"), "_us", F.col(tie).alias("tie"), "_nanos", "_error", F.col("adaptation_factor").alias("factor")
    )
    if saved is not None:
        old = saved.select("key", "factor", F.posexplode("recent").alias("_us", "r"))
        old = old.select(
            "key", F.lit(0).alias("run"), F.col("_us").cast("bigint"), F.lit(None).cast(adapted.schema[tie].dataType).alias("tie"),
            F.col("r.nanos").alias("_nanos"), F.col("r.error").alias("_error"), "factor",
        )
        narrow = narrow.unionByName(old)
    # The limit on a key's rows is applied before they are shuffled, too.
    kept = narrow.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= config.history)
    entry = F.struct((-F.col("back")).alias("at"), F.col("_nanos").alias("nanos"), F.col("_error").alias("error"))
    grouped = kept.groupBy("key").agg(
        F.max_by("factor", -F.col("back")).alias("factor"), F.sort_array(F.collect_list(entry)).alias("recent")
    )
    return grouped.select("key", "factor", F.transform("recent", lambda e: F.struct(e["nanos"].alias("nanos"), e["error"].alias("error"))).alias("recent"))


def adaptive_stats(adapted: DataFrame, key: str, ts: str = "ts", tie: str = "log_id") -> DataFrame:
    """The last factor, rate and rolling means per key."""
    names = ["adaptation_factor", "current_rate", "avg_response_time", "avg_error_rate"]
    last = adapted.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(ts, tie)).alias("last"))
    return last.select(key, *[F.col(f"last.{name}").alias(name) for name in names])
