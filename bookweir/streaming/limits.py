"""The rate-limit audit and the adaptive rate on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from bookweir.functions.times import epoch_micros
from bookweir.operators.adaptive import AdaptiveConfig, adaptive_rate, adaptive_state
from bookweir.operators.limits import Bucket, Limit, bucket_levels, token_bucket

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The key's rows of this trigger, oldest first: a few numbers per row.

    The source's rows-per-trigger options bound them.
    """
    return pd.concat(list(rows), ignore_index=True).sort_values(["us", "id"], kind="stable")


class _TokenBucket(StatefulProcessor):
    def __init__(self, limit: Limit):
        self._limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("bucket", "level string, seen bigint")

    def handleInputRows(self, key, rows, timerValues):
        bucket = Bucket(self._limit.requests_per_second, self._limit.burst_size)
        stored = self._state.get()
        batch = _in_order(rows)
        level, seen = (int(stored[0]), stored[1]) if stored else (bucket.full, None)
        admitted, delays, tokens = [], [], []
        for micros in batch["us"].tolist():
            if pd.isna(micros):  # without a time: null results, no token
                for result in (admitted, delays, tokens):
                    result.append(None)
                continue
            before, seen = seen, int(micros) if seen is None else max(seen, int(micros))
            level = bucket.refilled(level, seen - (seen if before is None else before))
            admitted.append(level >= bucket.one)
            delays.append(bucket.delay(level))
            level = bucket.taken(level)
            tokens.append(level / bucket.one)
        if seen is not None:
            self._state.update((str(level), seen))
        yield pd.DataFrame(
            {
                "key": key[0],
                "id": batch["id"].to_numpy(),
                "admitted": admitted,
                "delay_seconds": delays,
                "tokens_after": tokens,
            }
        )

    def close(self) -> None:
        pass


def stream_token_bucket(rows: DataFrame, key: str, limit: Limit, ts: str = "ts", tie: str = "log_id") -> DataFrame:
    """The token-bucket audit on a stream.

    Equal to the batch audit as long as no row of a key comes in a later trigger
    than a newer row of that key.
    """
    use_state_store(rows.sparkSession)
    narrow = rows.select(F.col(key).alias("key"), F.col(tie).alias("id"), epoch_micros(F.col(ts)).alias("us"))
    return narrow.groupBy("key").transformWithStateInPandas(
        _TokenBucket(limit),
        "key string, id bigint, admitted boolean, delay_seconds double, tokens_after double",
        "append",
        "none",
    )


def audit_in_runs(
    rows: DataFrame, key: str, limit: Limit, folder: str, ts: str = "ts", tie: str = "log_id"
) -> DataStreamWriter:
    """The token-bucket audit on a stream whose hot keys outgrow a task.

    Every trigger is one run of the batch audit, which spreads a hot key over
    many chunks and starts from the levels the run before left. A run writes
    `rows/run=<n>` and `levels/run=<n>` below `folder`; a repeated run replaces
    itself, and levels go once the next run but one has been written.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        saved = spark.read.parquet(f"{folder}/levels/run={batch_id - 1}") if batch_id else None
        audited = token_bucket(batch, key, ts, tie, limit, saved=saved, keep_level=True)
        audited.write.mode("overwrite").parquet(f"{folder}/rows/run={batch_id}")
        written = spark.read.parquet(f"{folder}/rows/run={batch_id}")
        levels = bucket_levels(written, key, ts, tie, limit, saved)
        levels.write.mode("overwrite").parquet(f"{folder}/levels/run={batch_id}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/levels/run={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return rows.writeStream.foreachBatch(run)


def adapt_in_runs(
    rows: DataFrame,
    key: str,
    seconds: Column,
    success: Column,
    folder: str,
    ts: str = "ts",
    tie: str = "log_id",
    config: AdaptiveConfig = AdaptiveConfig(),
) -> DataStreamWriter:
    """The adaptive rate on a stream, on the same condition as the audit.

    Every trigger is one run of the batch job, which spreads a hot key over calendar cells
    and blocks. Carried from run to run are a key's factor and its last responses, a
    row a key. A run writes `rows/run=<n>` and `state/run=<n>` below `folder`; a repeated
    run replaces itself, and a state goes once the next run but one has been written.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        saved = spark.read.parquet(f"{folder}/state/run={batch_id - 1}") if batch_id else None
        adapted = adaptive_rate(batch, key, seconds, success, ts, tie, config, saved=saved)
        adapted.write.mode("overwrite").parquet(f"{folder}/rows/run={batch_id}")
        written = spark.read.parquet(f"{folder}/rows/run={batch_id}")
        state = adaptive_state(written, key, seconds, success, ts, tie, config, saved)
        state.write.mode("overwrite").parquet(f"{folder}/state/run={batch_id}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/run={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return rows.writeStream.foreachBatch(run)
