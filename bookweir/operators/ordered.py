"""Rows in key and time order, cut whatever the key skew.

A window per key would put a key that holds a third of all rows into one task.
Chunks range-partition rows by (key, order), so a hot key spans as many
chunks as its share of the rows; positions come from calendar cells of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweir.functions.times import interval_micros
from bookweir.session import plan_bytes, use_checkpoint_dir

# Size of a chunk, as the optimizer estimates it.
CHUNK_BYTES = 128 << 20


def ordered_chunks(rows: DataFrame, key: str, order: list[str], chunks: int | None = None) -> DataFrame:
    """Rows sorted by (key, order) within even chunks; adds `_chunk` and `_pos`.

    `_pos` grows with (key, order) but leaves gaps between chunks. The result is
    checkpointed: chunk numbers are read by more than one pass and must be the
    same in each, also after an executor is lost. (key, order) must be unique.
    There are as many chunks as the size of the rows asks for, at least as many
    as shuffle partitions and cores.
    """
    spark = rows.sparkSession
    use_checkpoint_dir(spark)
    columns = [key, *order]
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    chunks = chunks or max(least, _chunks_by_size(rows))
    numbered = rows.repartitionByRange(chunks, *columns).sortWithinPartitions(*columns).select(
        "*", F.spark_partition_id().alias("_chunk"), F.monotonically_increasing_id().alias("_pos")
    )
    return numbered.checkpoint()


def _chunks_by_size(rows: DataFrame) -> int:
    """Chunks of CHUNK_BYTES by the optimizer's estimate; 1 where it has none."""
    size = plan_bytes(rows)
    return -(-size // CHUNK_BYTES) if size < 1 << 58 else 1


# Span of time whose rows of one key are put in order by one task.
CELL = "1 hour"
_FIRST = -(1 << 62)


def key_name(key: str) -> Column:
    """A key as text that is never null, so that it can be joined on; different keys stay different."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))


def with_key_position(rows: DataFrame, key: str, us: str, order: list[str], cell: str = CELL, front: Column | None = None) -> DataFrame:
    """Add `_key` and `_pos`, the row's place (0, 1, 2, ...) in its key's order; `order` begins with `us`.

    Boundaries are fixed by the calendar: a task orders the rows of one key and one `cell` of
    time. A key's cells are then summed up in order, one number each, so a key
    is never in one place however many rows it has. Nothing is sampled or written: counting
    and ordering read the same exchange. Rows marked `front` come first, then those without a time.
    """
    of_time = F.coalesce(F.floor(F.col(us) / interval_micros(cell)).cast("bigint"), F.lit(_FIRST + 1))
    own = of_time if front is None else F.when(front, F.lit(_FIRST)).otherwise(of_time)
    dealt = rows.withColumns({"_key": key_name(key), "_cell": own}).repartition("_key", "_cell")
    earlier = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_key", "_cell").agg(F.count(F.lit(1)).alias("_n")).select(
        "_key", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("_key", "_cell").orderBy(*order)) - 1
    placed = dealt.withColumn("_within", within).join(offsets, ["_key", "_cell"])
    return placed.withColumn("_pos", (F.col("_before") + F.col("_within")).cast("bigint")).drop("_cell", "_within", "_before")


def with_context_blocks(rows: DataFrame, block_rows: int, context_rows: int) -> DataFrame:
    """Put every row into its block, and the last rows of a block into the next as context.

    A window by (`_block`, `_key`) then sees `context_rows` earlier rows of
    the key, if there are. Drop the rows marked `_context` afterwards.
    """
    block = F.floor(F.col("_pos") / block_rows)
    is_tail = F.col("_pos") % block_rows >= block_rows - context_rows
    own = F.struct(block.alias("_block"), F.lit(False).alias("_context"))
    copy = F.struct((block + 1).alias("_block"), F.lit(True).alias("_context"))
    return rows.select("*", F.inline(F.when(is_tail, F.array(own, copy)).otherwise(F.array(own))))
