"""Groups that form over several keys: rows that share any key belong together, also by way of others."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweir.session import use_checkpoint_dir


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows written to a shared folder and read from there."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_groups(rows: DataFrame, keys: Column) -> DataFrame:
    """The smallest key that each key is tied to by rows that hold several (`key`, `leader`).

    `keys` is an array of a row's keys. Only keys that stand beside others are listed; any
    other one leads itself. Equal ties are folded before they are shuffled, so a book that a
    third of all rows describe is one tie. In every round a key takes the smallest leader among its
    ties and then the leader of that one, so a chain of n keys needs about log n rounds;
    each is a written table, from which only the number of changes comes back.
    """
    folder = f"{use_checkpoint_dir(rows.sparkSession)}/bookweir-groups-{uuid.uuid4().hex}"
    held = rows.select(F.array_sort(F.array_distinct(F.array_compact(keys))).alias("keys")).filter(F.size("keys") > 1)
    one_way = held.select(F.get("keys", F.lit(0)).alias("key"), F.explode(F.slice("keys", 2, F.size("keys"))).alias("other"))
    ties = stored(
        one_way.select(F.inline(F.array(F.struct("key", "other"), F.struct(F.col("other").alias("key"), F.col("key").alias("other"))))).distinct(),
        folder,
        "ties",
    )
    leaders = stored(ties.groupBy("key").agg(F.least("key", F.min("other")).alias("leader")), folder, "round=0")
    for n in range(1, 1_000):
        of_others = ties.join(leaders.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min("leader").alias("near"))
        closer = leaders.join(of_others, "key").select("key", F.col("leader").alias("was"), F.least("leader", "near").alias("leader"))
        jumps = leaders.select(F.col("key").alias("leader"), F.col("leader").alias("further"))
        after = closer.join(jumps, "leader", "left").select("key", "was", F.least("leader", "further").alias("leader"))
        after = stored(after, folder, f"round={n}")
        leaders = after.select("key", "leader")
        if after.filter(F.col("was") != F.col("leader")).isEmpty():
            return leaders
    raise RuntimeError("keys are still changing their leader after 1,000 rounds")
