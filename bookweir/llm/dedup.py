"""Exact duplicates by a distributed content sort."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweir.llm.work import begin, parts_for, quoted, settle, utf8

# A range partition by this many compressed bytes of input.
PART_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Only A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _lowered(texts: pa.Array) -> pa.Array:
    data, offsets = utf8(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    )


def _runs(text_at: int, id_at: int):
    """Follow sorted rows, compare each with its neighbour and give out every run of equal texts at its end."""

    def close(held: list, state: dict, last: bool):
        rows = pa.concat_arrays([x[0] for x in held]) if len(held) > 1 else held[0][0]
        ids = rows.field(id_at)
        size = len(rows)
        edge = state["first"] or last
        state["first"] = False
        digest = hashlib.sha256(held[0][1]).hexdigest()
        arrays = [
            rows,
            pa.array([digest] * size),
            pa.array(np.full(size, size, np.int64)),
            pa.array([None if not len(ids) else ids[-1].as_py()] * size, pa.int64()),
            pa.array(np.arange(size) == size - 1),
            pa.array(np.full(size, edge)),
            pa.array(np.full(size, state["run"], np.int64)),
        ]
        state["run"] += 1
        return pa.RecordBatch.from_arrays(arrays, names=["row", "sha", "size", "top", "final", "edge", "run"])

    def follow(batches):
        begin()
        held, state = [], {"first": True, "run": 0}
        for batch in batches:
            rows = batch.column(0)
            if not len(rows):
                continue
            texts = _lowered(rows.field(text_at))
            fresh = np.ones(len(rows), bool)
            fresh[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = not held or held[0][1] != texts[0].as_py()
            starts = [*np.flatnonzero(fresh).tolist(), len(rows)]
            if starts[0]:
                held.append((rows.slice(0, starts[0]), held[0][1]))
            done = []
            for lo, hi in zip(starts, starts[1:]):
                if held:
                    done.append(close(held, state, last=False))
                held = [(rows.slice(lo, hi - lo), texts[lo].as_py())]
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if held:
            yield close(held, state, last=True)

    return follow


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with the group of equal texts that it belongs to.

    Returns `row` (a struct of the columns in `keep`, all by default), `text_sha256`,
    `group_size`, `keep_id` (largest id of the group) and `kept`: exactly one row of
    a group, the last by id.

    Rows are range-partitioned by sampled splitters over (first characters, hash of
    the text, id), so equal texts are adjacent, a common opening doesn't stay together,
    and a text that a third of all rows share is cut by id. Each partition is sorted by
    the full text (Spark spills to disk), neighbours are compared in full, and runs that
    touch the edge of a partition, two of each partition, are put together afterwards.

    Null text counts as empty; a null id sorts first, so it stays only if the whole
    group has none; of repeated rows one stays; an empty table gives an empty result.
    """
    columns = docs.columns if keep is None else keep
    needed = list(dict.fromkeys([*columns, id_col, text_col]))
    row = F.struct(*[F.col(quoted(name)) for name in needed]).alias("row")
    text, ident = F.col("row")[text_col], F.col("row")[id_col].cast("long")
    normal = normalised(text)
    parts = parts_for(docs.select(*[quoted(name) for name in needed]), PART_BYTES)
    keyed = docs.select(row).select("row", normalised(F.left(text, F.lit(32))).alias("k1"), F.xxhash64(normal).alias("k2"))
    dealt = keyed.repartitionByRange(parts, "k1", "k2", ident)
    ordered = dealt.sortWithinPartitions("k1", "k2", normal, ident).select("row", ident.alias("ident"))
    fields = T.StructType([docs.schema[name] for name in needed])
    own = next(name for name in ("_ident" + "_" * k for k in range(len(needed) + 1)) if name.lower() not in {n.lower() for n in needed})
    rows = F.struct(*[F.col("row")[name].alias(name) for name in needed], F.col("ident").alias(own))
    schema = T.StructType(
        [
            T.StructField("row", T.StructType([*fields, T.StructField(own, T.LongType())])),
            T.StructField("sha", T.StringType()),
            T.StructField("size", T.LongType()),
            T.StructField("top", T.LongType()),
            T.StructField("final", T.BooleanType()),
            T.StructField("edge", T.BooleanType()),
            T.StructField("run", T.LongType()),
        ]
    )
    follow = _runs(needed.index(text_col), len(needed))
    found = ordered.select(rows.alias("row")).mapInArrow(follow, schema)
    kept_row = F.struct(*[F.col("row")[name].alias(name) for name in columns]).alias("row")
    found = settle(found.select(kept_row, "sha", "size", "top", "final", "edge", F.spark_partition_id().alias("part"), "run"))
    # At most two runs a partition touch its edges: their totals are small whatever the input is.
    edges = found.filter("edge AND final").groupBy("sha").agg(
        F.sum("size").alias("all_size"),
        F.max("top").alias("all_top"),
        F.max("part").alias("last_part"),
    )
    joined = found.join(F.broadcast(edges.withColumn("edge", F.lit(True))), ["sha", "edge"], "left")
    return joined.select(
        "row",
        F.col("sha").alias("text_sha256"),
        F.coalesce("all_size", "size").alias("group_size"),
        F.coalesce("all_top", "top").alias("keep_id"),
        (F.col("final") & (F.col("last_part").isNull() | (F.col("last_part") == F.col("part")))).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns as they were."""
    return content_sort(docs, id_col, text_col).filter("kept").select("row.*")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    found = content_sort(docs, id_col, text_col, keep=[id_col])
    return found.select(F.col("row")[id_col].alias(id_col), "keep_id", "group_size", "kept", "text_sha256")
