"""Helpers shared by the corpus operators: batches of texts, settled tables, partition counts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweir.session import plan_bytes, prepare, use_checkpoint_dir

# White space that ends a word: the space and U+0009 to U+000D, as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"
# Text handled at a time inside a task; a longer text is handled alone.
CHUNK_BYTES = 2 << 20
# Rows of an Arrow batch.
BATCH_ROWS = 1000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def once(key: str, make: Callable):
    """What is costly to load, kept by the worker process, which serves many tasks."""
    kept = vars(sys).setdefault("_bookweir_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def begin(keys: str | tuple = "-") -> None:
    """Start a task's work: let go of what other operators keep in this worker process, and of freed memory.

    Only entries whose key starts with `keys`, or one of them, stay.
    """
    kept = vars(sys).setdefault("_bookweir_kept", {})
    for key in [key for key in kept if not key.startswith(keys)]:
        del kept[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ready(spark: SparkSession) -> SparkSession:
    """Prepare a session; texts are long, so batches between Spark and Python hold fewer of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return prepare(spark)


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: later steps don't recompute what led here.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    folder = f"{use_checkpoint_dir(spark).rstrip('/')}/bookweir-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(schema).parquet(folder)


def estimated_bytes(df: DataFrame) -> int:
    """Size by the optimizer's statistics (of files: their size); by reading where these know nothing.

    For a join these multiply both sides, so no more than all that the plan reads counts.
    """
    size = plan_bytes(df)
    if size < 1 << 58:
        return size
    lengths = [F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) for f in df.schema if f.dataType == T.StringType()]
    row = F.lit(16 * len(df.columns)).cast("long")
    for length in lengths:
        row = row + length
    return int(df.agg(F.sum(row)).collect()[0][0] or 0) // 2


def parts_for(df: DataFrame, each: int = 16 << 20) -> int:
    """Partitions so that one has about `each` bytes (compressed) of the input, however large that is."""
    return max(1, math.ceil(estimated_bytes(df) / each))


def bounds(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs whose lengths sum to the limit at most, or of one item."""
    ends, lo = np.cumsum(lengths), 0
    while lo < len(lengths):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_texts(
    df: DataFrame,
    text: str,
    result: str,
    work: Callable[[pa.Array], list],
    keep: list[str] | None = None,
    limit: int = CHUNK_BYTES,
    kept: str | tuple = "-",
) -> DataFrame:
    """Columns `row` (a struct of the kept columns, all by default) and `out` (what `work` makes of the texts).

    `work` gets a string array of bounded size and returns one array per field of
    `result`. Names of input columns can't clash with those of the result. `kept` is
    how the keys begin under which the work keeps things (`once`).
    """
    keep = df.columns if keep is None else keep
    parsed = T._parse_datatype_string(result)
    row = F.struct(*[F.col(quoted(name)) for name in keep]).alias("row")
    inputs = [row] if text in keep else [row, F.col(quoted(text)).alias("text")]
    schema = T.StructType(
        [T.StructField("row", T.StructType([df.schema[name] for name in keep])), T.StructField("out", parsed)]
    )
    names, inside = [f.name for f in parsed], keep.index(text) if text in keep else None

    def run(batches):
        begin(kept)
        for batch in batches:
            texts = batch.column(1) if inside is None else batch.column(0).field(inside)
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for lo, hi in bounds(lengths, limit):
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(texts.slice(lo, hi - lo))]
                out = pa.StructArray.from_arrays(arrays, names)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), out], names=["row", "out"])

    return df.select(*inputs).mapInArrow(run, schema)


