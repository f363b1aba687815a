"""Rate-limit audit: would a logged request have passed, and what delay was due."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweir.functions.times import epoch_micros
from bookweir.operators.ordered import ordered_chunks


@dataclass(frozen=True)
class Limit:
    requests_per_second: float
    burst_size: int = 1


# The limits known by default; any other domain gets DEFAULT_LIMIT.
DEFAULT_LIMIT = Limit(10)
DOMAIN_LIMITS = {
    "goodreads.com": Limit(2, 3),
    "amazon.com": Limit(1, 2),
    "books.google.com": Limit(5, 5),
    "openlibrary.org": Limit(8, 10),
}


def limits_frame(spark: SparkSession, limits: dict[str, Limit] = DOMAIN_LIMITS) -> DataFrame:
    rows = [(key, float(limit.requests_per_second), limit.burst_size) for key, limit in limits.items()]
    return spark.createDataFrame(rows, "limit_key string, requests_per_second double, burst_size int")


def limit_lookup(
    rows: DataFrame, key: str, limits: DataFrame, default: Limit = DEFAULT_LIMIT, match: str = "exact"
) -> DataFrame:
    """Add the limit of each row's key, or the default one.

    With `match="suffix"` `www.example.com` falls under `example.com`, the
    longest known suffix winning. The optimizer broadcasts `limits` while it is
    below the session's threshold and shuffles it beyond.
    """
    if match == "suffix":
        joined = _by_suffix(rows, key, limits)
    else:
        joined = rows.join(limits, F.col(key) == F.col("limit_key"), "left").drop("limit_key")
    return joined.withColumns(
        {
            "requests_per_second": F.coalesce("requests_per_second", F.lit(float(default.requests_per_second))),
            "burst_size": F.coalesce("burst_size", F.lit(default.burst_size)),
        }
    )


# Limits that go to every task; beyond, hosts and limits meet by suffix, dealt over SALTS places.
SMALL_LIMITS = 10_000
SALTS = 64


def _by_suffix(rows: DataFrame, key: str, limits: DataFrame) -> DataFrame:
    """Rows with the limit of the longest known suffix of their host, level by level of a trie of labels.

    Limits are parted by how many labels they have; a host looks up its last 1, 2, ... labels
    in each part, and the deepest that knows it counts. The log is read once and not
    grouped. A table of many limits isn't broadcast: each of its rows is then there
    once per salt, and a host with a third of all rows is dealt over all of them.
    """
    sized = limits.withColumn("_labels", F.size(F.split("limit_key", r"\.")))
    # How many limits there are at every depth: a row a depth.
    depths = {r["_labels"]: r["count"] for r in sized.groupBy("_labels").count().collect() if r["_labels"] > 0}
    labels = F.split(F.col(key), r"\.")
    out = rows.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
    for depth in sorted(depths):
        known = sized.filter(F.col("_labels") == depth).select(
            F.col("limit_key").alias("_suffix"), F.struct("requests_per_second", "burst_size").alias(f"_limit_{depth}")
        )
        out = out.withColumn("_suffix", F.when(F.size(labels) >= depth, F.array_join(F.slice(labels, -depth, depth), ".")))
        if depths[depth] <= SMALL_LIMITS:
            out = out.join(F.broadcast(known), "_suffix", "left")
        else:
            salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            out = out.join(salted, ["_suffix", "_salt"], "left")
    none = F.lit(None).cast("struct<requests_per_second:double,burst_size:int>")
    found = F.coalesce(*[F.col(f"_limit_{depth}") for depth in sorted(depths, reverse=True)], none)
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns], found.alias("_found")).select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns], "_found.requests_per_second", "_found.burst_size"
    )


class Bucket:
    """Token bucket in whole units, so every order of evaluation gives the same answer.

    One token is `one` units, a microsecond adds `refill` units.
    """

    def __init__(self, requests_per_second: float, burst_size: int):
        rate = Fraction(requests_per_second).limit_denominator(1_000_000_000)
        self.one = rate.denominator * 1_000_000
        self.refill = rate.numerator
        self.full = burst_size * self.one

    def level(self, text: str) -> int:
        """Units of a level written by `text`, also by a bucket with another rate."""
        return min(self.full, int(Fraction(text) * self.one))

    def text(self, units: int) -> str:
        return f"{units}/{self.one}"

    def refilled(self, units: int, micros: int) -> int:
        return min(self.full, units + max(0, micros) * self.refill)

    def taken(self, units: int) -> int:
        return units - self.one if units >= self.one else units

    def delay(self, units: int) -> float:
        return 0.0 if units >= self.one else (self.one - units) / self.refill / 1e6


class Passage:
    """What a run of requests does to a bucket, for every level it may start with.

    Levels are cut into ranges that move together: `[low, high, level, moving]`
    sends the start levels low..high to level, level + 1, ... (or all to `level`
    once they met at the full mark).
    """

    def __init__(self, bucket: Bucket, known: int | None = None):
        """Follow every start level, or the one level that is `known`."""
        self.bucket = bucket
        self.ranges = [[0, bucket.full, 0, True] if known is None else [0, bucket.full, known, False]]

    def step(self, micros: int) -> None:
        bucket = self.bucket
        if len(self.ranges) == 1 and not self.ranges[0][3]:
            only = self.ranges[0]
            only[2] = bucket.taken(bucket.refilled(only[2], micros))
            return
        add, out = max(0, micros) * bucket.refill, []
        for low, high, level, moving in self.ranges:
            level += add
            if not moving:
                self._append(out, low, high, bucket.taken(min(bucket.full, level)), False)
                continue
            top = level + high - low
            for upper, take in ((bucket.one - 1, 0), (bucket.full - 1, bucket.one)):
                if low <= high and level <= upper:
                    cut = min(high, low + upper - level)
                    self._append(out, low, cut, level - take, True)
                    level, low = level + cut - low + 1, cut + 1
            if low <= high and top >= bucket.full:
                self._append(out, low, high, bucket.full - bucket.one, False)
        self.ranges = out

    @staticmethod
    def _append(out: list, low: int, high: int, level: int, moving: bool) -> None:
        if out and out[-1][3] == moving:
            last = out[-1]
            follows = last[2] + (low - last[0] if moving else 0)
            if follows == level:
                last[1] = high
                return
        out.append([low, high, level, moving])

    def end_level(self, start: int) -> int:
        for low, high, level, moving in self.ranges:
            if low <= start <= high:
                return level + start - low if moving else level
        raise ValueError("start level outside the bucket")


_SUMMARY = (
    "_chunk int, first_key string, first_us bigint, first_limit string, last_key string, last_us bigint, last_limit string,"
    " requests_per_second double, burst_size int, ranges array<struct<low:string,high:string,level:string,moving:boolean>>"
)
_TWO_LIMITS = "key {!r} has more than one limit; audit each limit's time span on its own"
_COLUMNS = ["_chunk", "_key", "_us", "requests_per_second", "burst_size", "_saved"]


def _chunk_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk: its first key, and how it leaves its last key's bucket.

    Only these two reach over the edges of a chunk. A key that starts inside
    the chunk starts with its saved level or a full bucket, so a single level is
    followed for it. Requests without a time pass by.
    """
    first = last = passage = None
    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in _COLUMNS)):
            chunk, key, micros, rate, burst, saved = row
            if micros is None:
                continue
            if last and key == last[1] and last[5] is None and (rate, burst) != last[3:5]:
                raise ValueError(_TWO_LIMITS.format(key))
            if saved is not None:
                bucket = Bucket(rate, burst)
                passage = Passage(bucket, bucket.level(saved))
            elif first is None:
                passage = Passage(Bucket(rate, burst))
                passage.step(0)
            elif key != last[1]:
                bucket = Bucket(rate, burst)
                passage = Passage(bucket, bucket.taken(bucket.full))
            else:
                passage.step(micros - last[2])
            first, last = first or (key, micros, None if saved is not None else f"{rate} {burst}"), row
    if first is None:
        return
    ranges = [
        {"low": str(low), "high": str(high), "level": str(level), "moving": moving}
        for low, high, level, moving in passage.ranges
    ]
    chunk, key, micros, rate, burst, saved = last
    summary = {"_chunk": chunk, "first_key": first[0], "first_us": first[1], "first_limit": first[2]}
    summary |= {"last_key": key, "last_us": micros, "last_limit": None if saved is not None else f"{rate} {burst}"}
    summary |= {"requests_per_second": rate, "burst_size": burst, "ranges": ranges}
    yield pa.RecordBatch.from_pylist([summary], schema=_SUMMARY_ARROW)


_SUMMARY_ARROW = pa.schema(
    [
        ("_chunk", pa.int32()),
        ("first_key", pa.string()),
        ("first_us", pa.int64()),
        ("first_limit", pa.string()),
        ("last_key", pa.string()),
        ("last_us", pa.int64()),
        ("last_limit", pa.string()),
        ("requests_per_second", pa.float64()),
        ("burst_size", pa.int32()),
        (
            "ranges",
            pa.list_(
                pa.struct(
                    [("low", pa.string()), ("high", pa.string()), ("level", pa.string()), ("moving", pa.bool_())]
                )
            ),
        ),
    ]
)


def _chunk_starts(summaries: pd.DataFrame) -> pd.DataFrame:
    """Bucket level before the first request of every chunk that goes on with the key before it."""
    starts, key, level, seen, limit = [], None, 0, 0, None
    for row in summaries.sort_values("_chunk").itertuples(index=False):
        chunk, first_key, first_us, first_limit, last_key, last_us, last_limit, rate, burst, ranges = row
        if first_key == key and limit and first_limit and limit != first_limit:
            raise ValueError(_TWO_LIMITS.format(key))
        bucket = Bucket(rate, burst)
        start = bucket.full
        if first_key == key:
            starts.append((chunk, str(level), seen))
            if last_key == first_key:
                start = bucket.refilled(level, first_us - seen)
        passage = Passage(bucket)
        passage.ranges = [[int(r["low"]), int(r["high"]), int(r["level"]), r["moving"]] for r in ranges]
        key, level, seen, limit = last_key, passage.end_level(start), last_us, last_limit
    return pd.DataFrame(starts, columns=["_chunk", "_level", "_seen"])


def _replay(names: list[str], keep_level: bool):
    """Follow the bucket through one chunk, row by row, holding one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, level, seen, bucket, position = None, 0, 0, None, -1
        for batch in batches:
            asked, admitted, delays, tokens, levels = [], [], [], [], []
            columns = [batch.column(name).to_pylist() for name in [*_COLUMNS[1:], "_level", "_seen", "_pos"]]
            for row_key, micros, rate, burst, saved, start, start_seen, pos in zip(*columns):
                if pos <= position:
                    raise ValueError("chunk is out of order")
                position = pos
                asked.append(saved is None)
                if micros is None:
                    for result in (admitted, delays, tokens, levels):
                        result.append(None)
                    continue
                if bucket is None or row_key != key:
                    goes_on = bucket is None and start is not None
                    bucket, key = Bucket(rate, burst), row_key
                    level, seen = (int(start), start_seen) if goes_on else (bucket.full, micros)
                if saved is not None:
                    level, seen = bucket.level(saved), micros
                    continue
                level, seen = bucket.refilled(level, micros - seen), micros
                delays.append(bucket.delay(level))
                admitted.append(level >= bucket.one)
                level = bucket.taken(level)
                tokens.append(level / bucket.one)
                levels.append(bucket.text(level) if keep_level else None)
            kept = batch.select(names).filter(pa.array(asked, pa.bool_()))
            results = [pa.array(admitted, pa.bool_()), pa.array(delays, pa.float64()), pa.array(tokens, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *results, pa.array(levels, pa.string())],
                [*names, "admitted", "delay_seconds", "tokens_after", "level"],
            )

    return run


def _bucket_key(keys: str | list[str]) -> Column:
    names = [keys] if isinstance(keys, str) else keys
    return F.concat_ws("\x1f", *[F.coalesce(F.col(name).cast("string"), F.lit("default")) for name in names])


def _not_before(rows: DataFrame, key: str, us: str, saved: DataFrame) -> DataFrame:
    """Times no older than what an earlier run has seen of the key."""
    floors = saved.select(F.col("bucket_key").alias("_floor_key"), F.col("seen_us").alias("_floor"))
    joined = rows.join(floors, F.col(key) == F.col("_floor_key"), "left")
    later = F.when(F.col(us).isNotNull(), F.greatest(us, "_floor"))
    return joined.withColumn(us, later).drop("_floor", "_floor_key")


def token_bucket(
    rows: DataFrame,
    key: str | list[str],
    ts: str = "ts",
    tie: str = "log_id",
    limit: Limit | None = None,
    chunks: int | None = None,
    saved: DataFrame | None = None,
    keep_level: bool = False,
) -> DataFrame:
    """Add `admitted`, `delay_seconds` and `tokens_after` to every request.

    Each key has a bucket that starts full, or at its `saved` level from an
    earlier run (`bucket_levels`); a blocked request takes no token. The limit
    comes from `limit` or from the columns `requests_per_second` and
    `burst_size` (`limit_lookup`); two limits for one key are an error. Requests
    run in (ts, tie) order. One older than what an earlier run has seen counts
    as of that time; one without a time gets null results and takes no token.

    Three steps over even chunks: what each chunk does to the bucket of its last
    key, the level every chunk starts with (one row per chunk), and the replay.
    A hot key is spread over many chunks and no task holds a whole key. A saved
    level is one more row in front of its key's requests.
    """
    timed = rows.withColumns(
        {"_key": _bucket_key(key), "_us": epoch_micros(F.col(ts)), "_saved": F.lit(None).cast("string")}
    )
    if limit is not None:
        timed = timed.withColumns(
            {
                "requests_per_second": F.lit(float(limit.requests_per_second)),
                "burst_size": F.lit(limit.burst_size),
            }
        )
    timed = timed.withColumn("burst_size", F.col("burst_size").cast("int")).withColumn("_turn", F.lit(1))
    if saved is not None:
        now = limit or Limit(0)
        levels = saved.select(
            F.col("bucket_key").alias("_key"),
            F.col("seen_us").alias("_us"),
            F.col("level").alias("_saved"),
            (F.lit(float(now.requests_per_second)) if limit else F.col("requests_per_second")).alias(
                "requests_per_second"
            ),
            (F.lit(now.burst_size) if limit else F.col("burst_size")).cast("int").alias("burst_size"),
            F.lit(0).alias("_turn"),
        )
        timed = _not_before(timed, "_key", "_us", saved).unionByName(levels, allowMissingColumns=True)
    chunked = ordered_chunks(timed, "_key", ["_turn", "_us", tie], chunks)
    summaries = chunked.select(*_COLUMNS).mapInArrow(_chunk_summary, _SUMMARY)
    starts = (
        summaries.withColumn("_all", F.lit(0))
        .groupBy("_all")
        .applyInPandas(lambda pdf: _chunk_starts(pdf.drop(columns="_all")), "_chunk int, _level string, _seen bigint")
    )
    started = chunked.join(F.broadcast(starts), "_chunk", "left")
    kept = [field for field in timed.schema.fields if field.name in rows.columns]
    results = T.StructType.fromDDL("admitted boolean, delay_seconds double, tokens_after double, level string")
    audited = started.mapInArrow(_replay([f.name for f in kept], keep_level), T.StructType([*kept, *results.fields]))
    return audited if keep_level else audited.drop("level")


def bucket_levels(
    audited: DataFrame,
    key: str | list[str],
    ts: str = "ts",
    tie: str = "log_id",
    limit: Limit | None = None,
    saved: DataFrame | None = None,
) -> DataFrame:
    """Levels to start the next run with, from an audit that kept its `level` column.

    Keys without new requests keep their `saved` level.
    """
    rate = F.lit(float(limit.requests_per_second)) if limit else F.col("requests_per_second")
    burst = F.lit(limit.burst_size) if limit else F.col("burst_size")
    rows = audited.select(
        _bucket_key(key).alias("bucket_key"),
        "level",
        epoch_micros(F.col(ts)).alias("seen_us"),
        rate.alias("requests_per_second"),
        burst.cast("int").alias("burst_size"),
        F.col(tie).alias("tie"),
    ).filter("level IS NOT NULL")
    if saved is not None:
        rows = _not_before(rows, "bucket_key", "seen_us", saved)
    turn = F.struct(F.lit(1).alias("run"), F.col("seen_us").alias("us"), "tie").alias("at")
    rows = rows.select("*", turn).drop("tie")
    if saved is not None:
        no_tie = F.lit(None).cast(audited.schema[tie].dataType)
        earlier = F.struct(F.lit(0).alias("run"), F.col("seen_us").alias("us"), no_tie.alias("tie"))
        rows = rows.unionByName(saved.withColumn("at", earlier))
    names = ["level", "seen_us", "requests_per_second", "burst_size"]
    last = rows.groupBy("bucket_key").agg(F.max_by(F.struct(*names), "at").alias("last"))
    return last.select("bucket_key", "last.*")


def nested_token_bucket(
    rows: DataFrame,
    inner: str | list[str],
    outer: str | list[str],
    inner_limit: Limit,
    outer_limit: Limit,
    ts: str = "ts",
    tie: str = "log_id",
    chunks: int | None = None,
) -> DataFrame:
    """Per-key limiter first, then the outer one.

    The outer bucket never sees a request the inner one blocked, and the inner
    one does not depend on the outer, so this is two passes of the same audit.
    """
    outer_keys = [outer] if isinstance(outer, str) else outer
    inner_keys = [inner] if isinstance(inner, str) else inner
    first = token_bucket(rows, [*outer_keys, *inner_keys], ts, tie, inner_limit, chunks)
    blocked = first.filter(~F.col("admitted")).drop("tokens_after").withColumn("blocked_by", F.lit("inner"))
    passed = first.filter("admitted").drop("admitted", "delay_seconds", "tokens_after")
    second = token_bucket(passed, outer_keys, ts, tie, outer_limit, chunks).drop("tokens_after")
    second = second.withColumn("blocked_by", F.when(~F.col("admitted"), F.lit("outer")))
    return blocked.unionByName(second)


def limiter_stats(audited: DataFrame, key: str = "domain", ts: str = "ts", tie: str = "log_id", limit: Limit | None = None) -> DataFrame:
    """Per key: admitted and blocked requests, the share admitted, tokens left after the last one, and the limit.

    The limit is the audit's `limit` or the last value of the columns of `limit_lookup`.
    """
    rate = F.lit(float(limit.requests_per_second)) if limit else F.col("requests_per_second")
    burst = F.lit(limit.burst_size) if limit else F.col("burst_size")
    last = F.struct(F.col("tokens_after").alias("tokens_available"), rate.alias("requests_per_second"), burst.alias("burst_size"))
    counted = audited.groupBy(key).agg(
        F.count_if("admitted").alias("total_requests"),
        F.count_if(~F.col("admitted")).alias("blocked_requests"),
        F.max_by(last, F.when(F.col("admitted").isNotNull(), F.struct(ts, tie))).alias("last"),
    )
    asked = F.col("total_requests") + F.col("blocked_requests")
    share = F.col("total_requests") / F.greatest(F.lit(1), asked)
    return counted.select(key, "total_requests", "blocked_requests", share.alias("success_rate"), "last.*")
