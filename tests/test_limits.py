import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from bookweir.operators import adaptive, limits
from bookweir.operators.limits import Bucket, Limit, Passage
from bookweir.sources.tables import crawl_log, table
from bookweir.streaming import jobs
from bookweir.streaming import limits as stream_limits

T0 = dt.datetime(2024, 1, 1)


def _columns():
    return F.col("response_time_ms") / 1000, F.col("http_status") == 200


def _times(spark, offsets, key="k"):
    rows = [(i, T0 + dt.timedelta(seconds=s), key) for i, s in enumerate(offsets)]
    return spark.createDataFrame(rows, "log_id bigint, ts timestamp_ntz, domain string")


def _by_id(audited):
    return {r.log_id: (r.admitted, round(r.delay_seconds, 6)) for r in audited.collect()}


def _loop(rows, limit, key):
    """Row-by-row audit with exact units."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.log_id)):
        bucket = Bucket(limit.requests_per_second, limit.burst_size)
        micros = (r.ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        level, seen = state.get(key(r), (bucket.full, micros))
        level = bucket.refilled(level, micros - seen)
        out[r.log_id] = (level >= bucket.one, round(bucket.delay(level), 6))
        state[key(r)] = (bucket.taken(level), micros)
    return out


def test_burst_then_refill(spark):
    got = _by_id(limits.token_bucket(_times(spark, [0] * 5 + [0.5]), "domain", limit=Limit(2, 3)))
    assert got == {0: (True, 0), 1: (True, 0), 2: (True, 0), 3: (False, 0.5), 4: (False, 0.5), 5: (True, 0)}


def test_ten_equal_requests(spark):
    """Ten requests at once to one URL: the exact key gets the default limit, the suffix the site's."""
    rows = _times(spark, [0] * 10, "www.goodreads.com")
    known = limits.limits_frame(spark)
    for match, admitted, delay in (("exact", 1, 0.1), ("suffix", 3, 0.5)):
        audited = limits.token_bucket(limits.limit_lookup(rows, "domain", known, match=match), "domain")
        got = _by_id(audited)
        assert sum(a for a, _ in got.values()) == admitted
        assert {d for a, d in got.values() if not a} == {delay}
        stats = limits.limiter_stats(audited).collect()[0]
        assert (stats.total_requests, stats.blocked_requests, stats.success_rate) == (admitted, 10 - admitted, admitted / 10)


@pytest.mark.parametrize("small", [0, 10_000])
def test_suffixes_over_a_hot_host(spark, monkeypatch, small):
    """With limits broadcast and dealt by salt; the log is read once, and hosts of one name or none are fine."""
    monkeypatch.setattr(limits, "SMALL_LIMITS", small)
    hosts = ["www.a.com"] * 200 + ["a.com", "x.b.a.com", "com", "", None, "a.org", "b.a.com.", "aa.com"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "log_id long, d string")
    known = limits.limits_frame(spark, {"com": Limit(1), "a.com": Limit(2, 2), "b.a.com": Limit(3, 3)})
    found = limits.limit_lookup(rows, "d", known, match="suffix")
    got = [(r.d, r.requests_per_second, r.burst_size) for r in found.orderBy("log_id").collect()]
    want = {"www.a.com": (2, 2), "a.com": (2, 2), "x.b.a.com": (3, 3), "com": (1, 1), "aa.com": (1, 1)}
    assert got == [(h, *map(float, want.get(h, (10, 1))[:1]), want.get(h, (10, 1))[1]) for h in hosts]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 4 and (not small or "Exchange hashpartitioning" not in plan)


def test_longest_suffix_wins(spark):
    rows = spark.createDataFrame([("a.b.example.com",), ("example.com",), ("xexample.com",), ("",)], "d string")
    known = limits.limits_frame(spark, {"example.com": Limit(1), "b.example.com": Limit(2, 7)})
    got = {r.d: (r.requests_per_second, r.burst_size) for r in limits.limit_lookup(rows, "d", known, match="suffix").collect()}
    assert got == {"a.b.example.com": (2.0, 7), "example.com": (1.0, 1), "xexample.com": (10.0, 1), "": (10.0, 1)}


def test_passage_equals_stepping_from_every_level():
    random.seed(1)
    for _ in range(300):
        bucket = Bucket(1.0, 1)
        bucket.one, bucket.refill = random.choice([3, 10, 17]), random.choice([1, 2, 5])
        bucket.full = bucket.one * random.choice([1, 2, 3, 5])
        steps = [random.choice([0, 0, 1, 2, 3, 10, 30]) for _ in range(random.randint(1, 40))]
        passage = Passage(bucket)
        for micros in steps:
            passage.step(micros)
        for start in range(bucket.full + 1):
            level = start
            for micros in steps:
                level = bucket.taken(bucket.refilled(level, micros))
            assert passage.end_level(start) == level


def test_passage_stays_small_on_a_busy_key():
    random.seed(2)
    for load in (0.5, 0.95, 1.05, 3.0):
        bucket, most = Bucket(8, 10), 0
        passage = Passage(bucket)
        for _ in range(20_000):
            passage.step(int(random.expovariate(8 * load) * 1e6))
            most = max(most, len(passage.ranges))
        assert most <= 4 * (10 + 1)


@pytest.mark.parametrize("chunks", [None, 3, 40])
@pytest.mark.parametrize("key, limit", [("domain", Limit(0.125 / 3600, 2)), ("source", Limit(0.2 / 3600, 4)), ("one", Limit(1 / 3600, 3))])
def test_hot_keys_over_many_chunks(spark, folder, chunks, key, limit):
    log = crawl_log(table(spark, folder, "events")).select("log_id", "ts", "domain", "source", F.lit("x").alias("one"))
    expected = _loop(log.collect(), limit, lambda r: r[key])
    got = _by_id(limits.token_bucket(log, key, limit=limit, chunks=chunks))
    assert got == expected
    assert 0 < sum(a for a, _ in got.values()) < len(got)


def test_nested_limits_against_a_loop(spark, folder):
    log = crawl_log(table(spark, folder, "events")).select("log_id", "ts", "domain", "source")
    inner, outer = Limit(0.01 / 3600, 2), Limit(0.15 / 3600, 3)
    first = _loop(log.collect(), inner, lambda r: (r.source, r.domain))
    passed = [r for r in log.collect() if first[r.log_id][0]]
    expected = {**first, **_loop(passed, outer, lambda r: r.source)}
    got = limits.nested_token_bucket(log, "domain", "source", inner, outer, chunks=5)
    assert _by_id(got) == expected
    blocked = {r.blocked_by: r["count"] for r in got.groupBy("blocked_by").count().collect()}
    assert blocked["inner"] > 0 and blocked["outer"] > 0 and sum(blocked.values()) == len(expected)


def _adaptive_loop(rows, key):
    history, factors, out = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.log_id)):
        seen = history.setdefault(r[key], [])
        seen.append((r.response_time_ms / 1000, 0 if r.http_status == 200 else 1))
        del seen[:-100]
        factor, rate = factors.get(r[key], 1.0), 10.0
        mean, errors = (sum(x[i] for x in seen) / len(seen) for i in (0, 1))
        if len(seen) >= 10:
            factor = 0.7 * factor + 0.3 * (min(1.0, 5 / max(mean, 0.1)) + 1 - errors / 0.1) / 2
            rate = max(0.1, 10 * factor)
        factors[r[key]] = factor
        out[r.log_id] = (mean, errors, factor, rate)
    return out


def _figures(rows):
    names = ("avg_response_time", "avg_error_rate", "adaptation_factor", "current_rate")
    return {r.log_id: tuple(r[n] for n in names) for r in rows.collect()}


def _close(got, expected):
    assert got.keys() == expected.keys()
    for i, values in expected.items():
        assert got[i] == pytest.approx(values, abs=1e-12, rel=1e-12)


def test_warm_up_and_first_step(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), "k", 10_000.0, 200) for i in range(10)]
    log = spark.createDataFrame(rows, "log_id bigint, ts timestamp_ntz, k string, response_time_ms double, http_status int")
    got = _figures(adaptive.adaptive_rate(log, "k", *_columns()))
    assert all(got[i][2:] == (1.0, 10.0) for i in range(9))
    assert got[9][2:] == pytest.approx((0.925, 9.25))


@pytest.mark.parametrize("cell, block_rows", [("1 hour", 65_536), ("7 days", 1024), ("10 minutes", 512)])
@pytest.mark.parametrize("key", ["domain", "source", "one"])
def test_adaptive_rate_over_blocks(spark, cell, block_rows, key):
    log = crawl_log(table(spark, "/root/testdata/sf0.01", "events")).withColumn("one", F.lit("x"))
    log = log.select("log_id", "ts", key, "response_time_ms", "http_status")
    got = adaptive.adaptive_rate(log, key, *_columns(), cell=cell, block_rows=block_rows)
    _close(_figures(got), _adaptive_loop(log.collect(), key))


def _several_files(spark, folder, path):
    """The events as four files in time order, one per trigger."""
    events = table(spark, folder, "events")
    for part in range(4):
        events.filter(F.floor(F.col("event_id") / 250) == part).coalesce(1).write.mode("append").parquet(path)
    return jobs.stream_table(spark, path, "*.parquet", events.schema, per_trigger=1)


def test_streams_equal_the_batch(spark, folder, tmp_path):
    stream = crawl_log(_several_files(spark, folder, str(tmp_path / "events")))
    log = crawl_log(table(spark, folder, "events"))
    limit = Limit(0.2 / 3600, 4)
    audited = jobs.drained_table(stream_limits.stream_token_bucket(stream, "source", limit), "bucket")
    assert _by_id(audited.withColumnRenamed("id", "log_id")) == _by_id(limits.token_bucket(log, "source", limit=limit))


@pytest.mark.parametrize("key, keep, history", [("domain", 0.7, 100), ("source", 0.99, 20), ("one", 0.7, 400)])
def test_adaptive_runs_equal_one_run(spark, folder, tmp_path, key, keep, history):
    """Also where one key has all rows, and where keys are idle in some runs."""
    stream = crawl_log(_several_files(spark, folder, str(tmp_path / "events"))).withColumn("one", F.lit("x"))
    log = crawl_log(table(spark, folder, "events")).withColumn("one", F.lit("x"))
    config, out = adaptive.AdaptiveConfig(keep=keep, history=history), str(tmp_path / "adapted")
    jobs.drain(stream_limits.adapt_in_runs(stream, key, *_columns(), out, config=config), f"{out}/stream")
    batch = adaptive.adaptive_rate(log, key, *_columns(), config=config)
    _close(_figures(spark.read.parquet(f"{out}/rows")), _figures(batch))


def test_adaptive_jobs_start_nothing_while_they_are_built(spark, folder):
    log = crawl_log(table(spark, folder, "events"))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("building", "")
    built = [adaptive.adaptive_rate(log, "domain", *_columns(), config=adaptive.AdaptiveConfig(history=h)) for h in (100, 10_000)]
    rolling = adaptive.rolling_response(log, "domain", *_columns())
    assert not tracker.getJobIdsForGroup("building")
    context._jsc.clearJobGroup()
    plans = [re.sub(r"#\d+L?|\d+", "", df._jdf.queryExecution().optimizedPlan().toString()) for df in built]
    assert plans[0] == plans[1]  # the history's length changes numbers only
    assert "rangepartitioning" not in rolling._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_instant_and_without_a_key(spark):
    rows = [(k, dt.datetime(2024, 1, 1) if k % 3 else None, None if k % 2 else "a", 100.0 * k, 200) for k in range(300)]
    log = spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, k string, response_time_ms double, http_status int")
    got = {r.log_id: r.avg_response_time for r in adaptive.rolling_response(log, "k", *_columns()).collect()}
    for key in (None, "a"):
        own = sorted((r for r in rows if r[2] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
        for i, r in enumerate(own):
            recent = [x[3] / 1000 for x in own[max(0, i - 99) : i + 1]]
            assert abs(got[r[0]] - sum(recent) / len(recent)) < 1e-9


def test_runs_with_saved_levels_equal_one_run(spark, folder, tmp_path):
    stream = crawl_log(_several_files(spark, folder, str(tmp_path / "events")))
    limit, out = Limit(0.2 / 3600, 4), str(tmp_path / "audit")
    jobs.drain(stream_limits.audit_in_runs(stream, "source", limit, out), f"{out}/state")
    log = crawl_log(table(spark, folder, "events"))
    expected = _loop(log.collect(), limit, lambda r: r.source)
    assert _by_id(spark.read.parquet(f"{out}/rows")) == expected
    assert spark.read.parquet(f"{out}/levels/run=3").count() == 5


def test_saved_levels_survive_idle_runs_and_new_rates(spark):
    limit = Limit(1, 4)
    first = limits.token_bucket(_times(spark, [0, 0, 0]), "domain", limit=limit, keep_level=True)
    levels = limits.bucket_levels(first, "domain", limit=limit)
    other = limits.token_bucket(_times(spark, [1], "other"), "domain", limit=limit, saved=levels, keep_level=True)
    levels = limits.bucket_levels(other, "domain", limit=limit, saved=levels)
    assert {r.bucket_key: r.level for r in levels.collect()} == {"k": "1000000/1000000", "other": "3000000/1000000"}
    again = limits.token_bucket(_times(spark, [1, 1, 1]), "domain", limit=Limit(0.5, 4), saved=levels)
    assert [a for a, _ in sorted(_by_id(again).items())] == [0, 1, 2]
    assert [_by_id(again)[i] for i in range(3)] == [(True, 0), (False, 1.0), (False, 1.0)]


def test_a_failing_callback_does_not_stop_the_stream(spark, folder, tmp_path):
    stream = crawl_log(_several_files(spark, folder, str(tmp_path / "events")))
    seen = []

    def callback(batch, batch_id):
        seen.append(batch.count())
        if len(seen) == 2:
            raise RuntimeError("no")

    jobs.drain(jobs.on_results(stream, str(tmp_path / "rows"), callback), str(tmp_path / "state"))
    assert seen == [250, 250, 250, 250]
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1000


@pytest.mark.parametrize("keep, history, block_rows", [(0.99, 100, 1024), (0.999, 100, 512), (0.7, 1000, 1024), (0, 5, 64)])
def test_adaptive_rate_off_the_defaults(spark, keep, history, block_rows):
    rng = random.Random(4)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), rng.choice([0.2, 4.0, 9.0]) * 1000, rng.choice([200, 200, 503])) for k in range(3000)]
    log = spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, response_time_ms double, http_status int").withColumn("k", F.lit("x"))
    config = adaptive.AdaptiveConfig(keep=keep, history=history)
    got = adaptive.adaptive_rate(log, "k", F.col("response_time_ms") / 1000, F.col("http_status") == 200, config=config, cell="3 minutes", block_rows=block_rows)
    seconds, errors, factor = [], [], 1.0
    for r in got.orderBy("log_id").collect():
        seconds, errors = [*seconds, r.response_time_ms / 1000][-history:], [*errors, float(r.http_status != 200)][-history:]
        mean, error = sum(seconds) / len(seconds), sum(errors) / len(errors)
        if len(seconds) >= config.warm_up:
            speed = min(1.0, config.max_response_time / max(mean, config.min_response_time))
            factor = keep * factor + (1 - keep) * (speed + 1.0 - error / config.max_error_rate) / 2
        assert abs(r.avg_response_time - mean) < 1e-9 and abs(r.adaptation_factor - factor) < 1e-9


def test_requests_without_a_time_take_no_token(spark):
    rows = [(k, dt.datetime(2024, 1, 1) if k % 2 else None, "k") for k in range(8)]
    log = spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, domain string")
    for chunks in (1, 3):
        got = {r.log_id: r.admitted for r in limits.token_bucket(log, "domain", limit=Limit(1, 2), chunks=chunks).collect()}
        assert [got[k] for k in range(8)] == [None, True, None, True, None, False, None, False]


def test_late_rows_refill_nothing(spark):
    limit = Limit(0.01, 2)
    first = limits.token_bucket(_times(spark, [100, 100, 100]), "domain", limit=limit, keep_level=True)
    levels = limits.bucket_levels(first, "domain", limit=limit)
    late = limits.token_bucket(_times(spark, [0, 100]), "domain", limit=limit, saved=levels, keep_level=True)
    assert [r.admitted for r in late.collect()] == [False, False]
    assert limits.bucket_levels(late, "domain", limit=limit, saved=levels).collect()[0].seen_us == levels.collect()[0].seen_us


@pytest.mark.parametrize("chunks", [1, 2, 4, 7])
def test_two_limits_for_one_key_are_refused(spark, chunks):
    log = _times(spark, list(range(400))).withColumns(
        {"requests_per_second": F.when(F.col("log_id") < 200, 1.0).otherwise(0.05), "burst_size": F.lit(2)}
    )
    with pytest.raises(Exception, match="more than one limit"):
        limits.token_bucket(log, "domain", chunks=chunks).collect()
