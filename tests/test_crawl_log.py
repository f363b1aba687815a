import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from bookweir.operators import metrics, outcomes, queue, stats
from bookweir.operators.validate import validate_jobs, validate_results
from bookweir.sources import requests as rq
from bookweir.sources.sinks import to_json_rows

T0 = dt.datetime(2024, 1, 1)


def test_requests_expand_and_validate(spark):
    rows = [(p, ["https://a/x", "notaurl"], "amazon", p) for p in (0, 5, 11)] + [(9, ["https://a/y"], "elsewhere", 5)]
    requests = spark.createDataFrame(rows, "request_id int, urls array<string>, source string, priority int")
    accepted, rejected = rq.validate_requests(rq.expand_requests(requests))
    assert [(r.request_id, r.url) for r in accepted.collect()] == [(5, "https://a/x")]
    reasons = {(r.request_id, r.pos): r.reasons for r in rejected.collect()}
    assert reasons[(0, 0)] == ["priority out of range"]
    assert reasons[(5, 1)] == ["url is no http url"]
    assert reasons[(9, 0)] == ["unknown source"]
    assert len(reasons) == 6


def test_attach_context_fills_gaps(spark):
    batch = spark.createDataFrame(
        [(T0, ["u0", "u1", "u2"], ["j0", ""], None), (T0, ["v0"], ["k0", "k1"], ["amazon", "x"])],
        "ts timestamp_ntz, urls array<string>, job_ids array<string>, sources array<string>",
    )
    rows = sorted(tuple(r) for r in rq.attach_context(batch).select("url", "job_id", "source").collect())
    millis = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert rows == [
        ("u0", "j0", "unknown"),
        ("u1", f"batch_{millis}_1", "unknown"),
        ("u2", f"batch_{millis}_2", "unknown"),
        ("v0", "k0", "amazon"),
    ]


def test_error_fields(spark):
    rows = [(404, None, "x" * 300, None), (None, "ReadTimeout", None, "timed out"), (204, None, "", None), (302, None, None, None)]
    log = spark.createDataFrame(rows, "http_status int, exception_class string, body string, exception_message string")
    got = [(r.error_code, r.error_message) for r in outcomes.error_fields(log).collect()]
    assert got == [("HTTP_404", "HTTP 404: " + "x" * 200), ("ReadTimeout", "timed out"), (None, None), ("HTTP_302", "HTTP 302: ")]


def test_final_status(spark):
    results = spark.createDataFrame(
        [(1, "success", 5), (2, "success", 5), (3, "success", 0), (4, "failed", None)],
        "page_id int, status string, data_size_bytes bigint",
    )
    books = spark.createDataFrame([(1, "t")], "page_id int, title string")
    got = {r.page_id: (r.status, r.book) for r in outcomes.finalize_status(results, books).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "success", 2: "partial", 3: "success", 4: "failed"}
    assert got[1][1].title == "t" and got[3][1] is None


def test_views_and_their_original_form(spark):
    results = spark.createDataFrame([(1, "success"), (2, "failed"), (3, "partial")], "id int, status string")
    assert outcomes.completed(results).count() == 2 and outcomes.failed(results).count() == 1
    assert outcomes.completed(results, reference_lists=True).count() == 3
    assert outcomes.failed(results, reference_lists=True).count() == 0
    assert outcomes.outcomes(outcomes.completed(results), outcomes.failed(results)).count() == 3


def test_take_is_stable_and_splits_everything(spark):
    rows = [(i, p) for i, p in enumerate((5, 1, 5, 3))]
    tasks = spark.createDataFrame(rows, "arrival_seq int, priority int")
    head, rest = queue.take(tasks, 2)
    assert sorted((r.priority, r.arrival_seq) for r in head.collect()) == [(1, 1), (3, 3)]
    assert sorted((r.priority, r.arrival_seq) for r in rest.collect()) == [(5, 0), (5, 2)]
    head, rest = queue.take(tasks, 0)
    assert head.count() == 0 and rest.count() == 4


def test_equal_ranks_are_on_one_side_each(spark):
    tasks = spark.range(500).select("id", F.lit(1).alias("arrival_seq"), (F.col("id") % 2).alias("priority"))
    head, rest = queue.take(tasks, 333)
    one, two = ({r.id for r in part.collect()} for part in (head, rest))
    assert len(one) == 333 and len(two) == 167 and not one & two


def test_rates_of_windows_that_slide_by_any_step(spark):
    rows = [(T0 + dt.timedelta(seconds=k), "s", "success") for k in range(1800)]
    results = spark.createDataFrame(rows, "ts timestamp_ntz, source string, status string")
    rates = metrics.request_rate(results, "5 minutes", "2 minutes").collect()
    full = [r for r in rates if T0 <= r.window_start and r.window_end <= T0 + dt.timedelta(minutes=30)]
    assert full and {r.requests for r in full} == {300}
    assert sum(r.requests for r in rates) == 1800 * 2.5


def test_job_lifecycle(spark):
    tasks = spark.createDataFrame([(j,) for j in "aabbcd"], "job_id string")
    results = spark.createDataFrame(
        [("a", "success", T0), ("a", "failed", T0 + dt.timedelta(hours=1)), ("b", "success", T0), ("c", "failed", T0)],
        "job_id string, status string, ts timestamp_ntz",
    )
    got = {r.job_id: (r.status, r.progress, r.completed_at) for r in queue.job_lifecycle(tasks, results).collect()}
    assert got == {
        "a": ("completed", 1.0, T0 + dt.timedelta(hours=1)),
        "b": ("running", 0.5, None),
        "c": ("failed", 1.0, T0),
        "d": ("pending", 0.0, None),
    }


def test_run_stats_denominators_and_outside_errors(spark):
    rows = [(T0, "success", False), (T0, "failed", False), (T0, "failed", True)]
    results = spark.createDataFrame(rows, "ts timestamp_ntz, status string, raised boolean")
    r = stats.run_stats(results, outside_fetch=F.col("raised")).collect()[0]
    assert (r.uptime_seconds, r.total_requests, r.successful_requests, r.failed_requests) == (0.0, 2, 1, 2)
    assert (r.success_rate, r.requests_per_second) == (0.5, 2.0)
    assert stats.throughput(results).count() == 0
    empty = stats.run_stats(results.limit(0)).collect()[0]
    assert (empty.total_requests, empty.success_rate) == (0, 0.0)


def test_histogram_bounds(spark):
    rows = spark.createDataFrame([(0.1,), (0.100001,), (60.0,), (61.0,), (None,)], "v double")
    got = {r.le: r.bucket for r in metrics.histogram(rows, F.col("v"), [], metrics.SECONDS_BOUNDS).collect()}
    assert (got["0.1"], got["0.5"], got["60.0"], got["+Inf"]) == (1, 2, 3, 4)
    cells = [got[str(b)] for b in metrics.SECONDS_BOUNDS] + [got["+Inf"]]
    assert cells == sorted(cells)


def test_active_requests_against_a_count(spark):
    random.seed(3)
    rows = [
        (T0 + dt.timedelta(seconds=random.choice([0, 1, 86399, 86400, 86401, 200000]), milliseconds=random.randrange(4)),
         float(random.choice([0, 1, 2, 1000, 90_000_000])))
        for _ in range(120)
    ]
    log = spark.createDataFrame(rows, "ts timestamp_ntz, response_time_ms double")
    spans = [(s, s + dt.timedelta(milliseconds=m)) for s, m in rows]
    got = {r.at: r.active for r in metrics.active_requests(log).collect()}
    assert got == {t: sum(s <= t <= e for s, e in spans) for t in {x for span in spans for x in span}}
    peak = metrics.active_peak(log).collect()[0]
    assert peak.peak == max(got.values()) and peak.first_at == min(t for t, n in got.items() if n == peak.peak)


def test_request_rate_equals_plain_windows(spark, folder):
    from bookweir.sources.tables import crawl_log, table

    log = outcomes.classify_fetch(crawl_log(table(spark, folder, "events")))
    plain = log.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "source", "status").count()
    plain = plain.select("w.start", "source", "status", "count")
    ours = metrics.request_rate(log).select("window_start", "source", "status", "requests")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ours.collect()))


def test_json_rows(spark):
    row = (1, T0, dt.datetime(2024, 1, 1, 1, 2, 3, 4), bytearray(b"\x00\xff"), None, (T0, bytearray(b"")), {"k": T0})
    df = spark.createDataFrame(
        [row],
        "a int, t timestamp_ntz, u timestamp_ntz, b binary, n string,"
        " s struct<t:timestamp_ntz,b:binary>, m map<string,timestamp_ntz>",
    )
    assert json.loads(to_json_rows(df).collect()[0].json) == {
        "a": 1,
        "t": "2024-01-01T00:00:00+00:00",
        "u": "2024-01-01T01:02:03.000004+00:00",
        "b": "00ff",
        "n": None,
        "s": {"t": "2024-01-01T00:00:00+00:00", "b": None},
        "m": {"k": "2024-01-01T00:00:00+00:00"},
    }


def test_source_catalog_reads_the_setting(spark):
    results = spark.createDataFrame([("amazon",), ("amazon",)], "source string")
    got = {r.source: (r.enabled, r.rows) for r in outcomes.source_catalog(results, "amazon,unknown").collect()}
    assert got["amazon"] == (True, 2) and got["unknown"] == (True, 0) and got["goodreads"] == (False, 0) and len(got) == 5


def test_result_keys_do_not_collide(spark):
    log = spark.createDataFrame([(1, "amazon", T0), (2, "amazon", T0)], "log_id int, source string, ts timestamp_ntz")
    rows = outcomes.with_ids(log, "ts", "log_id").collect()
    assert rows[0].result_id == rows[1].result_id == "amazon_1704067200000"
    assert rows[0].result_key != rows[1].result_key


def test_job_and_result_constraints(spark):
    jobs = spark.createDataFrame(
        [("a", "batch", "amazon", ["u"], 5, 3, 30, "pending"), ("b", "odd", "x", ["u"], 0, 11, 4, "pending")],
        "id string, job_type string, source string, urls array<string>, priority int, max_retries int, timeout_seconds int, status string",
    )
    ok, bad = validate_jobs(jobs)
    assert [r.id for r in ok.collect()] == ["a"]
    assert bad.collect()[0].reasons == [
        "unknown job_type", "unknown source", "priority out of range", "max_retries out of range", "timeout_seconds out of range",
    ]
    results = spark.createDataFrame([("j", "s", "skipped", 1.0), ("j", None, "done", 1.5)], "job_id string, source string, status string, confidence_score double")
    ok, bad = validate_results(results)
    assert ok.count() == 1
    assert bad.collect()[0].reasons == ["source missing", "unknown status", "confidence_score out of range"]


@pytest.mark.parametrize("k, spread", [(0, 1), (7, 1 << 50), (150, 1), (151, 1 << 50), (299, 1), (300, 1)])
def test_a_queue_is_cut_without_sorting_it(spark, k, spread):
    """Nulls, negative and very distant ranks, ties in rank and equal tasks."""
    rng = random.Random(k)
    some = [(rng.choice([None, -3, 1, 1, 2, 10]), rng.choice([None, 0, 5, rng.randrange(-40, 40) * spread]), rng.choice("ab")) for _ in range(300)]
    tasks = spark.createDataFrame(some, "priority int, arrival_seq long, name string").withColumn("_task", F.lit("own"))
    head, rest = queue.take(tasks.repartition(3), k)
    assert "rangepartitioning" not in head._jdf.queryExecution().executedPlan().toString()
    rank = lambda r: tuple((x is not None, x or 0) for x in r[:2])
    got, left = [tuple(r)[:3] for r in head.collect()], [tuple(r)[:3] for r in rest.collect()]
    assert sorted(got + left, key=str) == sorted(some, key=str)
    assert sorted(map(rank, got)) == sorted(map(rank, some))[:k]
