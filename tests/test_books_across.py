"""Books tied by several keys, the search index, late rows and the queue over time."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from bookweir.operators import books, metrics, search
from bookweir.operators.links import key_groups
from bookweir.schemas import METADATA
from bookweir.streaming import jobs, late

NOW = datetime.datetime(2024, 1, 1)


def _books(spark, rows):
    """Complete books of (page_id, fields of the metadata)."""
    full = [(k, "amazon", {**dict.fromkeys(METADATA.names), "authors": [], **m}) for k, m in rows]
    typed = spark.createDataFrame(
        [(k, s, [m[name] if name != "source_metadata" else None for name in METADATA.names]) for k, s, m in full],
        f"page_id bigint, source string, metadata {METADATA.simpleString()}",
    )
    return books.with_defaults(typed, F.lit(NOW))


def _components(sets):
    leader = {}

    def top(key):
        while leader.setdefault(key, key) != key:
            key = leader[key]
        return key

    for keys in sets:
        for key in keys:
            a, b = sorted((top(key), top(sorted(keys)[0])))
            leader[b] = a
    tied = {key for keys in sets if len(set(keys)) > 1 for key in keys}
    return {key: min(other for other in tied if top(other) == top(key)) for key in tied}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_over_several_keys(spark, seed):
    rng = random.Random(seed)
    sets = [[f"k{rng.randrange(400):03}" for _ in range(rng.randint(0, 3))] for _ in range(200)]
    sets += [[f"c{i:03}", f"c{i + 1:03}"] for i in range(90)]  # one long chain
    sets += [["hot", f"h{i % 5}"] for i in range(500)] + [["same", "same"], ["lone"], [None, "null"], []]
    rows = spark.createDataFrame([(s,) for s in sets], "keys array<string>").repartition(5)
    got = {r.key: r.leader for r in key_groups(rows, F.col("keys")).collect()}
    assert got == _components([[k for k in s if k] for s in sets])
    assert key_groups(rows.limit(0), F.col("keys")).collect() == []


def test_books_known_by_different_keys(spark):
    url = "https://books.example.com/b/1"
    rows = [
        (1, {"title": "by url", "source_url": url}),
        (2, {"isbn10": "0-306-40615-2", "publisher": "P"}),
        (3, {"isbn13": "978-0306406157", "source_url": url, "description": "both"}),
        (4, {"title": "alone"}),
        (5, {"title": "alone"}),
        (6, {"isbn": "978 0306406157", "isbn13": "", "source_url": ""}),
    ]
    got = {tuple(r): r.copies for r in books.consolidate_linked(_books(spark, rows)).select("key_kind", "book_key", "copies").collect()}
    assert set(got) == {("isbn", "9780306406157", 4), ("page", "4", 1), ("page", "5", 1)}
    row = books.consolidate_linked(_books(spark, rows)).filter("copies = 4").collect()[0].metadata
    assert (row.title, row.publisher, row.description, row.source_url) == ("by url", "P", "both", url)
    assert books.consolidate_linked(_books(spark, rows).limit(0)).collect() == []


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abÄé ", k=rng.randint(0, 6)))
    rows = [(k, {"title": None if k % 9 == 0 else word() + word(), "authors": [word() for _ in range(k % 3)]}) for k in range(300)]
    rows += [(1000 + k, {"title": "the hot title", "authors": ["ab", "éa"]}) for k in range(200)]
    found = _books(spark, rows)
    search.write_index(found, str(tmp_path / "index"))
    for query in ("aba", "ÄÉ", "a", "", "hot t", "abéa", "e hot titles"):
        for source in (None, "amazon", "goodreads"):
            expected = [r.page_id for r in books.search(found, query, source, limit=40).collect()]
            assert [r.page_id for r in search.search_index(spark, str(tmp_path / "index"), query, source, 40).collect()] == expected
    plan = search.search_index(spark, str(tmp_path / "index"), "hot t")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and "MapInArrow" not in plan
    search.write_index(found.limit(0), str(tmp_path / "none"))
    assert search.search_index(spark, str(tmp_path / "none"), "aba").collect() == []


def test_late_rows_are_kept_over_restarts(spark, tmp_path):
    at = lambda minute: NOW + datetime.timedelta(minutes=minute)
    triggers = [[("a", at(0)), ("b", at(60)), ("a", None)], [("a", at(49)), ("a", at(50)), ("b", at(90))], [("b", at(79)), ("a", at(80)), ("c", None)]]
    for n, rows in enumerate(triggers):
        landed = str(tmp_path / "landed")
        spark.createDataFrame(rows, "source string, ts timestamp_ntz").write.mode("append").parquet(landed)
        stream = spark.readStream.schema("source string, ts timestamp_ntz").parquet(landed)
        jobs.drain(late.split_late(stream, str(tmp_path / "split"), "10 minutes"), str(tmp_path / "state"))
    rows = late.split_rows(spark, str(tmp_path / "split"), stream)
    assert sorted((r.source, r.ts) for r in rows.filter("late").collect()) == [("a", at(49)), ("b", at(79))]
    counts = {r.source: (r.requests, r.late) for r in late.late_counts(rows).collect()}
    assert counts == {"a": (5, 1), "b": (3, 1), "c": (1, 0)}


def test_queue_over_time(spark):
    at = lambda second: NOW + datetime.timedelta(seconds=second)
    rows = [("j", at(0)), ("j", at(5)), ("j", at(5)), ("k", at(5)), ("k", at(90_000)), ("k", None), (None, at(7))]
    got = metrics.queue_sizes(spark.createDataFrame(rows, "job_id string, ts timestamp_ntz")).orderBy("at_us").collect()
    assert [(r.at, r.queue_size) for r in got] == [(at(0), 2), (at(5), 1), (at(7), 1), (at(90_000), 0)]
