"""One query per operator over the given tables, with flat, comparable results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweir.functions.text import clean_text
from bookweir.functions.times import epoch_micros
from bookweir.functions.urls import domain_key, resolve_url
from bookweir.operators import adaptive, books, dom, html, limits, metrics, outcomes, queue, search, stats, validate
from bookweir.plans.crawl import scrape_batch, scrape_results
from bookweir.session import prepare
from bookweir.sources import requests as rq
from bookweir.sources.pages import load_pages, stream_pages
from bookweir.sources.sinks import to_json_rows
from bookweir.sources.tables import book_pages, crawl_log, dirty_documents, scrape_requests, table
from bookweir.streaming import counters, jobs, late
from bookweir.streaming import limits as stream_limits

AUDIT_LIMIT = limits.Limit(0.125 / 3600, 2)
OUTER_LIMIT = limits.Limit(2 / 3600, 3)
SNAPSHOT = "2024-01-20 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            return run(prepare(spark), folder)

        _QUERIES[name] = prepared
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- inputs and small helpers -----------------------------------------------


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return crawl_log(table(spark, folder, "events"))


def _with_body(events: DataFrame) -> DataFrame:
    """The crawl log with a response text made of the event's properties."""
    return crawl_log(events, F.concat_ws(" ", "event_type", F.repeat("props", 30)).alias("body"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes.error_fields(outcomes.classify_fetch(_with_body(table(spark, folder, "events"))))


def _stream_log(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return jobs.stream_table(spark, folder, "events.parquet", schema)


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return load_pages(spark, f"{folder}/pages.parquet")


def _r(value: Column | str) -> Column:
    return F.round(value, 6)


def _joined(items: Column | str) -> Column:
    return F.array_join(items, "|")


def _success() -> Column:
    return F.col("http_status") == 200


def _seconds() -> Column:
    return F.col("response_time_ms") / 1000


def _snapshot() -> Column:
    return F.lit(SNAPSHOT).cast("timestamp_ntz")


# --- sources and sinks --------------------------------------------------------


@_query("crawl_pages")
def _crawl_pages(spark, folder):
    return _pages(spark, folder).select("page_id", "url", "html", "data_size_bytes")


@_query("request_expand")
def _request_expand(spark, folder):
    tasks = rq.expand_requests(scrape_requests(table(spark, folder, "events")))
    return tasks.select("request_id", F.col("pos").cast("bigint").alias("pos"), "url", "source", "priority", "metadata")


@_query("request_validate")
def _request_validate(spark, folder):
    tasks = rq.expand_requests(scrape_requests(table(spark, folder, "events")))
    accepted, rejected = rq.validate_requests(tasks)
    accepted = accepted.withColumn("reasons", F.array().cast("array<string>"))
    return accepted.unionByName(rejected).select("request_id", "url", "source", "priority", _joined("reasons").alias("reasons"))


@_query("request_summary")
def _request_summary(spark, folder):
    tasks = rq.expand_requests(scrape_requests(table(spark, folder, "events")))
    task_id = F.concat_ws("_", F.col("source"), F.col("request_id").cast("string"), F.col("pos").cast("string"))
    receipts = rq.request_summary(tasks.withColumn("task_id", task_id))
    return receipts.withColumn("task_ids", _joined("task_ids"))


@_query("results_json")
def _results_json(spark, folder):
    rows = _results(spark, folder).select(
        "log_id", "ts", "source", "status", "error_code", F.col("source").cast("binary").alias("payload")
    )
    return to_json_rows(rows)


@_query("source_catalog")
def _source_catalog(spark, folder):
    return outcomes.source_catalog(_log(spark, folder), "goodreads,amazon,google_books,openlibrary")


@_query("stream_results")
def _stream_results(spark, folder):
    rows = outcomes.classify_fetch(crawl_log(_stream_log(spark, folder))).select("log_id", "source", "status")
    path = jobs.work_folder(spark, "results")

    def fail(batch: DataFrame, batch_id: int) -> None:
        raise RuntimeError("a callback that always fails loses no result")

    jobs.drain(jobs.on_results(rows, f"{path}/rows", fail), f"{path}/state")
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").select("log_id", "source", "status")


# --- crawl log ------------------------------------------------------------------


@_query("fetch_outcome")
def _fetch_outcome(spark, folder):
    return outcomes.classify_fetch(_log(spark, folder)).select("log_id", "http_status", "exception_class", "status")


@_query("error_fields")
def _error_fields(spark, folder):
    return _results(spark, folder).select("log_id", "error_code", "error_message")


@_query("payload_size")
def _payload_size(spark, folder):
    log = _with_body(table(spark, folder, "events"))
    took = F.round(F.col("response_time_ms") * 1000).cast("bigint")
    fetches = log.select(
        "log_id", "body", F.col("ts").alias("started_at"), F.timestamp_add("MICROSECOND", took, F.col("ts")).alias("ended_at")
    )
    return outcomes.payload_size(fetches).select("log_id", "data_size_bytes", _r("response_time_ms").alias("response_time_ms"))


@_query("completed_results")
def _completed_results(spark, folder):
    return outcomes.completed(_results(spark, folder)).select("log_id", "job_id", "source", "url", "status")


@_query("failed_results")
def _failed_results(spark, folder):
    return outcomes.failed(_results(spark, folder)).select("log_id", "job_id", "source", "url", "status", "error_code")


def _page_results(spark: SparkSession, folder: str) -> DataFrame:
    """Fetch results of the book pages; some failed, some came back empty."""
    pages = book_pages(spark, folder)
    empty = F.col("page_id") % 50 == 7
    return pages.select(
        "page_id",
        "kind",
        "url",
        "source",
        F.when(F.col("page_id") % 13 == 0, "failed").otherwise("success").alias("status"),
        F.when(empty, "").otherwise(F.col("html")).alias("html"),
        F.when(empty, 0).otherwise(F.octet_length("html")).cast("bigint").alias("data_size_bytes"),
    )


@_query("final_status")
def _final_status(spark, folder):
    """Status after extraction, in the row that the page is read in."""
    results = _page_results(spark, folder).withColumns(
        {
            "http_status": F.when(F.col("status") == "failed", 503).otherwise(200),
            "exception_class": F.lit(None).cast("string"),
        }
    )
    final = scrape_results(results.drop("status", "data_size_bytes"))
    return final.select("page_id", "status", F.col("metadata.title").alias("title"))


@_query("attach_context")
def _attach_context(spark, folder):
    """Five URLs per batch, with fewer job ids and fewer sources than URLs."""
    requests = scrape_requests(table(spark, folder, "events"))
    batch = requests.select(
        "request_id",
        F.timestamp_add("SECOND", F.col("request_id"), F.lit(SNAPSHOT).cast("timestamp_ntz")).alias("ts"),
        "urls",
        F.transform(F.slice("urls", 1, 3), lambda u, i: F.when(i == 1, F.lit("")).otherwise(F.concat(F.lit("job_"), F.substring(u, 1, 20)))).alias("job_ids"),
        F.when(F.col("request_id") % 4 != 0, F.array_repeat("source", 2)).alias("sources"),
    )
    return rq.attach_context(batch).select("request_id", F.col("pos").cast("bigint").alias("pos"), "url", "job_id", "source")


@_query("result_ids")
def _result_ids(spark, folder):
    return outcomes.with_ids(_log(spark, folder), "ts", "log_id").select("log_id", "result_id", "result_key")


# --- joins ----------------------------------------------------------------------


def _test_limits(spark: SparkSession) -> DataFrame:
    return limits.limits_frame(
        spark,
        {
            "d0.example.com": limits.Limit(2, 3),
            "d1.example.com": limits.Limit(1, 2),
            "d2.example.com": limits.Limit(5, 5),
            "d3.example.com": limits.Limit(8, 10),
        },
    )


@_query("limit_lookup")
def _limit_lookup(spark, folder):
    keyed = _log(spark, folder).select("log_id", domain_key("url").alias("domain"))
    return limits.limit_lookup(keyed, "domain", _test_limits(spark)).select(
        "log_id", "domain", "requests_per_second", "burst_size"
    )


@_query("limit_lookup_suffix")
def _limit_lookup_suffix(spark, folder):
    keyed = _log(spark, folder).select("log_id", F.concat(F.lit("www."), F.col("domain")).alias("domain"))
    found = limits.limit_lookup(keyed, "domain", _test_limits(spark), match="suffix")
    return found.select("log_id", "domain", "requests_per_second", "burst_size")


@_query("results_with_books")
def _results_with_books(spark, folder):
    found = books.extract_books(_page_results(spark, folder))
    return found.select("page_id", "status", F.col("metadata.title").alias("title"))


@_query("descendant_select")
def _descendant_select(spark, folder):
    found = html.select_pages(_pages(spark, folder), "nav a")
    return found.select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href"), "text")


@_query("descendant_cover")
def _descendant_cover(spark, folder):
    found = html.select_pages(book_pages(spark, folder), ".cover img")
    return found.select("page_id", F.try_element_at("attrs", F.lit("src")).alias("src"))


@_query("outcomes_union")
def _outcomes_union(spark, folder):
    results = _results(spark, folder)
    both = outcomes.outcomes(outcomes.completed(results), outcomes.failed(results))
    return both.groupBy("status").agg(F.count("*").alias("total_tasks"))


# --- queue, statistics, metrics ---------------------------------------------------


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("log_id", "priority", F.col("log_id").alias("arrival_seq"))


@_query("queue_take")
def _queue_take(spark, folder):
    head, _ = queue.take(_tasks(spark, folder), 1234)
    return head.select("log_id", "priority")


@_query("queue_rest")
def _queue_rest(spark, folder):
    _, rest = queue.take(_tasks(spark, folder), 1234)
    return rest.select("log_id", "priority")


@_query("queue_rest_ties")
def _queue_rest_ties(spark, folder):
    """What stays of a queue in which many tasks have the same rank."""
    _, rest = queue.take(_tasks(spark, folder).withColumn("arrival_seq", F.lit(0)), 321)
    return rest.groupBy("priority").agg(F.count("*").alias("tasks"))


@_query("job_validate")
def _job_validate(spark, folder):
    """Jobs described by the log, some of an unknown type or out of range."""
    k = F.col("log_id")
    jobs_ = _log(spark, folder).select(
        "log_id",
        F.element_at(F.array(*map(F.lit, ["single", "batch", "scheduled", "recurring", "odd"])), (k % 5 + 1).cast("int")).alias("job_type"),
        F.when(k % 7 == 0, "elsewhere").otherwise(F.col("source")).alias("source"),
        F.lit("pending").alias("status"),
        (k % 13).alias("priority"),
        (k % 12).alias("max_retries"),
        (k % 400).alias("timeout_seconds"),
        F.when(k % 11 != 0, F.array("url")).alias("urls"),
    )
    good, bad = validate.validate_jobs(jobs_)
    both = good.withColumn("reasons", F.array().cast("array<string>")).unionByName(bad)
    return both.select("log_id", _joined("reasons").alias("reasons"))


@_query("result_validate")
def _result_validate(spark, folder):
    """Results of the log, some without a job or source, with an unknown status or a score out of range."""
    k = F.col("log_id")
    results = _results(spark, folder).select(
        "log_id",
        F.when(k % 9 != 0, F.col("job_id")).alias("job_id"),
        F.when(k % 10 != 0, F.col("source")).alias("source"),
        F.when(k % 8 == 0, "done").otherwise(F.col("status")).alias("status"),
        (k % 5 / 3).alias("confidence_score"),
    )
    good, bad = validate.validate_results(results)
    both = good.withColumn("reasons", F.array().cast("array<string>")).unionByName(bad)
    return both.select("log_id", _joined("reasons").alias("reasons"))


@_query("queue_depth")
def _queue_depth(spark, folder):
    return queue.queue_depth(queue.task_state(_log(spark, folder), _snapshot()))


@_query("job_lifecycle")
def _job_lifecycle(spark, folder):
    tasks = outcomes.classify_fetch(_log(spark, folder))
    jobs_seen = queue.job_lifecycle(tasks, tasks.filter((F.col("ts") < _snapshot()) | (F.col("log_id") % 97 < 20)))
    return jobs_seen.select(
        "job_id",
        "status",
        _r("progress").alias("progress"),
        "completed_count",
        "failed_count",
        "total_count",
        epoch_micros(F.col("started_at")).alias("started_us"),
        epoch_micros(F.col("completed_at")).alias("completed_us"),
    )


@_query("run_stats")
def _run_stats(spark, folder):
    run = stats.run_stats(outcomes.classify_fetch(_log(spark, folder)))
    return run.select(
        _r("uptime_seconds").alias("uptime_seconds"),
        "total_requests",
        "successful_requests",
        "failed_requests",
        _r("success_rate").alias("success_rate"),
        F.round("requests_per_second", 9).alias("requests_per_second"),
    )


@_query("job_status")
def _job_status(spark, folder):
    return stats.job_status(_results(spark, folder)).withColumn("success_rate", _r("success_rate"))


@_query("job_performance")
def _job_performance(spark, folder):
    performance = stats.job_performance(_results(spark, folder))
    return performance.withColumns(
        {name: F.round(name, 4) for name in ("average_response_time_ms", "total_duration_seconds")}
    )


@_query("requests_total")
def _requests_total(spark, folder):
    return metrics.requests_total(_results(spark, folder))


def _rounded_histogram(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sum", F.round("sum", 3))


@_query("duration_histogram")
def _duration_histogram(spark, folder):
    return _rounded_histogram(metrics.duration_histogram(_results(spark, folder)))


@_query("success_total")
def _success_total(spark, folder):
    return metrics.success_total(_results(spark, folder))


@_query("failure_total")
def _failure_total(spark, folder):
    return metrics.failure_total(_results(spark, folder))


@_query("books_extracted")
def _books_extracted(spark, folder):
    return metrics.books_extracted(books.books(book_pages(spark, folder)))


@_query("size_histogram")
def _size_histogram(spark, folder):
    return _rounded_histogram(metrics.size_histogram(_results(spark, folder)))


@_query("active_requests")
def _active_requests(spark, folder):
    return metrics.active_requests(_log(spark, folder)).select("at_us", "active")


@_query("queue_size_over_time")
def _queue_size_over_time(spark, folder):
    return metrics.queue_sizes(_log(spark, folder)).select("at_us", "queue_size")


@_query("active_peak")
def _active_peak(spark, folder):
    return metrics.active_peak(_log(spark, folder)).select("peak", epoch_micros(F.col("first_at")).alias("first_us"))


@_query("throughput_gauges")
def _throughput_gauges(spark, folder):
    gauges = stats.throughput(outcomes.classify_fetch(_log(spark, folder)))
    return gauges.withColumn("value", F.round("value", 9))


def _rate_rows(rates: DataFrame) -> DataFrame:
    return rates.select(
        epoch_micros(F.col("window_start")).alias("start_us"),
        epoch_micros(F.col("window_end")).alias("end_us"),
        "source",
        "status",
        "requests",
        F.round("rate", 9).alias("rate"),
    )


@_query("request_rate_5m")
def _request_rate(spark, folder):
    return _rate_rows(metrics.request_rate(_results(spark, folder)))


# --- a whole crawl ------------------------------------------------------------------


@_query("scrape_batch")
def _scrape_batch(spark, folder):
    """Requests, the pages that were fetched for them, and what came of every task."""
    parts = table(spark, folder, "part").select(F.count("*")).scalar()
    events = table(spark, folder, "events")
    fetched = crawl_log(events).select(
        F.floor(F.col("log_id") / 5).cast("bigint").alias("request_id"),
        (F.col("log_id") % 5).cast("int").alias("pos"),
        (F.col("log_id") % parts).alias("page_id"),
        "url",
        "source",
        "http_status",
        "exception_class",
    )
    pages = book_pages(spark, folder).select("page_id", "html")
    results, rejected = scrape_batch(scrape_requests(events), fetched.join(pages, "page_id"))
    done = results.select("request_id", "pos", "status", "error_code", F.col("metadata.title").alias("title"), F.lit("").alias("reasons"))
    refused = rejected.select(
        "request_id", "pos", F.lit("rejected").alias("status"), F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("string").alias("title"), _joined("reasons").alias("reasons"),
    )
    return done.unionByName(refused).withColumn("pos", F.col("pos").cast("bigint"))


# --- pages ------------------------------------------------------------------------


@_query("dom_nodes")
def _dom_nodes(spark, folder):
    """Elements per page and tag."""
    nodes = dom.span_nodes(dom.element_spans(_pages(spark, folder)), text=False)
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@_query("dom_intervals")
def _dom_intervals(spark, folder):
    """Every element of every page with its interval, attributes and text."""
    nodes = dom.span_nodes(dom.element_spans(_pages(spark, folder)))
    attrs = F.array_sort(F.map_entries("attrs"))
    return nodes.select(
        "page_id",
        "node_id",
        "parent_id",
        "pre",
        "post",
        "tag",
        _joined(F.transform(attrs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("attrs"),
        "text",
    )


CSS = 'div.ad, article h1, nav a[href*="th"]'
COMBINED_CSS = "nav > ul > li:nth-child(2n+1) > a, li:last-child:not(:first-child) > a, nav + div.ad, nav ~ article > h1:first-child"


@_query("css_combinators")
def _css_combinators(spark, folder):
    """Elements by parent, neighbours and place among siblings."""
    return html.select_pages(_pages(spark, folder), COMBINED_CSS).select("page_id", "tag", "text")


@_query("css_select")
def _css_select(spark, folder):
    return html.select_pages(_pages(spark, folder), CSS).select("page_id", "tag", "text")


@_query("first_per_page")
def _first_per_page(spark, folder):
    first = html.first_of_pages(_pages(spark, folder), "a[href]")
    return first.select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href"), "text")


@_query("resolve_urls")
def _resolve_urls(spark, folder):
    """Links, images, canonical links, and references of every form against the log's URLs."""
    rendered = book_pages(spark, folder)
    canonical = html.page_metadata(rendered).select(
        F.lit("canonical").alias("kind"), F.col("page_id").alias("id"), F.try_element_at("metadata", F.lit("canonical_url")).alias("url")
    )
    n = F.col("log_id").cast("string")
    forms = [
        F.concat(F.lit("../c"), n), F.concat(F.lit("./x/../y"), n), F.concat(F.lit("?z="), n), F.lit("#s"),
        F.concat(F.lit("//g.example.org/"), n), F.concat(F.lit("/abs//"), n), F.lit("http://x.example.org/a/../b"),
        F.lit("mailto:a@example.org"), F.lit(""), F.concat(F.lit("../../../"), n, F.lit("/.")),
    ]
    log = _log(spark, folder)
    ref = F.get(F.array(*forms), (F.col("log_id") % len(forms)).cast("int"))
    references = log.select(
        "log_id", F.concat(F.col("url"), F.lit("?q=1#f")).alias("base"), ref.alias("ref")
    ).select(F.lit("reference").alias("kind"), F.col("log_id").alias("id"), resolve_url("base", "ref").alias("url"))
    found = html.links(_pages(spark, folder)).select(F.lit("link").alias("kind"), F.col("page_id").alias("id"), "url")
    shown = html.images(rendered).select(F.lit("image").alias("kind"), F.col("page_id").alias("id"), "url")
    return found.unionByName(shown).unionByName(canonical.filter("url IS NOT NULL")).unionByName(references)


@_query("extract_links")
def _extract_links(spark, folder):
    return html.links(_pages(spark, folder)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url", "text", "title")


@_query("extract_links_in_nav")
def _extract_links_in_nav(spark, folder):
    """Links by another base selector: those of menus, by a part of their address."""
    return html.links(_pages(spark, folder), "nav a[href^='/']").select("page_id", "url", "text")


@_query("extract_images")
def _extract_images(spark, folder):
    return html.images(book_pages(spark, folder)).select("page_id", "url", "alt", "title")


@_query("extract_metadata")
def _extract_metadata(spark, folder):
    crawled = html.page_metadata(_pages(spark, folder)).select(F.lit("pages").alias("input"), "page_id", F.explode("metadata"))
    rendered = html.page_metadata(book_pages(spark, folder)).select(
        F.lit("books").alias("input"), "page_id", F.explode("metadata")
    )
    return crawled.unionByName(rendered)


@_query("clean_documents")
def _clean_documents(spark, folder):
    documents = dirty_documents(table(spark, folder, "documents")).select(
        F.lit("document").alias("input"), F.col("doc_id").alias("id"), "text"
    )
    pages = _pages(spark, folder).select(F.lit("page").alias("input"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    cleaned = documents.unionByName(pages).withColumn("cleaned", clean_text(F.col("text")))
    return cleaned.select(
        "input", "id", "cleaned", (F.length("text") - F.length("cleaned")).cast("bigint").alias("chars_removed")
    )


def _item_text(name: str) -> Column:
    return F.try_variant_get("item", f'$["{name}"]', "string")


@_query("json_ld")
def _json_ld(spark, folder):
    items = html.json_ld(book_pages(spark, folder))
    return items.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        _item_text("@type").alias("type"),
        _item_text("name").alias("name"),
        _item_text("isbn").alias("isbn"),
        F.try_variant_get("item", "$.aggregateRating.ratingCount", "bigint").alias("rating_count"),
    )


@_query("microdata")
def _microdata(spark, folder):
    items = html.microdata(book_pages(spark, folder))
    return items.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.explode("item"))


@_query("structured_items")
def _structured_items(spark, folder):
    items = html.structured_items(book_pages(spark, folder))
    return items.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), _item_text("@type").alias("type"), _item_text("name").alias("name")
    )


@_query("parse_report")
def _parse_report(spark, folder):
    return html.parse_report(_pages(spark, folder))


@_query("link_rollup")
def _link_rollup(spark, folder):
    return html.link_rollup(html.links(_pages(spark, folder)))


# --- books ------------------------------------------------------------------------


def _flat_books(found: DataFrame) -> DataFrame:
    m = "metadata."
    return found.select(
        "page_id",
        "source",
        F.col(m + "title").alias("title"),
        _joined(m + "authors").alias("authors"),
        F.col(m + "isbn").alias("isbn"),
        F.col(m + "publisher").alias("publisher"),
        F.col(m + "description").alias("description"),
        F.col(m + "rating").alias("rating"),
        F.col(m + "rating_count").alias("rating_count"),
        F.col(m + "cover_image_url").alias("cover_image_url"),
        F.col(m + "source_url").alias("source_url"),
    )


@_query("books_structured")
def _books_structured(spark, folder):
    return _flat_books(books.books_structured(book_pages(spark, folder)))


@_query("books_html")
def _books_html(spark, folder):
    return _flat_books(books.books_html(book_pages(spark, folder)))


@_query("books")
def _books(spark, folder):
    return _flat_books(books.books(book_pages(spark, folder)))


@_query("book_defaults")
def _book_defaults(spark, folder):
    run_time = F.lit(SNAPSHOT).cast("timestamp_ntz")
    rows = books.with_defaults(books.books(book_pages(spark, folder)), run_time)
    return rows.select(
        "page_id",
        "id",
        "reading_status",
        "reading_progress",
        "current_page",
        _joined("collections").alias("collections"),
        _joined("tags").alias("tags"),
        "notes",
        F.to_json("custom_fields").alias("custom_fields"),
        epoch_micros(F.col("last_scraped_at")).alias("last_scraped_us"),
        "primary_source",
        _joined("sources").alias("sources"),
        "is_owned",
        "confidence_score",
        "data_completeness",
        epoch_micros(F.col("created_at")).alias("created_us"),
        epoch_micros(F.col("updated_at")).alias("updated_us"),
    )


@_query("book_validate")
def _book_validate(spark, folder):
    """Books with figures changed so that every range is broken by some."""
    k = F.col("page_id")
    found = books.with_defaults(books.books(book_pages(spark, folder)))
    changed = found.withColumn(
        "metadata",
        F.col("metadata")
        .withField("rating", (k % 8).cast("double"))
        .withField("price", (k % 7 - 1).cast("double"))
        .withField("review_count", k % 9 - 1)
        .withField("source_url", F.when(k % 10 == 0, F.lit("ftp://x/y")).otherwise(F.col("metadata.source_url"))),
    ).withColumn("confidence_score", k % 6 / 4)
    accepted, bad = validate.validate_books(changed)
    return (
        accepted.select("page_id", F.lit("").alias("reasons"))
        .unionByName(bad.select("page_id", _joined("reasons").alias("reasons")))
    )


@_query("book_completeness")
def _book_completeness(spark, folder):
    found = books.books(book_pages(spark, folder))
    return found.select("page_id", _r(books.completeness()).alias("completeness"))


@_query("book_consolidate")
def _book_consolidate(spark, folder):
    k = F.col("page_id")
    created = F.timestamp_add("MINUTE", k * 37 % 1000, F.lit(SNAPSHOT).cast("timestamp_ntz"))
    found = books.with_defaults(books.books(book_pages(spark, folder)), created).withColumn(
        "metadata", F.col("metadata").withField("isbn13", (k % 499).cast("string"))
    )
    merged = books.consolidate(found)
    return merged.select(
        "book_key",
        "primary_source",
        _joined("sources").alias("sources"),
        "copies",
        epoch_micros(F.col("created_at")).alias("created_us"),
        F.col("metadata.title").alias("title"),
        _joined("metadata.authors").alias("authors"),
        F.col("metadata.publisher").alias("publisher"),
        F.col("metadata.rating").alias("rating"),
        F.col("metadata.description").alias("description"),
        F.col("metadata.cover_image_url").alias("cover_image_url"),
    )


@_query("book_consolidate_linked")
def _book_consolidate_linked(spark, folder):
    """Books of which every copy shares an ISBN with one neighbour and a URL with the other; some lack one or both."""
    k = F.col("page_id")
    created = F.timestamp_add("MINUTE", k * 37 % 1000, F.lit(SNAPSHOT).cast("timestamp_ntz"))
    isbn13 = F.when(k % 7 != 0, F.concat(F.lit("978-0-"), F.lpad(F.floor(k / 2).cast("string"), 9, "0")))
    url = F.when(k % 5 != 0, F.concat(F.lit("https://books.example.com/c/"), F.floor((k + 1) / 2).cast("string")))
    unset = F.lit(None).cast("string")
    keyed = F.col("metadata").withField("isbn13", isbn13).withField("source_url", url).withField("isbn", unset)
    found = books.with_defaults(books.books(book_pages(spark, folder)), created).withColumn("metadata", keyed)
    return books.consolidate_linked(found).select(
        "key_kind",
        "book_key",
        "primary_source",
        _joined("sources").alias("sources"),
        "copies",
        epoch_micros(F.col("created_at")).alias("created_us"),
        F.col("metadata.title").alias("title"),
        F.col("metadata.publisher").alias("publisher"),
    )


@_query("book_search_indexed")
def _book_search_indexed(spark, folder):
    path = jobs.work_folder(spark, "index")
    search.write_index(books.with_defaults(books.books(book_pages(spark, folder))), path)
    parts = [
        search.search_index(spark, path, query, source).select(
            F.lit(query).alias("query"), "page_id", F.col("metadata.title").alias("title")
        )
        for query, source in (("Anvil", None), ("brand#2", "amazon"), ("#3", None), ("no such book", None))
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@_query("book_search")
def _book_search(spark, folder):
    found = books.with_defaults(books.books(book_pages(spark, folder)))
    return books.search(found, "Anvil").select("page_id", F.col("metadata.title").alias("title"))


@_query("book_search_source")
def _book_search_source(spark, folder):
    found = books.with_defaults(books.books(book_pages(spark, folder)))
    return books.search(found, "brand#2", source="amazon").select("page_id", F.col("metadata.title").alias("title"))


# --- limits -----------------------------------------------------------------------


@_query("domain_key")
def _domain_key(spark, folder):
    n, domain = F.col("log_id").cast("string"), F.col("domain")
    forms = [
        F.col("url"), F.concat(F.lit("http://user:pw@"), domain, F.lit(":8080/"), n), F.concat(F.lit("not a url "), n),
        F.lit("http://[broken/"), F.lit(None).cast("string"), F.concat(F.lit("//"), domain, F.lit("?q")),
    ]
    url = F.get(F.array(*forms), (F.col("log_id") % len(forms)).cast("int"))
    return _log(spark, folder).select("log_id", url.alias("asked")).select("log_id", domain_key("asked").alias("domain_key"))


def _audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("log_id", "ts", "domain", "source")


def _audited(spark: SparkSession, folder: str) -> DataFrame:
    return limits.token_bucket(_audit_rows(spark, folder), "domain", limit=AUDIT_LIMIT)


def _audit_result(audited: DataFrame) -> DataFrame:
    return audited.select(
        "log_id",
        "domain",
        "admitted",
        F.round("delay_seconds", 3).alias("delay_seconds"),
        _r("tokens_after").alias("tokens_after"),
    )


@_query("token_bucket")
def _token_bucket(spark, folder):
    return _audit_result(_audited(spark, folder))


@_query("nested_limits")
def _nested_limits(spark, folder):
    audited = limits.nested_token_bucket(_audit_rows(spark, folder), "domain", "source", AUDIT_LIMIT, OUTER_LIMIT)
    return audited.select("log_id", "admitted", F.round("delay_seconds", 3).alias("delay_seconds"), "blocked_by")


@_query("limiter_stats")
def _limiter_stats(spark, folder):
    found = limits.limiter_stats(_audited(spark, folder), limit=AUDIT_LIMIT)
    return found.withColumns({name: _r(name) for name in ("success_rate", "tokens_available", "requests_per_second")})


@_query("delay_histogram")
def _delay_histogram(spark, folder):
    return _rounded_histogram(metrics.delay_histogram(_audited(spark, folder)))


def _response_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("log_id", "ts", "domain", "source", "response_time_ms", "http_status")


@_query("rolling_response")
def _rolling_response(spark, folder):
    rolling = adaptive.rolling_response(_response_rows(spark, folder), "source", _seconds(), _success())
    return rolling.select(
        "log_id", "source", *[F.round(name, 9).alias(name) for name in ("avg_response_time", "avg_error_rate")]
    )


def _adapted(spark: SparkSession, folder: str) -> DataFrame:
    return adaptive.adaptive_rate(_response_rows(spark, folder), "domain", _seconds(), _success())


@_query("adaptive_rate")
def _adaptive_rate(spark, folder):
    return _adapted(spark, folder).select(
        "log_id", _r("adaptation_factor").alias("adaptation_factor"), _r("current_rate").alias("current_rate")
    )


@_query("adaptive_stats")
def _adaptive_stats(spark, folder):
    digits = {"adaptation_factor": 6, "current_rate": 6, "avg_response_time": 9, "avg_error_rate": 9}
    last = adaptive.adaptive_stats(_adapted(spark, folder), "domain")
    return last.select("domain", *[F.round(name, n).alias(name) for name, n in digits.items()])


# --- streams ----------------------------------------------------------------------


@_query("stream_request_rate")
def _stream_request_rate(spark, folder):
    results = outcomes.classify_fetch(crawl_log(_stream_log(spark, folder)))
    counts = jobs.drained_updates(counters.stream_step_counts(results), "rate", ["start", "source", "status"])
    return _rate_rows(counters.stream_request_rate(counts))


@_query("stream_late_rows")
def _stream_late_rows(spark, folder):
    """The log as it lands week by week; every tenth row is nine days under way."""
    path, events = jobs.work_folder(spark, "late"), table(spark, folder, "events")
    under_way = F.when(F.col("event_id") % 10 == 3, 9).otherwise(0)
    week = F.floor(epoch_micros(F.timestamp_add("DAY", under_way, F.col("ts"))) / 604_800_000_000)
    for w in sorted(r.w for r in events.select(week.alias("w")).distinct().collect()):
        events.filter(week == w).write.mode("append").parquet(f"{path}/landed")
        results = crawl_log(spark.readStream.schema(events.schema).parquet(f"{path}/landed"))
        jobs.drain(late.split_late(results, f"{path}/split", "1 day"), f"{path}/state")
    return late.late_counts(late.split_rows(spark, f"{path}/split", results))


@_query("stream_counters")
def _stream_counters(spark, folder):
    log = _with_body(_stream_log(spark, folder))
    results = outcomes.error_fields(outcomes.classify_fetch(log)).withColumn(
        "has_book", (F.col("status") == "success") & (F.col("log_id") % 6 != 5)
    )
    snapshot = jobs.drained_snapshot(counters.stream_counters(results), "counters")
    return counters.metric_rows(snapshot).withColumn("value", F.round("value", 3))


@_query("stream_token_bucket")
def _stream_token_bucket(spark, folder):
    log = crawl_log(_stream_log(spark, folder))
    audited = jobs.drained_table(stream_limits.stream_token_bucket(log, "domain", AUDIT_LIMIT), "bucket")
    return _audit_result(audited.select(F.col("id").alias("log_id"), F.col("key").alias("domain"), "admitted", "delay_seconds", "tokens_after"))


@_query("stream_token_bucket_runs")
def _stream_token_bucket_runs(spark, folder):
    path = jobs.work_folder(spark, "audit")
    log = crawl_log(_stream_log(spark, folder)).select("log_id", "ts", "domain")
    jobs.drain(stream_limits.audit_in_runs(log, "domain", AUDIT_LIMIT, path), f"{path}/state")
    return _audit_result(spark.read.parquet(f"{path}/rows"))


@_query("stream_adaptive")
def _stream_adaptive(spark, folder):
    path = jobs.work_folder(spark, "adaptive")
    log = crawl_log(_stream_log(spark, folder)).select("log_id", "ts", "domain", "response_time_ms", "http_status")
    jobs.drain(stream_limits.adapt_in_runs(log, "domain", _seconds(), _success(), path), f"{path}/state_of_stream")
    return spark.read.parquet(f"{path}/rows").select(
        "log_id", _r("adaptation_factor").alias("adaptation_factor"), _r("current_rate").alias("current_rate")
    )


@_query("stream_extract")
def _stream_extract(spark, folder):
    pages = stream_pages(spark, folder, "pages.parquet").select("page_id", "url", "html")
    titles = jobs.extract_new_pages(pages).select("page_id", "url", F.col("metadata.title").alias("title"))
    return jobs.drained_table(titles, "extract")


@_query("stream_links")
def _stream_links(spark, folder):
    pages = stream_pages(spark, folder, "pages.parquet").select("page_id", "url", "html")
    found = html.links(pages).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url", "text", "title")
    return jobs.drained_table(found, "links")


def titles_by_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Books found per domain of a page table: read, extract, count."""
    found = books.books(_pages(prepare(spark), folder)).withColumn("domain", domain_key("url"))
    return found.groupBy("domain").agg(F.count("*").alias("books"))
