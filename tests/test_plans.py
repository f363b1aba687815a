"""What the plans must look like to hold at scale."""

import re

import pytest

import __spark_entry__ as entry
from bookweir.operators import books, dom, html, metrics
from bookweir.sources.pages import load_pages
from bookweir.sources.tables import crawl_log, table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark, folder):
    return load_pages(spark, f"{folder}/pages.parquet")


def test_books_read_each_page_once_and_move_nothing(pages):
    plan = _plan(books.books(pages))
    assert plan.count("MapInArrow") == 1
    assert "Exchange" not in plan and "Join" not in plan


def test_links_need_no_shuffle(pages):
    assert "Exchange" not in _plan(html.links(pages))


@pytest.mark.parametrize("css", ["nav a", "a, h1, .ad", "article p b"])
def test_selection_needs_no_shuffle(pages, css):
    for found in (html.select_pages(pages, css), html.first_of_pages(pages, css), html.links(pages, css)):
        plan = _plan(found)
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


def test_descendants_are_one_shuffle_and_no_join(pages):
    plan = _plan(html.descendants(dom.dom_nodes(dom.shred(pages)), "nav", "a"))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_metrics_read_only_their_columns(spark, folder):
    events = table(spark, folder, "events")
    log = crawl_log(events).filter("source = 'amazon'")
    schema = re.findall(r"ReadSchema: (\S+)", _plan(metrics.size_histogram(log)))
    assert schema == ["struct<user_id:bigint,value:double>"]
    schema = re.findall(r"ReadSchema: (\S+)", _plan(crawl_log(events.filter("value > 60")).groupBy("source").count()))
    assert schema == ["struct<user_id:bigint,value:double>"]
    assert "GreaterThan(value,60.0)" in _plan(crawl_log(events.filter("value > 60")))


CHEAP = ["active_requests", "request_rate_5m", "job_performance", "book_consolidate", "link_rollup", "css_select", "limit_lookup_suffix", "job_lifecycle"]


@pytest.mark.parametrize("name", CHEAP)
def test_no_pairs(spark, folder, name):
    plan = _plan(entry.queries()[name](spark, folder))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["active_requests", "link_rollup"])
def test_levels_share_one_scan(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 2


def test_fetches_of_rejected_tasks_are_told_before_pages_are_read(spark, folder):
    """By narrow rows, below the join that brings the pages and below the step that reads them."""
    found = entry.queries()["scrape_batch"](spark, folder)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = {name: next(i for i, line in enumerate(lines) if name in line) for name in ("MapInArrow", "Join Inner", "Join LeftSemi")}
    assert at["MapInArrow"] < at["Join Inner"] < at["Join LeftSemi"]


def test_books_tied_by_several_keys_read_each_page_once(spark, folder):
    plan = _plan(entry.queries()["book_consolidate_linked"](spark, folder))
    assert "MapInArrow" not in plan
