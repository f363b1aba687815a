"""Selection and extraction over page elements.

`nodes` arguments are element rows (`dom_nodes`); `doms` arguments are page rows
with a `nodes` array (`shred`). The latter work inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookweir.functions import selectors
from bookweir.functions.arrays import attribute, hold, quote, struct, with_runs
from bookweir.functions.selectors import AttrTest, Simple
from bookweir.functions.urls import domain_key, resolve_url, resolved
from bookweir.operators.dom import shred

LINK_KEEP = [Simple("a", (AttrTest("href", "has"),))]
IMAGE_KEEP = [Simple("img", (AttrTest("src", "has"),))]
METADATA_KEEP = selectors.element_tests("meta", "title", "link[rel]")
JSON_LD_CSS = 'script[type="application/ld+json"]'
MICRODATA_KEEP = selectors.element_tests("[itemtype]", "[itemprop]")
STRUCTURED_KEEP = [*selectors.element_tests(JSON_LD_CSS), *MICRODATA_KEEP]

# Attributes that hold a list of tokens.
_TOKEN_LISTS = {"class", "rel", "rev", "headers"}


def _filled(value: str) -> str:
    return f"coalesce({value} <> '', false)"


def select(nodes: DataFrame, css: str) -> DataFrame:
    """All elements that match, each once.

    "Inside an outer match" is a running maximum over the page: an earlier
    element encloses this one exactly when its `post` is the larger. So a
    descendant selector needs one sort per page, not a range join.
    """
    if not selectors.plain(css):
        raise ValueError("siblings and parents are looked up in the page's row: use select_pages")
    chains = selectors.parse(css)
    before = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.filter(selectors.predicate([simple for chain in chains for simple in chain]))
    hits = []
    for c, chain in enumerate(chains):
        inside = "true"
        for depth, simple in enumerate(chain):
            hit = f"({selectors.predicate([simple])} AND {inside})"
            if depth == len(chain) - 1:
                hits.append(hit)
                continue
            inside = f"_in_{c}_{depth}"
            outer_post = F.max(F.expr(f"CASE WHEN {hit} THEN post END")).over(before)
            out = out.withColumn(inside, F.coalesce(outer_post > F.col("post"), F.lit(False)))
    return out.filter(" OR ".join(hits)).select(*nodes.columns)


def descendants(nodes: DataFrame, outer_css: str, inner_css: str) -> DataFrame:
    """Elements matching `inner_css` inside one matching `outer_css`."""
    return select(nodes, f"{outer_css} {inner_css}")


def _has_attributes(wanted: dict[str, str], node: str | None = None) -> str:
    prefix, checks = f"{node}." if node else "", ["true"]
    for name, value in wanted.items():
        found = f"try_element_at({prefix}attrs, {quote(name)})"
        same = f"{found} = {quote(value)}"
        if name in _TOKEN_LISTS:
            same = rf"({same} OR array_contains(split({found}, r'\s+'), {quote(value)}))"
        checks.append(f"coalesce({same}, false)")
    return " AND ".join(checks)


def find_all(nodes: DataFrame, tag: str, attrs: dict[str, str] | None = None) -> DataFrame:
    """Every element of each page by tag and attribute equality."""
    return nodes.filter(F.col("tag") == tag).filter(_has_attributes(attrs or {}))


def first_match(nodes: DataFrame, tag: str, attrs: dict[str, str] | None = None) -> DataFrame:
    """First element of each page by tag and attribute equality."""
    rest = [name for name in nodes.columns if name != "page_id"]
    first = find_all(nodes, tag, attrs).groupBy("page_id").agg(F.min_by(F.struct(*rest), F.col("pre")).alias("first"))
    return first.select("page_id", *[F.col(f"first.{name}").alias(name) for name in rest])


_NODE = ["pre", "post", "tag", "attrs", "text"]


def select_pages(pages: DataFrame, css: str) -> DataFrame:
    """All elements of each page that match, each once, found in the page's own row."""
    doms = shred(pages.select("page_id", "html"), selectors.element_tests(css))
    return doms.select("page_id", F.explode(F.expr(selectors.matching(css))).alias("n")).select(
        "page_id", *[F.col(f"n.{name}").alias(name) for name in _NODE]
    )


def first_of_pages(pages: DataFrame, css: str) -> DataFrame:
    """First element of each page that matches, in the page's own row; pages without one are left out."""
    doms = shred(pages.select("page_id", "html"), selectors.element_tests(css))
    first = doms.select("page_id", F.expr(f"get({selectors.matching(css)}, 0)").alias("n")).filter("n IS NOT NULL")
    return first.select("page_id", *[F.col(f"n.{name}").alias(name) for name in _NODE])


def _elements(pages: DataFrame, keep: list[Simple], css: str, needed: str) -> DataFrame:
    """Page rows exploded to the elements that match and have a filled `needed` attribute."""
    doms = shred(pages.select("page_id", "url", "html"), keep)
    found = F.expr(f"filter({selectors.matching(css)}, n -> {_filled(attribute('n', needed))})")
    return doms.select("page_id", F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "n"))


def links(pages: DataFrame, css: str = "a") -> DataFrame:
    """One row per selected element with a non-empty `href`: absolute url, text, title."""
    keep = LINK_KEEP if css == "a" else selectors.element_tests(css)
    return _elements(pages, keep, css, "href").select(
        "page_id",
        "page_url",
        "pos",
        resolve_url("page_url", attribute("n", "href")).alias("url"),
        F.col("n.text").alias("text"),
        F.expr(f"coalesce({attribute('n', 'title')}, '')").alias("title"),
    )


def images(pages: DataFrame, css: str = "img") -> DataFrame:
    """One row per selected element with a non-empty `src`: absolute url, alt, title."""
    keep = IMAGE_KEEP if css == "img" else selectors.element_tests(css)
    return _elements(pages, keep, css, "src").select(
        "page_id",
        "page_url",
        "pos",
        resolve_url("page_url", attribute("n", "src")).alias("url"),
        F.expr(f"coalesce({attribute('n', 'alt')}, '')").alias("alt"),
        F.expr(f"coalesce({attribute('n', 'title')}, '')").alias("title"),
    )


_META_KEY = f"lower(coalesce(nullif({attribute('n', 'name')}, ''), {attribute('n', 'property')}))"
_META_ENTRIES = f"""filter(
  transform(filter(nodes, n -> n.tag = 'meta'), n -> {struct(key=_META_KEY, value=attribute('n', 'content'))}),
  e -> {_filled('e.key')} AND {_filled('e.value')})"""
_TITLE_ENTRY = f"""transform(slice(filter(nodes, n -> n.tag = 'title'), 1, 1),
  n -> {struct(key="'title'", value='n.text')})"""
_CANONICAL_ENTRY = f"""transform(
  filter(slice(filter(nodes, n -> n.tag = 'link' AND {_has_attributes({'rel': 'canonical'}, 'n')}), 1, 1),
    n -> {_filled(attribute('n', 'href'))}),
  n -> {struct(key="'canonical_url'", value=resolved('url', attribute('n', 'href')))})"""


def with_metadata(doms: DataFrame) -> DataFrame:
    """Add `page_meta`, the page's metadata map; needs `METADATA_KEEP` elements and `url`.

    A later entry wins, then `<title>` (also an empty one), then the canonical link.
    """
    out = doms.withColumn("_entries", F.expr(f"concat({_META_ENTRIES}, {_TITLE_ENTRY}, {_CANONICAL_ENTRY})"))
    ranked = struct(key="e.key", rank="i", value="e.value")
    out = out.withColumn("_sorted", F.expr(f"array_sort(transform(_entries, (e, i) -> {ranked}))"))
    out = with_runs(out, "_runs", "_sorted", "a.key = b.key")
    last = f"transform(_runs, run -> {struct(key='element_at(run, -1).key', value='element_at(run, -1).value')})"
    return hold(out, page_meta=f"map_from_entries({last})").drop("_entries", "_sorted", "_runs")


def page_metadata(pages: DataFrame) -> DataFrame:
    """Metadata map of every page."""
    doms = shred(pages.select("page_id", "url", "html"), METADATA_KEEP)
    return with_metadata(doms).select("page_id", F.col("page_meta").alias("metadata"))


# JSON-LD values of a page as array<variant>; arrays flattened, bad JSON skipped.
_JSON_LD_ITEMS = f"""flatten(transform(
  filter(
    transform(
      filter(nodes, n -> n.tag = 'script' AND {_has_attributes({'type': 'application/ld+json'}, 'n')}),
      n -> try_parse_json(n.text)),
    v -> v IS NOT NULL),
  v -> CASE WHEN startswith(schema_of_variant(v), 'ARRAY') THEN cast(v AS array<variant>) ELSE array(v) END))"""

_PROPERTY_VALUE = f"coalesce(nullif(n.text, ''), {attribute('n', 'content')})"
_PROPERTIES = f"""filter(
  transform(filter(nodes, n -> {_filled(attribute('n', 'itemprop'))}),
    n -> {struct(up='n.up', pre='n.pre', key=attribute('n', 'itemprop'), value=_PROPERTY_VALUE)}),
  p -> {_filled('p.value')})"""
_SCOPES = f"""transform(filter(nodes, n -> {attribute('n', 'itemtype')} IS NOT NULL),
  n -> {struct(key='n.pre', value=attribute('n', 'itemtype'))})"""
_PAIRS = f"""array_sort(flatten(transform(_props,
  p -> transform(array_intersect(p.up, map_keys(_types)),
    s -> {struct(scope='s', key='p.key', pre='p.pre', value='p.value')}))))"""
_ITEM_ENTRIES = f"""concat(
  filter(
    array({struct(key="'@type'", value='element_at(_types, run[0].scope)')},
      {struct(key="'@context'", value="'http://schema.org'")}),
    e -> NOT exists(run, r -> r.key = e.key)),
  transform(run, r -> {struct(key='r.key', value='r.value')}))"""
_ITEMS = f"""filter(
  transform(_items, run -> {struct(pre='run[0].scope', item=f'map_from_entries({_ITEM_ENTRIES})')}),
  i -> size(i.item) > 2)"""


def _with_microdata(doms: DataFrame) -> DataFrame:
    """Add `microdata`: one struct per `[itemtype]` element, in document order.

    Every property joins each of its enclosing items, which are named in the
    element itself (`up`), so only true pairs are formed.
    """
    out = doms.withColumns({"_types": F.expr(f"map_from_entries({_SCOPES})"), "_props": F.expr(_PROPERTIES)})
    out = with_runs(out.withColumn("_pairs", F.expr(_PAIRS)), "_keys", "_pairs", "a.scope = b.scope AND a.key = b.key")
    out = out.withColumn("_last", F.expr("transform(_keys, run -> element_at(run, -1))"))
    out = with_runs(out, "_items", "_last", "a.scope = b.scope")
    return hold(out, microdata=_ITEMS).drop("_types", "_props", "_pairs", "_keys", "_last", "_items")


def with_structured_items(doms: DataFrame) -> DataFrame:
    """Add `items` array<variant>: JSON-LD first, then microdata; needs `STRUCTURED_KEEP` elements."""
    described = "transform(microdata, m -> to_variant_object(m.item))"
    return hold(_with_microdata(doms), items=f"concat({_JSON_LD_ITEMS}, {described})")


def json_ld(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD item."""
    doms = shred(pages.select("page_id", "html"), selectors.element_tests(JSON_LD_CSS))
    return doms.select("page_id", F.posexplode(F.expr(_JSON_LD_ITEMS)).alias("pos", "item"))


def microdata(pages: DataFrame) -> DataFrame:
    """One row per microdata item with its properties."""
    found = _with_microdata(shred(pages.select("page_id", "html"), MICRODATA_KEEP))
    return found.select("page_id", F.posexplode("microdata").alias("pos", "m")).select(
        "page_id", "pos", F.col("m.item").alias("item")
    )


def structured_items(pages: DataFrame) -> DataFrame:
    """One row per structured item in page order: JSON-LD, then microdata."""
    doms = shred(pages.select("page_id", "html"), STRUCTURED_KEEP)
    return with_structured_items(doms).select("page_id", F.posexplode("items").alias("pos", "item"))


def parse_report(pages: DataFrame) -> DataFrame:
    """Per page: html length, URL, whether it could be read."""
    sized = pages.select("page_id", "url", F.length("html").cast("bigint").alias("html_length"), "html")
    return shred(sized, []).select("page_id", "url", "html_length", F.col("nodes").isNotNull().alias("parsed"))


def link_rollup(found: DataFrame) -> DataFrame:
    """Links per page, target and target domain as one long table (scope, key, links, others).

    `others` counts distinct targets of a page, and pages linking to a target or
    domain. The links are first reduced to (page, target) counts, so a target
    that receives a third of all links is combined before its rows meet. All
    three levels read the same shuffled counts: the pages are parsed once.
    """
    pairs = found.groupBy("page_id", "url").agg(F.count("*").alias("n")).withColumn("domain", domain_key("url"))
    by_domain = pairs.groupBy("domain", "page_id").agg(F.sum("n").alias("n"))
    levels = [
        pairs.groupBy(F.lit("page").alias("scope"), F.col("page_id").cast("string").alias("key")),
        pairs.groupBy(F.lit("target").alias("scope"), F.col("url").alias("key")),
        by_domain.groupBy(F.lit("domain").alias("scope"), F.col("domain").alias("key")),
    ]
    page, target, domain = [level.agg(F.sum("n").alias("links"), F.count("*").alias("others")) for level in levels]
    return page.unionByName(target).unionByName(domain)
