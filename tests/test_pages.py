import json

import pytest
from pyspark.sql import functions as F

from bookweir.operators import books, dom, html
from bookweir.operators.validate import validate_books
from bookweir.plans.crawl import scrape_batch
from bookweir.schemas import METADATA
from bookweir.sources.pages import load_pages, stream_pages
from bookweir.sources.tables import book_pages
from bookweir.streaming import jobs


def _pages(spark, *texts, url="https://books.example.com/b/1"):
    return spark.createDataFrame([(i, url, t) for i, t in enumerate(texts)], "page_id bigint, url string, html string")


def _nodes(spark, text):
    rows = dom.dom_nodes(dom.shred(_pages(spark, text))).orderBy("pre").collect()
    return [(r.tag, r.parent_id, r.text) for r in rows]


def test_tree_recovery(spark):
    assert _nodes(spark, "<div><p><b>one<br><p>two</div>tail") == [
        ("div", None, "onetwo"), ("p", 0, "one"), ("b", 1, "one"), ("br", 2, ""), ("p", 0, "two"),
    ]
    assert _nodes(spark, "<ul><li>a<ul><li>b</ul><li>c</ul>") == [
        ("ul", None, "abc"), ("li", 0, "ab"), ("ul", 1, "b"), ("li", 2, "b"), ("li", 0, "c"),
    ]
    assert _nodes(spark, '<script>var t="</p>";</script><p>x</b></p>&amp;') == [
        ("script", None, 'var t="</p>";'), ("p", None, "x"),
    ]
    assert [n[0] for n in _nodes(spark, "<table><tr><td>1<td>2<tr><th>3</table><hr/><img src=a>")] == [
        "table", "tr", "td", "td", "tr", "th", "hr", "img",
    ]
    assert _nodes(spark, "<![if x]><p>a<!-- <b> --></p>") == [("p", None, "a")]


def test_attributes(spark):
    r = dom.dom_nodes(dom.shred(_pages(spark, '<a HREF="x&amp;y" href="z" hidden>t</a>'))).collect()[0]
    assert r.attrs == {"href": "x&y", "hidden": ""}


def test_intervals_nest(spark, folder):
    nodes = dom.dom_nodes(dom.shred(load_pages(spark, f"{folder}/pages.parquet").limit(5))).collect()
    for page in {n.page_id for n in nodes}:
        own = {n.node_id: n for n in nodes if n.page_id == page}
        assert sorted(own) == list(range(len(own))) == sorted(n.post for n in own.values())
        for n in own.values():
            if n.parent_id is not None:
                parent = own[n.parent_id]
                assert parent.pre < n.pre and parent.post > n.post


def test_spans_are_the_same_elements(spark, folder):
    odd = _pages(spark, "<div> \u00a0<p><b>one &amp;<br><p>two \x1c</div>tail", "", "text only", None, "<p>x" * 50)
    for pages in (odd, load_pages(spark, f"{folder}/pages.parquet")):
        spans = dom.span_nodes(dom.element_spans(pages)).collect()
        key = lambda r: (r.page_id, r.pre)
        assert sorted(spans, key=key) == sorted(dom.dom_nodes(dom.shred(pages)).collect(), key=key)
    texts = {r.page_id: (r.page_text, r.spans is None) for r in dom.element_spans(odd).collect()}
    assert texts[1] == ("", False) and texts[2] == ("text only", False) and texts[3] == (None, True)


def test_deep_pages_cost_their_length(spark):
    deep = 100_000
    nodes = dom.span_nodes(dom.element_spans(_pages(spark, "<div>x" * deep)), text=False)
    r = nodes.agg(F.count("*"), F.min(F.col("post") + F.col("pre")), F.max(F.col("post") + F.col("pre")), F.max("parent_id")).collect()[0]
    assert tuple(r) == (deep, deep - 1, deep - 1, deep - 2)


def test_unreadable_and_empty_pages(spark):
    rows = {r.page_id: (r.html_length, r.parsed) for r in html.parse_report(_pages(spark, None, "", "<p>")).collect()}
    assert rows == {0: (None, False), 1: (0, True), 2: (3, True)}
    assert books.books(_pages(spark, None, "")).count() == 0


def test_select_equals_a_walk_up_the_tree(spark):
    text = (
        '<div class="cover x"><p><img id=1></p><div class="Cover"><img id=2></div></div><img id=3 class="mycover">'
        '<section class="covers"><img id=4></section><p class="cover"><i><b><img id=5></b></i></p><img id=6>'
    )
    nodes = dom.dom_nodes(dom.shred(_pages(spark, text, text)))

    def ids(css):
        found = html.select(nodes, css).select("page_id", F.col("attrs")["id"].alias("id")).collect()
        assert {r.id for r in found if r.page_id == 0} == {r.id for r in found if r.page_id == 1}
        return sorted(r.id for r in found if r.page_id == 0)

    assert ids(".cover img") == ["1", "2", "5"]
    assert ids('img[class*="cover"], .cover img, .Cover img') == ["1", "2", "3", "5"]
    assert ids(".cover i img") == ["5"] and ids(".cover div img") == ["2"] and ids("i p img") == []
    assert ids('[id="4"]') == ["4"] and ids("div div img[id]") == ["2"] and ids('img[class*=""]') == []
    assert html.descendants(nodes, "div", "img").count() == 4
    assert html.find_all(nodes, "img", {"class": "mycover"}).count() == 2
    assert [r.attrs["id"] for r in html.first_match(nodes, "img").collect()] == ["1", "1"]


def test_links_and_images(spark):
    text = '<a href="">no</a><a>no</a><a href="../x" title="t"> in <b>side</b> </a><img src=""><img src="i.png" alt="A">'
    pages = _pages(spark, text)
    assert [tuple(r) for r in html.links(pages).select("pos", "url", "text", "title").collect()] == [
        (0, "https://books.example.com/x", "in side", "t")
    ]
    assert [tuple(r) for r in html.images(pages).select("url", "alt", "title").collect()] == [
        ("https://books.example.com/b/i.png", "A", "")
    ]


def _meta(spark, text):
    return html.page_metadata(_pages(spark, text)).collect()[0].metadata


def test_metadata_precedence(spark):
    assert _meta(spark, "<meta name=A content=1><meta property=a content=2><meta name=b content=''><meta name='' property=C content=3>") == {"a": "2", "c": "3"}
    assert _meta(spark, "<meta name=title content=meta><title> Head </title><title>two</title>") == {"title": "Head"}
    assert _meta(spark, "<title></title><meta name=title content=meta>") == {"title": ""}
    assert _meta(spark, '<link rel="x canonical" href="/c"><link rel=canonical href="/d">') == {
        "canonical_url": "https://books.example.com/c"
    }
    assert _meta(spark, "<link rel=canonical>") == {}


def _ld(*texts):
    return "".join(f'<script type="application/ld+json">{t}</script>' for t in texts)


def test_json_ld_flattens_and_skips(spark):
    page = _ld('[{"a":1},{"a":2}]', "{bad", '{"a":3}', "7", '{"a":1,"a":2}')
    items = html.json_ld(_pages(spark, page)).select("pos", F.to_json("item").alias("j")).orderBy("pos").collect()
    assert [r.j for r in items] == ['{"a":1}', '{"a":2}', '{"a":3}', "7"]


def test_microdata_items(spark):
    page = (
        '<div itemtype="T"><i itemprop=a>1</i><i itemprop=a>2</i><b itemtype="U"><i itemprop=c>3</i></b>'
        '<meta itemprop=d content=4><img itemprop=e src=x></div><p itemtype="V"><i itemprop=z></i></p><i itemprop=q>5</i>'
    )
    rows = html.microdata(_pages(spark, page)).orderBy("pos").collect()
    context = {"@context": "http://schema.org"}
    assert [r["item"] for r in rows] == [
        {"@type": "T", **context, "a": "2", "c": "3", "d": "4"},
        {"@type": "U", **context, "c": "3"},
    ]


def test_structured_items_put_json_ld_first(spark):
    page = '<div itemtype="T"><i itemprop=name>m</i></div>' + _ld('{"name":"j"}')
    rows = html.structured_items(_pages(spark, page)).orderBy("pos").select(F.expr("try_variant_get(item, '$.name', 'string')")).collect()
    assert [r[0] for r in rows] == ["j", "m"]


VALID = {"@type": "Book", "name": "N", "image": "https://i/x", "url": "https://u/x"}


def _structured(spark, items, **options):
    pages = _pages(spark, *[_ld(json.dumps(item)) for item in items])
    return {r.page_id: r.metadata for r in books.books_structured(pages, **options).collect()}


def test_structured_acceptance(spark):
    accepted = [
        ({}, lambda m: m.title == "N" and m.authors == [""] and m.isbn == "" and m.rating is None),
        ({"@type": "http://schema.org/Book"}, lambda m: m.title == "N"),
        ({"author": ["a", "b"]}, lambda m: m.authors == ["a", "b"]),
        ({"author": "a"}, lambda m: m.authors == ["a"]),
        ({"author": []}, lambda m: m.authors == []),
        ({"isbn": None}, lambda m: m.isbn is None),
        ({"publisher": {"name": "P"}}, lambda m: m.publisher == "P"),
        ({"publisher": {}}, lambda m: m.publisher == ""),
        ({"publisher": {"name": None}}, lambda m: m.publisher is None),
        ({"publisher": "P"}, lambda m: m.publisher == "P"),
        ({"image": None}, lambda m: m.cover_image_url is None),
        ({"aggregateRating": {}}, lambda m: m.rating is None),
        ({"aggregateRating": 0}, lambda m: m.rating is None),
        ({"aggregateRating": {"ratingValue": "4.5", "ratingCount": "12"}}, lambda m: (m.rating, m.rating_count) == (4.5, 12)),
        ({"aggregateRating": {"ratingValue": 4, "ratingCount": 12.9}}, lambda m: (m.rating, m.rating_count) == (4.0, 12)),
        ({"aggregateRating": {"x": 1}}, lambda m: (m.rating, m.rating_count) == (0.0, 0)),
        ({"identifier": "id1"}, lambda m: m.source_id == "id1"),
    ]
    got = _structured(spark, [{**VALID, **change} for change, _ in accepted])
    for i, (change, check) in enumerate(accepted):
        assert i in got and check(got[i]), change


def test_structured_rejections(spark):
    changes = [
        {"@type": "Thing"}, {"@type": ["Book"]}, {"@type": "https://schema.org/Book"}, {"name": None}, {"name": 5},
        {"author": {"name": "a"}}, {"author": None}, {"author": ["a", 1]}, {"author": ["a", None]}, {"author": 3},
        {"isbn": 123}, {"description": ["d"]}, {"publisher": {"name": 1}}, {"publisher": 5}, {"image": ""},
        {"image": "ftp://x/y"}, {"image": ["https://i/x"]}, {"url": "nothing"}, {"aggregateRating": "4"},
        {"aggregateRating": [1]}, {"aggregateRating": {"ratingValue": 6}}, {"aggregateRating": {"ratingValue": -1}},
        {"aggregateRating": {"ratingValue": None}}, {"aggregateRating": {"ratingValue": "4,5"}},
        {"aggregateRating": {"ratingCount": "1,234"}}, {"aggregateRating": {"ratingCount": "4.0"}},
        {"aggregateRating": {"ratingCount": -1}}, {"aggregateRating": {"ratingValue": "NaN"}},
    ]
    missing = [{k: v for k, v in VALID.items() if k != name} for name in ("image", "url")]
    got = _structured(spark, [{**VALID, **change} for change in changes] + missing)
    assert got == {}
    lenient = _structured(spark, missing, strict_urls=False)
    assert lenient[0].cover_image_url is None and lenient[1].source_url is None
    assert len(_structured(spark, [{**VALID, "@type": "https://schema.org/Book"}], extended_types=True)) == 1


def test_first_acceptable_item_wins(spark):
    page = _ld(json.dumps([{**VALID, "isbn": 1}, {**VALID, "name": "second"}, VALID]))
    assert [r.metadata.title for r in books.books(_pages(spark, page)).collect()] == ["second"]


def _html_book(spark, text):
    rows = books.books_html(_pages(spark, text)).collect()
    return rows[0].metadata if rows else None


def test_selector_rules(spark):
    m = _html_book(
        spark,
        "<title></title><h2>second</h2><h1>first</h1><p class=bookAuthor>A</p><p class='x author'>A</p>"
        f"<p class=author>{'y' * 100}</p><p class=author> </p><p class=description>{'d' * 20}</p><p class=aDescription>{'e' * 21}</p>"
        "<div class=cover><img src='/no.png'><img src='/COVER.png'></div>",
    )
    assert (m.title, m.authors, m.description) == ("first", ["A", "A"], "e" * 21)
    assert m.cover_image_url == "https://books.example.com/COVER.png"
    assert _html_book(spark, "<h2>only</h2>").title == "only"
    assert _html_book(spark, "<p>nothing</p>") is None
    assert _html_book(spark, "<h1>t</h1><img class=bookcover src=a.png alt='the Cover'>").cover_image_url.endswith("/b/a.png")
    assert _html_book(spark, "<h1>t</h1><img class=cover src='data:image/cover'>") is None
    assert _html_book(spark, "<h1>t</h1><p class=AUTHOR>x</p><img class=COVER src=cover.png>").authors == []


def test_quarantine_keeps_every_row(spark, folder):
    found = books.with_defaults(books.books(book_pages(spark, folder)))
    broken = found.withColumn("metadata", F.col("metadata").withField("rating", (F.col("page_id") % 9).cast("double")))
    ok, bad = validate_books(broken)
    assert ok.count() + bad.count() == found.count() and bad.filter("size(reasons) = 0").count() == 0


def test_consolidated_sources(spark):
    pages = _pages(spark, *[_ld(json.dumps({**VALID, "name": n, "isbn13": "x", "description": d})) for n, d in (("a", ""), ("b", "D"))])
    pages = pages.withColumn("source", F.when(F.col("page_id") == 0, "unknown").otherwise("amazon"))
    row = books.consolidate(books.with_defaults(books.books(pages))).collect()[0]
    assert (row.book_key, row.primary_source, row.sources, row.copies) == ("x", "unknown", ["amazon", "unknown"], 2)
    assert (row.metadata.title, row.metadata.description) == ("a", "D")


def test_batch_results(spark):
    requests = spark.createDataFrame(
        [(1, ["https://h/1", "https://h/2", "https://h/3", "https://h/4", "oops", "https://h/1"], "amazon", 5)],
        "request_id int, urls array<string>, source string, priority int",
    )
    fetches = spark.createDataFrame(
        [
            (1, 0, 1, "https://h/1", "amazon", 200, None, "<title>T</title>"),
            (1, 1, 2, "https://h/2", "amazon", 200, None, "<p>nothing</p>"),
            (1, 2, 3, "https://h/3", "amazon", 404, None, "gone"),
            (1, 5, 4, "https://h/1", "amazon", 200, None, ""),
        ],
        "request_id int, pos int, page_id int, url string, source string, http_status int, exception_class string, html string",
    )
    results, rejected = scrape_batch(requests, fetches)
    got = {r.pos: (r.status, r.metadata and r.metadata.title, r.error_code) for r in results.collect()}
    assert got == {
        0: ("success", "T", None),
        1: ("partial", None, None),
        2: ("failed", None, "HTTP_404"),
        3: (None, None, None),
        5: ("success", None, None),
    }
    assert [r.url for r in rejected.collect()] == ["oops"]
    clashing = requests.withColumns({"metadata": F.lit("m"), "page_id": F.lit(7), "html": F.lit("h")})
    again = scrape_batch(clashing, fetches)[0].select("pos", "status", "metadata.title", "task_metadata").collect()
    assert {r.pos: r.title for r in again} == {pos: title for pos, (_, title, _) in got.items()}
    assert {r.task_metadata for r in again} == {"m"}


def test_new_pages_equal_one_run(spark, folder, tmp_path):
    pages = load_pages(spark, f"{folder}/pages.parquet").drop("data_size_bytes")
    pages.repartition(3, "page_id").write.parquet(str(tmp_path / "pages"))
    stream = stream_pages(spark, str(tmp_path / "pages"), per_trigger=1).drop("data_size_bytes")
    title = F.col("metadata.title").alias("title")
    got = jobs.drained_table(jobs.extract_new_pages(stream).select("page_id", title), "books")
    expected = books.extract_books(pages).select("page_id", title)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert jobs.drained_table(html.links(stream), "links").count() == html.links(pages).count()


def test_selectors_in_the_row_agree_with_those_over_elements(spark):
    page = """<div id="top"><nav class="a b"><a href="/x y" title="p, q">one</a><div><a href="/z">two</a></div></nav>
    <p><a href="http://h/z" data-k="v">three</a></p></div><a>four</a>"""
    pages = spark.createDataFrame([(1, "http://h/", page), (2, "http://h/", None)], "page_id int, url string, html string")
    texts = {
        "a": ["one", "two", "three", "four"],
        "nav a": ["one", "two"],
        "#top a[href]": ["one", "two", "three"],
        "div.none a, p a": ["three"],
        "nav div a": ["two"],
        "a[title='p, q']": ["one"],
        'a[href="/x y"], a[data-k="v"]': ["one", "three"],
        "a[href^='/']": ["one", "two"],
        "a[href$=z]": ["two", "three"],
        "nav[class~=b] a": ["one", "two"],
    }
    for css, wanted in texts.items():
        assert [r.text for r in html.select_pages(pages, css).orderBy("pre").collect()] == wanted, css
        nodes = dom.dom_nodes(dom.shred(pages, html.selectors.element_tests(css)))
        assert [r.text for r in html.select(nodes, css).orderBy("pre").collect()] == wanted, css
        assert [r.text for r in html.first_of_pages(pages, css).collect()] == wanted[:1]
    assert [r.url for r in html.links(pages, "nav div a").collect()] == ["http://h/z"]


def test_selectors_outside_the_subset_are_refused():
    for css in ("ul > > li", "", "a,", "a[", "a:hover"):
        with pytest.raises(ValueError):
            html.selectors.parse(css)


def test_books_of_one_isbn_meet_and_others_do_not(spark):
    rows = [(1, "A", "0-306-40615-2", None), (2, "B", None, "9780306406157"), (9780306406157, "C", None, None), (4, "D", "080442957X", None)]
    frame = spark.createDataFrame(rows, "page_id long, title string, isbn10 string, isbn13 string")
    unset = [F.lit(None).cast(f.dataType).alias(f.name) for f in METADATA if f.name not in frame.columns]
    found = frame.select("page_id", F.lit("amazon").alias("source"), F.struct("title", "isbn10", "isbn13", *unset).alias("m"))
    ordered = F.struct(*[F.col("m")[f.name].alias(f.name) for f in METADATA])
    merged = books.consolidate(books.with_defaults(found.select("page_id", "source", ordered.alias("metadata")))).collect()
    assert {(r.key_kind, r.book_key): r.copies for r in merged} == {
        ("isbn", "9780306406157"): 2, ("page", "9780306406157"): 1, ("isbn", "9780804429573"): 1,
    }


@pytest.mark.parametrize(
    "css, names",
    [
        ("ul > li", "b c d e"),
        ("#a > ul > li > b", "x"),
        ("li + li", "c d e"),
        ("#b + li", "c"),
        ("#b ~ li", "c d e"),
        ("li:first-child", "b"),
        ("li:last-child, p:only-child", "e q"),
        ("li:nth-child(even)", "c e"),
        ("li:nth-child(-n+2)", "b c"),
        ("li:nth-child(2n+3)", "d"),
        ("li:not(.s)", "c e"),
        ("li.s:not(:first-child)", "d"),
        ("ul ~ div p", "q"),
        ("ul > b", ""),
        ("html > body > div", "a"),
        (":not(li):not(html):not(body):not(ul)", "a x f q"),
    ],
)
def test_combinators_and_places(spark, css, names):
    text = """<html id=h><body id=o>text<div id=a><ul id=u><li id=b class=s><b id=x>1</b></li>between<li id=c>2
    <li id=d class="s t">3<li id=e>4</ul><div id=f><p id=q>5</p></div></div></body></html>"""
    found = html.select_pages(_pages(spark, text), css)
    got = [r.attrs["id"] for r in found.collect()]
    assert " ".join(got) == names


def test_plain_tags_are_read_by_one_match_as_the_library_reads_them(monkeypatch):
    from html.parser import HTMLParser

    pages = [
        '<HTML><body class="A b"\n ID="x" id="y"><p>a<br/>b<P title="1 > 0">c</p ></Body>',
        '<script type="x">if (a<b) "</p>"</script><style>p</style><title>a &amp; b</title><textarea><b>x</b></textarea>',
        "<a href='1' b c=d e = \"f\">x</a><a href=\"?a&amp;b\">y</a><a\tx=\"1\">z<a x=\"1\"y=\"2\"><my-tag a=\"\"/></my-tag></>",
        '<div a="1"<p>t</p><div a="unclosed><p></div', '<p x="<b>" y="/">\x00</p\n><x:y z:a="1"></x:y><script/>a<b>c', "</p><3 < & <!-- <p> --><![if x]><?p?><!doctype html>",
    ]
    library = []
    for page in pages:
        with monkeypatch.context() as patched:
            for name in ("parse_starttag", "parse_endtag"):
                patched.delattr(dom._Elements, name, raising=False)
            library.append(dom._elements(page, lambda tag, attrs: True))
    assert [dom._elements(page, lambda tag, attrs: True) for page in pages] == library
    asked, way = [], HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: asked.append(i) or way(self, i))
    dom._elements('<div class="a b"><p>x</p><img src="/y" alt=""/></div>', lambda tag, attrs: True)
    assert asked == []


def test_fetches_of_rejected_or_unknown_tasks_are_no_results(spark):
    requests = spark.createDataFrame([(1, ["https://h/1", "oops"], "amazon", 5), (None, ["https://h/2"], "amazon", 5)], "request_id int, urls array<string>, source string, priority int")
    page = ("https://h/1", "amazon", 200, None, "<title>T</title>")
    rows = [(1, 0, 1, *page), (1, 0, 2, *page), (1, 1, 3, *page), (9, 0, 4, *page), (None, 0, 5, *page)]
    fetches = spark.createDataFrame(rows, "request_id int, pos int, page_id int, url string, source string, http_status int, exception_class string, html string")
    results, rejected = scrape_batch(requests, fetches)
    got = sorted(((r.request_id, r.pos, r.page_id, r.status) for r in results.collect()), key=str)
    assert got == [(1, 0, 1, "success"), (1, 0, 2, "success"), (None, 0, None, None)]
    assert rejected.count() == 1
