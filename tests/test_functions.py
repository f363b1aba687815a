import itertools
import re
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from bookweir.functions import selectors
from bookweir.functions.selectors import AttrTest, Place, Simple
from bookweir.functions.text import clean_text
from bookweir.functions.urls import domain_key, is_http_url, resolve_url

BASES = ["https://h/a/b?q#f", "http://h", "http://h/", "http://h/a/b/c/", "https://u:p@h:80/x/y;p?q=1", "", None]
REFS = [
    "c", "/c", "../c", "//g/c", "?z", "#s", "http://x/", "", "./", "..", "../..", "../../../g", "g/", "./g", "/./g",
    "/../g", "g.", "..g", "g?y/./x", "mailto:a@b", "javascript:void(0)", "https:c", "HTTP://X/y/../z", "a//b", "/a//b",
    "//g", "a:b", "x y", " lead", "a\nb", "é/ü?ö", "g;x", "http://x/?", "g#", "g?", "/", "a/./b/../c/", "...", "?",
]


def test_resolve_url_equals_the_standard_rules(spark):
    rows = [(base, ref, urljoin(base or "", ref)) for base, ref in itertools.product(BASES, REFS)]
    df = spark.createDataFrame(rows, "base string, ref string, expected string")
    got = df.select("base", "ref", "expected", resolve_url("base", "ref").alias("got"))
    assert got.filter("NOT (got <=> expected)").collect() == []


def test_domain_key(spark):
    cases = {
        "https://a.b:80/x": "a.b:80",
        "http://u:p@h/": "u:p@h",
        "not a url": "",
        "//x/y?z": "x",
        "http://[::1]:8/": "[::1]:8",
        "http://[bad/": "default",
        "HTTP://A#f": "A",
    }
    df = spark.createDataFrame([*cases.items(), (None, "default")], "u string, e string")
    assert df.filter(~domain_key("u").eqNullSafe(F.col("e"))).collect() == []
    assert all(urlsplit(u).netloc == e for u, e in cases.items() if e != "default")


def test_is_http_url(spark):
    cases = {"https://a/x": True, "HTTP://A": True, "ftp://a": False, "notaurl": False, "http:///x": False, "": False}
    df = spark.createDataFrame([*cases.items(), (None, False)], "u string, e boolean")
    assert df.filter(is_http_url("u") != F.col("e")).collect() == []


def _clean(text):
    text = re.sub(r"\s+", " ", text)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = text.replace(entity, char)
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", text).strip()


def test_clean_text(spark):
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000)]
    texts = ["a \n b&amp;lt;c\x07", "", "&nbsp;x&nbsp;", "&amp;amp;#39;", "​z﻿", "tab\tx\x9f"]
    texts += [f"{s}a{s}{s}b{s}" for s in spaces] + [f"a{chr(c)}b" for c in range(160)]
    df = spark.createDataFrame([(t, _clean(t)) for t in texts], "t string, cleaned string")
    assert df.filter(clean_text(F.col("t")) != F.col("cleaned")).collect() == []
    assert spark.range(1).select(clean_text(F.lit(None).cast("string"))).collect()[0][0] == ""


def test_selectors_are_read():
    assert selectors.parse('img[class*="cover"], .cover img') == [
        [Simple("img", (AttrTest("class", "contains", "cover"),))],
        [Simple(None, (AttrTest("class", "token", "cover"),)), Simple("img")],
    ]
    assert selectors.parse('script[type="application/ld+json"]') == [
        [Simple("script", (AttrTest("type", "eq", "application/ld+json"),))]
    ]
    assert selectors.parse("[a^='x']") == [[Simple(None, (AttrTest("a", "starts", "x"),))]]
    assert selectors.parse("a.b.c[d]") == [
        [Simple("a", (AttrTest("class", "token", "b"), AttrTest("class", "token", "c"), AttrTest("d", "has")))]
    ]


@pytest.mark.parametrize("css", ["a >", "> a", "a > > b", "a >, b", "a:hover", "a:nth-child(x)", "a:not(b c)", "a::before", "", "a,,b"])
def test_unsupported_selectors_are_refused(css):
    with pytest.raises(ValueError):
        selectors.parse(css)


def test_combinators_and_places_are_read():
    assert selectors.parse("a>b + c~d e") == [
        [Simple("a"), Simple("b", link=">"), Simple("c", link="+"), Simple("d", link="~"), Simple("e")]
    ]
    places = {"first-child": Place(0, 1), "nth-child(odd)": Place(2, 1), "nth-child( -n + 3 )": Place(-1, 3), "nth-child(4)": Place(0, 4)}
    for text, place in places.items():
        assert selectors.parse(f"li:{text}") == [[Simple("li", places=(place,))]]
    (chain,) = selectors.parse('a[href~="x > y"]:not(.b, [c=")"])')
    assert [s.tests for s in chain[0].but] == [(AttrTest("class", "token", "b"),), (AttrTest("c", "eq", ")"),)]
