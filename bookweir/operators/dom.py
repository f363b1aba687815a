"""Pages to elements: the one step that needs Python, run once per page batch."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweir.functions.selectors import AttrTest, Simple
from bookweir.schemas import NODE, SPAN

# Elements without content, and the start tags that end an open
# paragraph, both as the HTML standard lists them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
# A start tag on the left ends an open element of the second
# column, unless one of the third column was opened in between.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
PARAGRAPH_SCOPE = {"table", "td", "th", "caption", "button", "object"}

_NODE_ARROW = pa.struct(
    [
        pa.field("pre", pa.int32()),
        pa.field("post", pa.int32()),
        pa.field("parent", pa.int32()),
        pa.field("prev", pa.int32()),
        pa.field("nth", pa.int32()),
        pa.field("last", pa.bool_()),
        pa.field("up", pa.list_(pa.int32())),
        pa.field("tag", pa.string()),
        pa.field("attrs", pa.map_(pa.string(), pa.string())),
        pa.field("text", pa.string()),
    ]
)
_SPAN_ARROW = pa.struct(
    [field for field in _NODE_ARROW if field.name not in ("up", "text")]
    + [pa.field("start", pa.int32()), pa.field("stop", pa.int32())]
)
_FLUSH_CHARS = 8_000_000
# Tags as most pages write them, which one match reads: names of letters and digits, values in double quotes, no
# references in them. Any other tag goes the way of the standard library.
_PLAIN_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \n][a-zA-Z][a-zA-Z0-9:_-]*="[^"&]*")*)/?>""")
_PLAIN_ATTRS = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)="([^"]*)\"""")
_RAW = frozenset((*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"))
_PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())  # what str.strip takes away


class _Elements(HTMLParser):
    """Collects the wanted elements of one page with their pre / post interval.

    Either each comes with its text and the numbers of those around it, or (`flat`) with
    where its text starts and stops in the text of the page.
    """

    def __init__(self, wanted: Callable[[str, dict], bool], flat: bool = False):
        super().__init__(convert_charrefs=True)
        self._wanted = wanted
        self._flat = flat
        self._chars = 0
        self._texts: list[str] = []
        self._open: list[tuple] = []
        self._open_tags: defaultdict[str, int] = defaultdict(int)
        self._kept: list[int] = []
        self._next_pre = self._next_post = 0
        # Of the page and every open element: how many child elements so far, the last one's number and row.
        self._children: list[list] = [[0, None, None]]
        self.rows: list[dict] = []

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        if plain is None or (tag := plain[1].lower()) in _RAW:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [(name.lower(), value) for name, value in _PLAIN_ATTRS.findall(plain[2])] if plain[2] else ())
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH and self._open_tags["p"]:
            self._end_open({"p"}, PARAGRAPH_SCOPE)
        if tag in IMPLIED_ENDS:
            self._end_open(*IMPLIED_ENDS[tag])
        named = {name: value or "" for name, value in reversed(attrs)} if attrs else {}
        pre, self._next_pre = self._next_pre, self._next_pre + 1
        keep = self._wanted(tag, named)
        parent = self._open[-1][1] if self._open else None
        up = (None if self._flat else self._kept.copy()) if keep else False
        family = self._children[-1]
        place = (family[0] + 1, family[1])
        family[:] = [place[0], pre, None]
        self._children.append([0, None, None])
        self._open.append((tag, pre, parent, up, named, self._chars if self._flat else len(self._texts), place))
        self._open_tags[tag] += 1
        if keep:
            self._kept.append(pre)
        if tag in VOID:
            self._close_last()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self._open_tags[tag] and tag not in VOID:
            while self._close_last() != tag:
                pass

    def handle_data(self, data):
        self._texts.append(data)
        self._chars += len(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def page_text(self) -> str:
        return "".join(self._texts)

    def finish(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        while self._open:
            self._close_last()
        self._mark_last()
        self.rows.sort(key=lambda row: row["pre"])
        return self.rows

    def _end_open(self, tags: set, scope: set):
        if not any(self._open_tags[tag] for tag in tags):
            return
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] in tags:
                while len(self._open) > depth:
                    self._close_last()
                return
            if self._open[depth][0] in scope:
                return

    def _mark_last(self) -> None:
        row = self._children.pop()[2]
        if row is not None:
            row["last"] = True

    def _close_last(self) -> str:
        tag, pre, parent, up, attrs, first_text, (nth, prev) = self._open.pop()
        self._mark_last()
        self._open_tags[tag] -= 1
        post, self._next_post = self._next_post, self._next_post + 1
        if up is not False:
            self._kept.pop()
            row = {
                "pre": pre,
                "post": post,
                "parent": parent,
                "prev": prev,
                "nth": nth,
                "last": False,
                "tag": tag,
                "attrs": list(attrs.items()),
            }
            if self._flat:
                row |= {"start": first_text, "stop": self._chars}
            else:
                row |= {"up": up, "text": "".join(self._texts[first_text:]).strip()}
            self.rows.append(row)
            self._children[-1][2] = self.rows[-1]
        return tag


def _holds(test: AttrTest, attrs: dict) -> bool:
    value = attrs.get(test.attr)
    if value is None:
        return False
    if test.op == "eq":
        return value == test.value
    if test.op == "token":
        return test.value in value.split()
    if test.op in ("starts", "ends"):
        return test.value != "" and (value.startswith if test.op == "starts" else value.endswith)(test.value)
    return test.op == "has" or (test.value != "" and test.value in value)


def _keeper(keep: list[Simple] | None) -> Callable[[str, dict], bool]:
    """The `keep` list as a test on one start tag; most tags fail it without a look at attributes."""
    if keep is None:
        return lambda tag, attrs: True
    by_tag: dict[str | None, list] = defaultdict(list)
    for simple in keep:
        by_tag[simple.tag].append(simple.tests)
    by_tag, anywhere = dict(by_tag), by_tag.get(None, [])
    bare = any(not tests for tests in anywhere)

    def wanted(tag: str, attrs: dict) -> bool:
        candidates = by_tag.get(tag, ())
        if attrs:
            candidates = [*candidates, *anywhere]
        elif bare:
            return True
        for tests in candidates:
            for test in tests:
                if not _holds(test, attrs):
                    break
            else:
                return True
        return False

    return wanted


def _elements(html: str | None, wanted: Callable[[str, dict], bool]) -> list[dict] | None:
    if html is None:
        return None
    try:
        return _Elements(wanted).finish(html)
    except (AssertionError, ValueError):
        return None  # unreadable page: kept, with null nodes


def shred(pages: DataFrame, keep: Iterable[Simple] | None = None) -> DataFrame:
    """Replace `html` by `nodes`, the page's elements in document order.

    Every other column passes through, so no join is needed afterwards. `keep`
    names the element tests whose matches are wanted (None for all): the
    optimizer cannot push a filter into this step. An unreadable page has null
    nodes.
    """
    keep = None if keep is None else list(keep)
    others = [field for field in pages.schema.fields if field.name != "html"]
    schema = T.StructType([*others, T.StructField("nodes", T.ArrayType(NODE))])
    names = [field.name for field in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _keeper(keep)
        for batch in batches:
            htmls, first, rows, chars = batch.column("html"), 0, [], 0
            for i in range(batch.num_rows):
                rows.append(_elements(htmls[i].as_py(), wanted))
                chars += sum(len(node["text"]) + 100 for node in rows[-1] or ())
                if chars > _FLUSH_CHARS or i == batch.num_rows - 1:
                    columns = [batch.column(name).slice(first, len(rows)) for name in names]
                    columns.append(pa.array(rows, pa.list_(_NODE_ARROW)))
                    yield pa.RecordBatch.from_arrays(columns, [*names, "nodes"])
                    first, rows, chars = i + 1, [], 0

    return pages.select(*names, "html").mapInArrow(run, schema)


def element_spans(pages: DataFrame, keep: Iterable[Simple] | None = None) -> DataFrame:
    """Replace `html` by `page_text`, all text of the page, and `spans`, its elements in document order.

    An element has its interval (pre, post), its place among its siblings, tag, attributes and
    where its text starts and stops in `page_text`. What encloses it has the smaller pre and the greater
    post. So a page costs what its own length does, however deep its elements nest; `shred` copies the text and
    the enclosing numbers to every element. An unreadable page has null text and spans.
    """
    keep = None if keep is None else list(keep)
    others = [field for field in pages.schema.fields if field.name != "html"]
    schema = T.StructType([*others, T.StructField("page_text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])
    names = [field.name for field in others]

    def read(html: str | None, wanted: Callable[[str, dict], bool]) -> tuple[str | None, list[dict] | None]:
        if html is None:
            return None, None
        try:
            page = _Elements(wanted, flat=True)
            rows = page.finish(html)
            return page.page_text(), rows
        except (AssertionError, ValueError):
            return None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _keeper(keep)
        for batch in batches:
            htmls, first, rows, chars = batch.column("html"), 0, [], 0
            for i in range(batch.num_rows):
                rows.append(read(htmls[i].as_py(), wanted))
                chars += len(rows[-1][0] or "") + 100 * len(rows[-1][1] or ())
                if chars > _FLUSH_CHARS or i == batch.num_rows - 1:
                    columns = [batch.column(name).slice(first, len(rows)) for name in names]
                    texts, spans = zip(*rows)
                    columns += [pa.array(texts, pa.string()), pa.array(spans, pa.list_(_SPAN_ARROW))]
                    yield pa.RecordBatch.from_arrays(columns, [*names, "page_text", "spans"])
                    first, rows, chars = i + 1, [], 0

    return pages.select(*names, "html").mapInArrow(run, schema)


def span_nodes(doms: DataFrame, text: bool = True) -> DataFrame:
    """One row per element of `element_spans`; its text is cut out of the page's only if it is asked for."""
    rows = doms.select("page_id", *(["page_text"] if text else []), F.explode("spans").alias("n"))
    own = F.substring("page_text", F.col("n.start") + 1, F.col("n.stop") - F.col("n.start"))
    return rows.select(
        "page_id",
        F.col("n.pre").cast("bigint").alias("node_id"),
        F.col("n.parent").cast("bigint").alias("parent_id"),
        "n.pre",
        "n.post",
        "n.tag",
        "n.attrs",
        *([F.btrim(own, F.lit(_BLANKS)).alias("text")] if text else []),
    )


def dom_nodes(doms: DataFrame) -> DataFrame:
    """One row per element."""
    return doms.select("page_id", F.explode("nodes").alias("n")).select(
        "page_id",
        F.col("n.pre").cast("bigint").alias("node_id"),
        F.col("n.parent").cast("bigint").alias("parent_id"),
        "n.pre",
        "n.post",
        "n.tag",
        "n.attrs",
        "n.text",
    )
