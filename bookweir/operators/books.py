"""Book records: structured data first, then selector rules, then quality steps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweir.functions import selectors
from bookweir.functions.arrays import attribute, hold, let, struct
from bookweir.functions.urls import http_url, resolved
from bookweir.operators.dom import shred
from bookweir.operators.html import METADATA_KEEP, STRUCTURED_KEEP, with_metadata, with_structured_items
from bookweir.operators.links import key_groups, stored
from bookweir.schemas import BOOK, METADATA, SOURCES
from bookweir.session import use_checkpoint_dir

# The selector rules and limits for pages without structured data.
AUTHOR_CSS = '[class*="author"], [class*="Author"], .author, .Author'
DESCRIPTION_CSS = '[class*="description"], [class*="Description"], .description, .Description'
COVER_CSS = 'img[class*="cover"], img[class*="Cover"]'
COVER_BOX_CSS = ".cover, .Cover"
AUTHOR_MAX_CHARS = 99
DESCRIPTION_MIN_CHARS = 21
BOOK_TYPES = ["Book", "http://schema.org/Book"]
EXTENDED_BOOK_TYPES = [*BOOK_TYPES, "https://schema.org/Book"]

HTML_BOOK_KEEP = [
    *METADATA_KEEP,
    *selectors.element_tests("h1", "h2", "img[src]", AUTHOR_CSS, DESCRIPTION_CSS, COVER_BOX_CSS),
]
BOOK_KEEP = sorted({*HTML_BOOK_KEEP, *STRUCTURED_KEEP}, key=repr)

_NUMBER = r"r'^\s*[+-]?(\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
_INTEGER = r"r'^\s*[+-]?\d+\s*$'"


def _metadata_struct(**given: str) -> str:
    """SQL text: a full metadata struct; fields that are not given are null (lists: empty)."""
    fields = {}
    for field in METADATA.fields:
        kind = field.dataType.simpleString()
        default = "array()" if kind.startswith("array") else "NULL"
        fields[field.name] = f"cast({given.get(field.name, default)} AS {kind})"
    return struct(**fields)


# --- structured items -------------------------------------------------------

# Metadata field and the item member it is read from.
_TEXT_MEMBERS = {
    "type": "@type",
    "title": "name",
    "isbn": "isbn",
    "isbn13": "isbn13",
    "isbn10": "isbn10",
    "description": "description",
    "source_id": "identifier",
    "cover_image_url": "image",
    "source_url": "url",
    "publisher": "publisher",
    "author": "author",
}


def _get(item: str, key: str, kind: str) -> str:
    return f"""try_variant_get({item}, '$["{key}"]', '{kind}')"""


def _member(item: str, key: str) -> str:
    """(kind, text) of a member; the kind is null when missing and VOID for a JSON null."""
    return struct(kind=f"schema_of_variant({_get(item, key, 'variant')})", text=_get(item, key, "string"))


_RATING = _get("item", "aggregateRating", "variant")
# Everything the acceptance rules look at, read from the item once.
_MEMBERS = struct(
    item="item",
    **{name: _member("item", key) for name, key in _TEXT_MEMBERS.items()},
    authors=_get("item", "author", "array<string>"),
    publisher_name=_member(_get("item", "publisher", "variant"), "name"),
    rating_kind=f"schema_of_variant({_RATING})",
    no_rating=f"""coalesce(to_json({_RATING}), 'null')
      IN ('null', '""', '0', '0.0', '-0.0', 'false', '[]', '{{}}')""",
    value=_member(_RATING, "ratingValue"),
    value_number=_get(_RATING, "ratingValue", "double"),
    count=_member(_RATING, "ratingCount"),
    count_number=_get(_RATING, "ratingCount", "double"),
)
# Both are null when `aggregateRating` is missing or empty; inside it a missing
# member is 0, text must be a number, and a JSON null is refused.
_RATING_VALUE = f"""CASE WHEN m.no_rating THEN NULL WHEN m.value.kind IS NULL THEN 0.0D
  WHEN m.value.kind = 'STRING' THEN
    CASE WHEN m.value.text RLIKE {_NUMBER} THEN try_cast(replace(trim(m.value.text), '_') AS double) END
  WHEN m.value.kind <> 'VOID' THEN m.value_number END"""
_RATING_COUNT = f"""CASE WHEN m.no_rating THEN NULL WHEN m.count.kind IS NULL THEN 0L
  WHEN m.count.kind = 'STRING' THEN
    CASE WHEN m.count.text RLIKE {_INTEGER} THEN try_cast(trim(m.count.text) AS bigint) END
  WHEN m.count.kind = 'BIGINT' THEN try_cast(m.count.text AS bigint)
  WHEN m.count.kind <> 'VOID' THEN try_cast(m.count_number AS bigint) END"""
_READ = struct(m="m", rating=_RATING_VALUE, rating_count=_RATING_COUNT)


def _text(member: str) -> str:
    """Value of an optional text member; a missing one is ''."""
    return f"CASE WHEN {member}.kind IS NULL THEN '' WHEN {member}.kind = 'STRING' THEN {member}.text END"


def _text_ok(member: str) -> str:
    return f"coalesce({member}.kind IN ('STRING', 'VOID'), true)"


def _accepted(types: list[str], strict_urls: bool) -> str:
    """SQL text: whether the item read into `c` passes every rule."""
    allowed = ", ".join(f"'{name}'" for name in types)
    checks = [
        f"c.m.type.kind = 'STRING' AND c.m.type.text IN ({allowed})",
        "coalesce(c.m.title.kind = 'STRING', true)",
        """(c.m.author.kind IS NULL OR c.m.author.kind = 'STRING'
            OR c.m.author.kind IN ('ARRAY<STRING>', 'ARRAY<VOID>') AND NOT exists(c.m.authors, a -> a IS NULL))""",
        f"""CASE WHEN startswith(c.m.publisher.kind, 'OBJECT') THEN {_text_ok('c.m.publisher_name')}
            ELSE {_text_ok('c.m.publisher')} END""",
        """(c.m.no_rating OR startswith(c.m.rating_kind, 'OBJECT') AND c.rating BETWEEN 0 AND 5
            AND c.rating_count >= 0)""",
    ]
    checks += [_text_ok(f"c.m.{name}") for name in ("isbn", "isbn13", "isbn10", "description", "source_id")]
    for url in ("c.m.cover_image_url", "c.m.source_url"):
        strict = f"({url}.kind = 'VOID' OR {url}.kind = 'STRING' AND {http_url(f'{url}.text')})"
        checks.append(strict if strict_urls else _text_ok(url))
    return f"coalesce({' AND '.join(checks)}, false)"


_STRUCTURED_METADATA = _metadata_struct(
    authors=f"""CASE WHEN c.m.author.kind IS NULL OR c.m.author.kind = 'STRING' THEN array({_text('c.m.author')})
      ELSE c.m.authors END""",
    publisher=f"""CASE WHEN startswith(c.m.publisher.kind, 'OBJECT') THEN {_text('c.m.publisher_name')}
      ELSE {_text('c.m.publisher')} END""",
    rating="c.rating",
    rating_count="c.rating_count",
    source_metadata="c.m.item",
    **{name: _text(f"c.m.{name}") for name in ("title", "isbn", "isbn13", "isbn10", "description", "source_id")},
    **{
        name: f"CASE WHEN {http_url(f'c.m.{name}.text')} THEN {_text(f'c.m.{name}')} END"
        for name in ("cover_image_url", "source_url")
    },
)


def with_structured_book(doms: DataFrame, strict_urls: bool = True, extended_types: bool = False) -> DataFrame:
    """Add `structured`: metadata of the first acceptable book item, else null."""
    accepted = _accepted(EXTENDED_BOOK_TYPES if extended_types else BOOK_TYPES, strict_urls)
    read = f"transform(transform(items, item -> {_MEMBERS}), m -> {_READ})"
    first = f"slice(filter({read}, c -> {accepted}), 1, 1)"
    return hold(with_structured_items(doms), structured=f"get(transform({first}, c -> {_STRUCTURED_METADATA}), 0)")


# --- selector rules ---------------------------------------------------------


def _first_text(tag: str) -> str:
    return f"get(filter(nodes, n -> n.tag = '{tag}'), 0).text"


def _texts(css: str, length: str) -> str:
    """Texts of matching elements whose length satisfies the condition."""
    hit = selectors.predicate(selectors.element_tests(css), "n")
    return f"transform(filter(nodes, n -> {hit} AND length(n.text) {length}), n -> n.text)"


_SRC, _ALT = attribute("n", "src"), attribute("n", "alt")
_COVER_BOXES = f"""transform(filter(nodes, n -> {selectors.predicate(selectors.element_tests(COVER_BOX_CSS), 'n')}),
  n -> n.pre)"""
_COVERS = f"""filter(nodes, n -> n.tag = 'img' AND coalesce({_SRC} <> '', false)
  AND (contains(lower({_SRC}), 'cover') OR contains(lower(coalesce({_ALT}, '')), 'cover'))
  AND ({selectors.predicate(selectors.element_tests(COVER_CSS), 'n')} OR arrays_overlap(n.up, boxes)))"""
_COVER = f"""get(transform(slice({let('boxes', _COVER_BOXES, _COVERS)}, 1, 1),
  n -> {resolved('url', _SRC)}), 0)"""
_TITLE = f"""coalesce(nullif(try_element_at(page_meta, 'title'), ''), {_first_text('h1')}, {_first_text('h2')})"""
_HTML_METADATA = _metadata_struct(
    title="_title",
    authors=_texts(AUTHOR_CSS, f"BETWEEN 1 AND {AUTHOR_MAX_CHARS}"),
    description=f"coalesce(get({_texts(DESCRIPTION_CSS, f'>= {DESCRIPTION_MIN_CHARS}')}, 0), '')",
    cover_image_url="_cover",
    source_metadata="to_variant_object(page_meta)",
)


def with_html_book(doms: DataFrame, unless: str = "false") -> DataFrame:
    """Add `from_html`: metadata by selector rules, null without a title or with a bad cover.

    Pages where `unless` holds are skipped.
    """
    out = hold(
        with_metadata(doms),
        _title=f"CASE WHEN NOT ({unless}) THEN {_TITLE} END",
        _cover=f"CASE WHEN NOT ({unless}) THEN {_COVER} END",
    )
    usable = f"_title <> '' AND (_cover IS NULL OR {http_url('_cover')})"
    return hold(out, from_html=f"CASE WHEN {usable} THEN {_HTML_METADATA} END").drop("_title", "_cover")


# --- books ------------------------------------------------------------------


def _book_rows(found: DataFrame, column: str) -> DataFrame:
    others = [name for name in ("page_id", "url", "source") if name in found.columns]
    return found.select(*others, F.explode(F.array_compact(F.array(column))).alias("metadata"))


def books_structured(pages: DataFrame, strict_urls: bool = True, extended_types: bool = False) -> DataFrame:
    """One book per page that carries an acceptable structured item."""
    doms = shred(pages, STRUCTURED_KEEP)
    return _book_rows(with_structured_book(doms, strict_urls, extended_types), "structured")


def books_html(pages: DataFrame) -> DataFrame:
    """One book per page with a title, by selector rules alone."""
    return _book_rows(with_html_book(shred(pages, HTML_BOOK_KEEP)), "from_html")


def extract_books(
    pages: DataFrame, strict_urls: bool = True, extended_types: bool = False, unreadable: str | None = None
) -> DataFrame:
    """Every page with `metadata` of its book (null: none) - one read, no shuffle.

    `unreadable` names a column that tells which pages couldn't be read.
    """
    doms = with_structured_book(shred(pages, BOOK_KEEP), strict_urls, extended_types)
    doms = with_html_book(doms, unless="structured IS NOT NULL")
    others = [name for name in pages.columns if name != "html"]
    flag = [F.col("nodes").isNull().alias(unreadable)] if unreadable else []
    return doms.select(*others, *flag, F.coalesce("structured", "from_html").alias("metadata"))


def books(pages: DataFrame, strict_urls: bool = True, extended_types: bool = False) -> DataFrame:
    """Structured book, else the one by selector rules; pages with neither are left out."""
    return _book_rows(extract_books(pages, strict_urls, extended_types), "metadata")


def with_defaults(found: DataFrame, run_time: Column | None = None) -> DataFrame:
    """Complete book rows: every column of the record that extraction doesn't fill, with its default.

    One time stamp serves the whole run; the id is the page's.
    """
    now = run_time if run_time is not None else F.current_timestamp()
    made = {
        "id": F.col("page_id").cast("string"),
        "primary_source": F.col("source"),
        "sources": F.array("source"),
        "is_owned": F.lit(False),
        "created_at": now,
        "updated_at": now,
        "last_scraped_at": now,
        "confidence_score": F.lit(1.0),
        "data_completeness": F.lit(0.0),
        "custom_fields": F.parse_json(F.lit("{}")),
    }
    empty = {name: F.array().cast(BOOK[name].dataType) for name in ("collections", "tags")}
    unset = {f.name: F.lit(None).cast(f.dataType) for f in BOOK if f.name not in {*made, *empty, "metadata"}}
    others = [name for name in found.columns if name != "source"]
    return found.select(*others, *[c.alias(name) for name, c in (made | empty | unset).items()])


def _is_filled(value: Column, type_name: str) -> Column:
    if type_name == "array":
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if type_name == "string":
        return F.coalesce(value != "", F.lit(False))
    if type_name == "variant":
        return value.isNotNull() & ~F.coalesce(F.to_json(value).isin("{}", "null"), F.lit(True))
    if type_name == "binary":
        return F.coalesce(F.octet_length(value) > 0, F.lit(False))
    return value.isNotNull()


def completeness(metadata: str = "metadata") -> Column:
    """Share of the metadata fields that are neither null nor empty."""
    filled = F.lit(0)
    for field in METADATA.fields:
        value = F.col(f"{metadata}.{field.name}")
        filled = filled + _is_filled(value, field.dataType.typeName()).cast("int")
    return filled / F.lit(len(METADATA.fields))


def book_key(metadata: str = "metadata") -> Column:
    """What identifies a book across sources: the kind of key and its value.

    ISBNs are compared without hyphens and spaces, those of ten digits as the ISBN-13 they
    stand for; the kind keeps a page id from ever meeting an ISBN of the same digits.
    """
    isbn = _isbn13(F.coalesce(*_isbns(metadata)))
    url = F.col(f"{metadata}.source_url")
    kind = F.when(isbn.isNotNull(), "isbn").when(url.isNotNull(), "url").otherwise("page")
    return F.struct(kind.alias("kind"), F.coalesce(isbn, url, F.col("page_id").cast("string")).alias("value"))


def _isbns(metadata: str) -> list[Column]:
    """The ISBNs of a record without hyphens and spaces, null where there is none."""
    texts = [F.regexp_replace(F.col(f"{metadata}.{name}"), r"[-\s]", "") for name in ("isbn13", "isbn10", "isbn")]
    return [F.nullif(text, F.lit("")) for text in texts]


def book_keys(metadata: str = "metadata") -> Column:
    """All that identifies a book across sources: every ISBN it has and its URL, as kind and value."""
    url = F.nullif(F.col(f"{metadata}.source_url"), F.lit(""))
    values = [("isbn", _isbn13(isbn)) for isbn in _isbns(metadata)] + [("url", url)]
    return F.array_compact(
        F.array(*[F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))) for kind, v in values])
    )


def _isbn13(isbn: Column) -> Column:
    """An ISBN-10 as ISBN-13; anything else as it is."""
    body = F.concat(F.lit("978"), F.left(isbn, F.lit(9)))
    weighted = [F.substring(body, k + 1, 1).try_cast("int") * (1 if k % 2 == 0 else 3) for k in range(12)]
    check = (10 - sum(weighted[1:], weighted[0]) % 10) % 10
    return F.when(isbn.rlike("^[0-9]{9}[0-9Xx]$"), F.concat(body, check.cast("string"))).otherwise(isbn)


def consolidate_linked(found: DataFrame) -> DataFrame:
    """One row per book across sources, where copies need not all have the same key.

    A copy known by URL meets one known by ISBN by way of a third that has both. The least
    of the keys so tied names the book. Rows meet the tied keys by their own first key, in a
    join that may be split where one key is hot; `consolidate` then combines before it shuffles.
    The rows are written first, since both their keys and their fields are asked for: pages are read once.
    """
    found = stored(found, f"{use_checkpoint_dir(found.sparkSession)}/bookweir-linked-{uuid.uuid4().hex}", "books")
    own = found.withColumn("_key", F.array_min(book_keys()))
    tied = key_groups(found, book_keys()).select(F.col("key").alias("_key"), F.col("leader").alias("_leader"))
    page = F.struct(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("value"))
    grouped = own.join(tied, "_key", "left").withColumn("_book", F.coalesce("_leader", "_key", page))
    return consolidate(grouped, F.col("_book"))


def consolidate(found: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per book across sources; `key` (kind, value) says which book a row is of.

    The earliest row gives the primary source; every field takes its first
    filled value in that order. All aggregates keep one value per key, so they
    combine before the shuffle and a book with very many copies costs no more.
    """
    order = F.struct("created_at", "page_id")
    firsts = []
    for field in METADATA.fields:
        value = F.col(f"metadata.{field.name}")
        kind = field.dataType.typeName()
        first = F.min_by(value, F.when(_is_filled(value, kind), order))
        firsts.append((F.coalesce(first, F.array()) if kind == "array" else first).alias(field.name))
    merged = found.groupBy((book_key() if key is None else key).alias("book_key")).agg(
        F.min_by("primary_source", order).alias("primary_source"),
        # The names of the sources are known, so one flag each is enough.
        F.array_compact(F.array(*[F.max(F.when(F.col("primary_source") == name, name)) for name in sorted(SOURCES)])).alias("sources"),
        F.count("*").alias("copies"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        *firsts,
    )
    names = [field.name for field in METADATA.fields]
    return merged.select(
        F.col("book_key.value").alias("book_key"), F.col("book_key.kind").alias("key_kind"), "primary_source", "sources", "copies", "created_at", "updated_at", F.struct(*names).alias("metadata")
    )


def search(found: DataFrame, query: str, source: str | None = None, limit: int = 10) -> DataFrame:
    """Books whose title or an author contains the query, in title order."""
    wanted = query.lower()
    in_title = F.lower("metadata.title").contains(wanted)
    in_authors = F.exists("metadata.authors", lambda a: F.lower(a).contains(wanted))
    hits = found.filter(in_title | in_authors)
    if source is not None:
        hits = hits.filter(F.array_contains("sources", source))
    return hits.orderBy("metadata.title", "page_id").limit(limit)
