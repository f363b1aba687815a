"""Table schemas, allowed values and value ranges."""

from __future__ import annotations

from pyspark.sql import types as T

# The names that result tables and requests may carry.
SOURCES = ["goodreads", "amazon", "google_books", "openlibrary", "unknown"]
ENABLED_SOURCES = ["goodreads", "amazon", "google_books", "openlibrary"]
JOB_TYPES = ["single", "batch", "scheduled", "recurring"]
JOB_STATUSES = ["pending", "running", "completed", "failed", "cancelled", "paused"]
RESULT_STATUSES = ["success", "partial", "failed", "skipped"]

# Inclusive ranges, None for no upper end.
BOOK_METADATA_RANGES = {
    "rating": (0, 5),
    "rating_count": (0, None),
    "review_count": (0, None),
    "price": (0, None),
}
BOOK_RANGES = {
    "reading_progress": (0, 1),
    "current_page": (0, None),
    "confidence_score": (0, 1),
    "data_completeness": (0, 1),
}
REQUEST_RANGES = {"priority": (1, 10)}
JOB_RANGES = {
    "priority": (1, 10),
    "max_retries": (0, 10),
    "timeout_seconds": (5, 300),
    "progress": (0, 1),
    "completed_count": (0, None),
    "failed_count": (0, None),
    "total_count": (0, None),
    "error_count": (0, None),
}
RESULT_RANGES = {"confidence_score": (0, 1), "data_completeness": (0, 1)}

STRINGS = T.ArrayType(T.StringType())

METADATA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("authors", STRINGS),
        T.StructField("isbn", T.StringType()),
        T.StructField("isbn13", T.StringType()),
        T.StructField("isbn10", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("publication_date", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("pages", T.LongType()),
        T.StructField("dimensions", T.StringType()),
        T.StructField("weight", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("rating_count", T.LongType()),
        T.StructField("review_count", T.LongType()),
        T.StructField("cover_image_url", T.StringType()),
        T.StructField("cover_image_data", T.BinaryType()),
        T.StructField("genres", STRINGS),
        T.StructField("tags", STRINGS),
        T.StructField("series", T.StringType()),
        T.StructField("series_position", T.LongType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("source_metadata", T.VariantType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("availability", T.StringType()),
    ]
)

BOOK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("metadata", METADATA, False),
        T.StructField("primary_source", T.StringType(), False),
        T.StructField("sources", STRINGS),
        T.StructField("is_owned", T.BooleanType()),
        T.StructField("reading_status", T.StringType()),
        T.StructField("reading_progress", T.DoubleType()),
        T.StructField("current_page", T.LongType()),
        T.StructField("collections", STRINGS),
        T.StructField("tags", STRINGS),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("last_scraped_at", T.TimestampType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("data_completeness", T.DoubleType()),
        T.StructField("notes", T.StringType()),
        T.StructField("custom_fields", T.VariantType()),
    ]
)

# One element of a page. `up` holds the `pre` numbers of the enclosing elements
# that were kept as well, outermost first.
NODE = T.StructType(
    [
        T.StructField("pre", T.IntegerType(), False),
        T.StructField("post", T.IntegerType(), False),
        T.StructField("parent", T.IntegerType()),
        T.StructField("prev", T.IntegerType()),
        T.StructField("nth", T.IntegerType(), False),
        T.StructField("last", T.BooleanType(), False),
        T.StructField("up", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("tag", T.StringType(), False),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType(), False), False),
        T.StructField("text", T.StringType(), False),
    ]
)

# One element of a page whose text stands at `start` to `stop` of the page's.
SPAN = T.StructType(
    [field for field in NODE if field.name not in ("up", "text")]
    + [T.StructField("start", T.IntegerType(), False), T.StructField("stop", T.IntegerType(), False)]
)
