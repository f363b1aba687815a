"""Book search over an index of letter triples, so a search reads neither pages nor whole records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweir.operators.books import search

_GRAM = 3


def _grams(text: str) -> str:
    """SQL text: the distinct runs of three characters of a text."""
    return f"""array_distinct(transform(
      CASE WHEN length({text}) >= {_GRAM} THEN sequence(1, length({text}) - {_GRAM - 1}) ELSE array() END,
      i -> substring({text}, i, {_GRAM})))"""


def write_index(found: DataFrame, folder: str) -> None:
    """Write what searches need of complete books: narrow records and postings (gram, page_id).

    Postings are sorted by gram over all files, so a search reads the row groups of its own
    grams. A gram in every title is as many short rows, in as many files as that takes.
    Title and authors are indexed one by one: no gram goes over the end of a text.
    """
    records = found.select("page_id", "sources", F.struct("metadata.title", "metadata.authors").alias("metadata"))
    records.write.mode("overwrite").parquet(f"{folder}/records")
    stored = found.sparkSession.read.schema(records.schema).parquet(f"{folder}/records")
    texts = "transform(array_compact(concat(array(metadata.title), coalesce(metadata.authors, array()))), t -> lower(t))"
    grams = f"array_distinct(flatten(transform({texts}, t -> {_grams('t')})))"
    postings = stored.select(F.explode(F.expr(grams)).alias("gram"), "page_id")
    # Ties of one gram are split by page, so a frequent gram is never one task's.
    postings.repartitionByRange("gram", "page_id").sortWithinPartitions("gram", "page_id").write.mode("overwrite").parquet(
        f"{folder}/postings"
    )


def search_index(spark: SparkSession, folder: str, query: str, source: str | None = None, limit: int = 10) -> DataFrame:
    """The same books as `books.search`, from an index written before.

    A hit holds every gram of the query in one text or another; those that do are looked at
    in full. A query of fewer than three characters has no gram and is looked for in all records.
    """
    records = spark.read.parquet(f"{folder}/records")
    wanted = query.lower()
    grams = sorted({wanted[i : i + _GRAM] for i in range(len(wanted) - _GRAM + 1)})
    if grams:
        postings = spark.read.parquet(f"{folder}/postings").filter(F.col("gram").isin(grams))
        held = postings.groupBy("page_id").agg(F.count_distinct("gram").alias("grams")).filter(F.col("grams") == len(grams))
        records = records.join(held, "page_id", "left_semi")
    return search(records, query, source, limit)
