"""Views over the given tables: the crawl log and rendered book pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The expressions run unchanged in Spark SQL and in DuckDB.
CRAWL_LOG_COLUMNS = [
    "event_id AS log_id",
    "ts",
    "user_id",
    "concat('https://d', CAST(user_id AS STRING), '.example.com/b/', CAST(event_id AS STRING)) AS url",
    "concat('d', CAST(user_id AS STRING), '.example.com') AS domain",
    """CASE user_id % 5 WHEN 0 THEN 'goodreads' WHEN 1 THEN 'amazon' WHEN 2 THEN 'google_books'
       WHEN 3 THEN 'openlibrary' ELSE 'unknown' END AS source""",
    "concat('job_', CAST(event_id % 97 AS STRING)) AS job_id",
    "1 + event_id % 10 AS priority",
    """CASE WHEN event_type = 'error' AND value > 60 THEN 503
       WHEN event_type = 'error' AND value < 5 THEN NULL ELSE 200 END AS http_status""",
    "CASE WHEN event_type = 'error' AND value < 5 THEN 'ReadTimeout' END AS exception_class",
    "value * 100 AS response_time_ms",
    "CAST(floor(value * 1000) AS BIGINT) AS data_size_bytes",
]

BOOK_PAGE_COLUMNS = [
    "p_partkey AS page_id",
    "p_partkey % 6 AS kind",
    "concat('https://books.example.com/b/', CAST(p_partkey AS STRING)) AS url",
    """CASE p_partkey % 5 WHEN 0 THEN 'goodreads' WHEN 1 THEN 'amazon' WHEN 2 THEN 'google_books'
       WHEN 3 THEN 'openlibrary' ELSE 'unknown' END AS source""",
    """CASE p_partkey % 6
  WHEN 0 THEN concat('<html><head><title>shop</title><script type="application/ld+json">{"@type":"Book","name":"', p_name,
    '","author":["', p_brand, '"],"isbn":"', CAST(p_partkey AS STRING), '","publisher":{"name":"', s_name,
    '"},"image":"https://img.example.com/', CAST(p_partkey AS STRING), '.png","url":"https://books.example.com/b/',
    CAST(p_partkey AS STRING), '","aggregateRating":{"ratingValue":"', CAST(p_size % 6 AS STRING), '","ratingCount":',
    CAST(p_size AS STRING), '}}</script></head><body></body></html>')
  WHEN 1 THEN concat('<html><head><title>', p_name, '</title><script type="application/ld+json">{"@type":"Book","name":"ignored"}</script></head><body><p class="author">',
    p_brand, '</p></body></html>')
  WHEN 2 THEN concat('<html><head><title>shop</title></head><body><div itemscope itemtype="http://schema.org/Book"><h1 itemprop="name">',
    p_name, '</h1><span itemprop="author">', p_brand, '</span><meta itemprop="image" content="https://img.example.com/',
    CAST(p_partkey AS STRING), '.png"><meta itemprop="url" content="https://books.example.com/b/', CAST(p_partkey AS STRING),
    '"></div></body></html>')
  WHEN 3 THEN concat('<html><head><title>', p_name, '</title><meta name="Keywords" content="', p_type,
    '"><meta property="og:title" content="', p_name, '"><link rel="canonical" href="/c/', CAST(p_partkey AS STRING),
    '"></head><body><div class="bookAuthor">', p_brand, '</div><div class="description">short</div><div class="description">A long description of ',
    p_name, ' by ', p_brand, '</div><div class="cover"><img src="../img/cover', CAST(p_partkey AS STRING), '.png" alt="x"></div></body></html>')
  WHEN 4 THEN concat('<html><head></head><body><h1>', p_name, '</h1><img src="a.png" alt="none"></body></html>')
  ELSE '<html><head></head><body><p>nothing</p></body></html>' END AS html""",
]

REQUEST_URL_COLUMNS = [
    "CAST(floor(event_id / 5) AS BIGINT) AS request_id",
    "event_id",
    """CASE WHEN event_id % 7 = 3 THEN concat('not a url ', CAST(event_id AS STRING))
       WHEN event_id % 11 = 0 THEN concat('ftp://files.example.com/', CAST(event_id AS STRING))
       ELSE concat('https://d', CAST(user_id AS STRING), '.example.com/b/', CAST(event_id AS STRING)) END AS url""",
]
REQUEST_COLUMNS = [
    """CASE request_id % 6 WHEN 0 THEN 'goodreads' WHEN 1 THEN 'amazon' WHEN 2 THEN 'google_books'
       WHEN 3 THEN 'openlibrary' WHEN 4 THEN 'unknown' ELSE 'elsewhere' END AS source""",
    "request_id % 13 AS priority",
    "concat('batch ', CAST(request_id AS STRING)) AS metadata",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crawl_log(events: DataFrame, *extra: Column) -> DataFrame:
    """Request outcomes derived from an event table (batch or stream), with extra columns of it."""
    return events.select(*[F.expr(column) for column in CRAWL_LOG_COLUMNS], *extra)


def book_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered book pages of six kinds, built from `part` and `supplier`.

    Rendering and reading a page costs far more than moving the few columns it
    is made of, so the rows are spread over all cores first.
    """
    supplier = table(spark, folder, "supplier")
    suppliers = supplier.select(F.count("*")).scalar()
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    spread = part.repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    part = spread.withColumn("suppkey", F.col("p_partkey") % suppliers)
    names = supplier.select("s_suppkey", "s_name")
    joined = part.join(names, F.col("suppkey") == F.col("s_suppkey"))
    return joined.selectExpr(*BOOK_PAGE_COLUMNS)


def scrape_requests(events: DataFrame) -> DataFrame:
    """Requests of five URLs each, some of them not acceptable."""
    return (
        events.selectExpr(*REQUEST_URL_COLUMNS)
        .groupBy("request_id")
        .agg(F.sort_array(F.collect_list(F.struct("event_id", "url"))).alias("u"))
        .selectExpr("*", *REQUEST_COLUMNS)
        .select("request_id", F.transform("u", lambda x: x["url"]).alias("urls"), "source", "priority", "metadata")
    )


def dirty_documents(documents: DataFrame) -> DataFrame:
    """Documents with line breaks, entities and control characters put in."""
    dirty = F.replace(F.col("text"), F.lit(" "), F.lit(" \n"))
    return documents.select(
        "doc_id", F.replace(dirty, F.lit("."), F.lit("&amp;lt;\x07")).alias("text")
    )
