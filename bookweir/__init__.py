"""Book-crawl analytics and extraction as PySpark jobs."""
