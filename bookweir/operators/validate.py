"""Model constraints as a quarantine: accepted rows, and rejected rows with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweir.functions.urls import is_http_url
from bookweir.schemas import (
    BOOK_METADATA_RANGES,
    BOOK_RANGES,
    JOB_RANGES,
    JOB_STATUSES,
    JOB_TYPES,
    METADATA,
    RESULT_RANGES,
    RESULT_STATUSES,
    SOURCES,
)


def _out_of_range(columns: list[str], ranges: dict, prefix: str = "") -> list[Column]:
    reasons = []
    for name, (low, high) in ranges.items():
        if name not in columns:
            continue
        value = F.col(f"{prefix}{name}")
        bad = (value < low) if high is None else ~value.between(low, high)
        reasons.append(F.when(bad, F.lit(f"{name} out of range")))
    return reasons


def _not_allowed(columns: list[str], allowed: dict[str, list[str]]) -> list[Column]:
    return [
        F.when(~F.coalesce(F.col(name).isin(values), F.lit(False)), F.lit(f"unknown {name}"))
        for name, values in allowed.items()
        if name in columns
    ]


def _missing(columns: list[str], names: list[str]) -> list[Column]:
    return [F.when(F.col(name).isNull(), F.lit(f"{name} missing")) for name in names if name.split(".")[0] in columns]


def _quarantine(rows: DataFrame, reasons: list[Column]) -> tuple[DataFrame, DataFrame]:
    checked = rows.withColumn("reasons", F.array_compact(F.array(*reasons)))
    bad = F.size("reasons") > 0
    return checked.filter(~bad).drop("reasons"), checked.filter(bad)


def validate_books(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    reasons = [F.when(F.col("metadata.title").isNull(), F.lit("title missing"))]
    reasons += _out_of_range([field.name for field in METADATA.fields], BOOK_METADATA_RANGES, "metadata.")
    reasons += _out_of_range(found.columns, BOOK_RANGES)
    for name in ("cover_image_url", "source_url"):
        url = f"metadata.{name}"
        reasons.append(F.when(F.col(url).isNotNull() & ~is_http_url(url), F.lit(f"{name} is no http url")))
    reasons += _not_allowed(found.columns, {"primary_source": SOURCES})
    return _quarantine(found, reasons)


def validate_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    allowed = {"job_type": JOB_TYPES, "source": SOURCES, "status": JOB_STATUSES}
    reasons = _missing(jobs.columns, ["urls"]) + _not_allowed(jobs.columns, allowed)
    return _quarantine(jobs, reasons + _out_of_range(jobs.columns, JOB_RANGES))


def validate_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    reasons = _missing(results.columns, ["job_id", "source"])
    reasons += _not_allowed(results.columns, {"status": RESULT_STATUSES})
    return _quarantine(results, reasons + _out_of_range(results.columns, RESULT_RANGES))
