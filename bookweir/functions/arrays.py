"""Helpers for work inside a row, so per-page steps need no shuffle.

Rules over a page's elements are written as SQL text: one parse in the JVM
instead of thousands of calls to build them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quote(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """`body` with `name` standing for `value`, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def attribute(node: str, name: str) -> str:
    """An attribute of an element, null when absent."""
    return f"try_element_at({node}.attrs, {quote(name)})"


def hold(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns that are computed once per row.

    A plain projection may be copied into every later filter and field access;
    a generator output may not.
    """
    return df.select("*", F.expr(f"inline(array({struct(**columns)}))"))


def with_runs(df: DataFrame, name: str, source: str, same: str) -> DataFrame:
    """Add `name`: the array column `source` cut into runs of neighbours.

    `same` tells for `a` and its predecessor `b` whether they belong together.
    The array is read by position, so a page with many entries costs its length
    and not its square.
    """
    starts = f"_{name}_starts"
    here = same.replace("a.", f"element_at({source}, i).").replace("b.", f"element_at({source}, greatest(i - 1, 1)).")
    indexes = f"CASE WHEN size({source}) > 0 THEN sequence(1, size({source})) ELSE cast(array() AS array<int>) END"
    run = f"slice({source}, first, coalesce(get({starts}, j + 1), size({source}) + 1) - first)"
    return (
        df.withColumn(starts, F.expr(f"filter({indexes}, i -> CASE WHEN i = 1 THEN true ELSE NOT ({here}) END)"))
        .withColumn(name, F.expr(f"transform({starts}, (first, j) -> {run})"))
        .drop(starts)
    )
