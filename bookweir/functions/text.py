"""Text cleaning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity replacements, applied in this order.
ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
]
# Java's \s is ASCII only; (?U) widens it, and the four separators below
# U+0020 count as white space as well.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
# All control characters; tabs and line breaks are spaces by then.
_CONTROL = r"\p{Cc}"


def clean_text(text: Column) -> Column:
    """Collapse white space, decode six entities, drop control characters, strip.

    Once the white space is collapsed only plain spaces are left to strip.
    """
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, _CONTROL, ""))
