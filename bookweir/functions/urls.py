"""URL splitting, joining and limiter keys as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookweir.functions.arrays import let, struct

# RFC 3986, appendix B: scheme, authority, path, query, fragment.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Schemes whose references may be relative.
_HIERARCHICAL = [
    "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero",
    "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]


_NO_TEXT = "cast(array() AS array<string>)"


def _tidy(url: str) -> str:
    return rf"regexp_replace(regexp_replace({url}, r'^[\x00-\x20]+', ''), r'[\t\r\n]', '')"


def _part(url: str, group: int) -> str:
    return f"regexp_extract({url}, r'{_PARTS}', {group})"


def _split(url: str) -> str:
    parts = struct(
        scheme=f"lower({_part('u', 1)})",
        authority=_part("u", 2),
        path=_part("u", 3),
        query=_part("u", 4),
        fragment=_part("u", 5),
    )
    return let("u", _tidy(url), parts)


def _without_last(items: str) -> str:
    return f"slice({items}, 1, greatest(size({items}) - 1, 0))"


def _merged_path(base: str, path: str) -> str:
    """Path of a reference: a relative one starts in the base's directory, dots are folded away."""
    directory = let(
        "d", f"split({base}, '/')", f"CASE WHEN element_at(d, -1) = '' THEN d ELSE {_without_last('d')} END"
    )
    relative = let(
        "p",
        f"concat({directory}, split({path}, '/'))",
        "filter(p, (seg, i) -> i = 0 OR i = size(p) - 1 OR seg <> '')",
    )
    segments = f"CASE WHEN startswith({path}, '/') THEN split({path}, '/') ELSE {relative} END"
    kept = f"""aggregate(segs, {_NO_TEXT}, (acc, seg) -> CASE WHEN seg = '.' THEN acc
      WHEN seg = '..' THEN {_without_last('acc')} ELSE concat(acc, array(seg)) END)"""
    tail = f"CASE WHEN element_at(segs, -1) IN ('.', '..') THEN array('') ELSE {_NO_TEXT} END"
    return f"coalesce(nullif({let('segs', segments, f"array_join(concat({kept}, {tail}), '/')")}, ''), '/')"


def _prefixed(prefix: str, text: str) -> str:
    return f"CASE WHEN {text} <> '' THEN concat('{prefix}', {text}) ELSE '' END"


_TARGET = struct(
    scheme="CASE WHEN parts.r.scheme <> '' THEN parts.r.scheme ELSE parts.b.scheme END",
    authority="CASE WHEN parts.r.authority <> '' THEN parts.r.authority ELSE parts.b.authority END",
    path=f"""CASE WHEN parts.r.authority <> '' THEN parts.r.path WHEN parts.r.path = '' THEN parts.b.path
      ELSE {_merged_path("parts.b.path", "parts.r.path")} END""",
    query="""CASE WHEN parts.r.authority = '' AND parts.r.path = '' AND parts.r.query = '' THEN parts.b.query
      ELSE parts.r.query END""",
    fragment="parts.r.fragment",
)
_JOINED = f"""concat(
  CASE WHEN t.scheme <> '' THEN concat(t.scheme, ':') ELSE '' END, {_prefixed("//", "t.authority")},
  CASE WHEN t.authority <> '' AND t.path <> '' AND NOT startswith(t.path, '/') THEN '/' ELSE '' END, t.path,
  {_prefixed("?", "t.query")}, {_prefixed("#", "t.fragment")})"""


def resolved(base: str, ref: str) -> str:
    """SQL text: absolute form of `ref` against `base`; `ref` unchanged without a base."""
    schemes = ", ".join(f"'{scheme}'" for scheme in ("", *_HIERARCHICAL))
    absolute = let(
        "parts",
        struct(b=_split(base), r=_split(ref)),
        f"""CASE WHEN parts.r.scheme IN ('', parts.b.scheme) AND parts.b.scheme IN ({schemes})
          THEN {let("t", _TARGET, _JOINED)} ELSE {ref} END""",
    )
    return f"CASE WHEN {base} IS NULL OR {base} = '' THEN {ref} WHEN {ref} = '' THEN {base} ELSE {absolute} END"


def resolve_url(base: str, ref: str) -> Column:
    return F.expr(resolved(base, ref))


def domain_key(url: str) -> Column:
    """Limiter key: the authority with user info and port, `default` when unreadable."""
    authority = let("host", _part(_tidy(url), 2), "CASE WHEN contains(host, '[') = contains(host, ']') THEN host END")
    return F.expr(f"coalesce({authority}, 'default')")


def http_url(url: str) -> str:
    """SQL text: true for an http(s) URL with a host."""
    scheme, host = f"try_parse_url({url}, 'PROTOCOL')", f"try_parse_url({url}, 'HOST')"
    return f"coalesce(lower({scheme}) IN ('http', 'https') AND length({host}) > 0, false)"


def is_http_url(url: str) -> Column:
    return F.expr(http_url(url))
