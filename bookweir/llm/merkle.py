"""Merkle manifest of a table by a nested-struct rollup, native throughout.

Every row is a leaf, every source a tree of runs of 16, the subroots of the sources a tree
above them. A row's rank in its source is written in base 16. Rows meet once, narrow, by
block (16^DIGITS consecutive leaves); inside a block the digit columns are grouped away one
after the other: siblings become an array, the array's hash the parent, and the parent's
struct holds its children. What is left is one row per block with the block's whole tree
in it, so a transform over the nested arrays knows every leaf's siblings, and an explode
gives the proofs out: leaves are never joined. Above the blocks the same rollup goes on
with one row per block, then per block of blocks; a block learns the way to the root by
its number, one narrow row per 16^DIGITS leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweir.llm.work import quoted, settle

#: Children of a node, fixed by the manifest's format.
FANOUT = 16
#: Levels of a block: 16^2 leaves are nested in one row, some tens of kilobytes.
DIGITS = 2
#: Leaves of a range partition, each about 150 bytes; at most so many partitions, for the
#: driver draws a sample of the keys of each (a larger one spills while it is sorted).
PART_LEAVES = 50_000
MOST_PARTS = 1 << 15
#: Tampering: every row whose crc32 of the id this divides.
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<i:int,run:array<string>>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _field(value: Column) -> Column:
    """`-` for null, else the UTF-8 length in bytes, a colon and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def _leaf(columns: list[Column]) -> Column:
    return digest(F.concat(*[_field(c) for c in columns]))


def leaves(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    other_cols: tuple = ("lang", "n_chars"),
    text_col: str = "text",
) -> DataFrame:
    """Columns source, id, leaf, and tampered (the leaf of the altered row, null where nothing is altered)."""
    ident, source, text = (F.col(quoted(c)) for c in (id_col, source_col, text_col))
    before = [ident, source, *[F.col(quoted(c)) for c in other_cols]]
    lowered = F.translate(text, _UPPER, _LOWER)
    hit = F.crc32(ident.cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        source.alias("source"),
        ident.alias("id"),
        _leaf([*before, text]).alias("leaf"),
        F.when(hit, _leaf([*before, lowered])).alias("tampered"),
    )


def _parts(n: int) -> int:
    return min(MOST_PARTS, max(1, math.ceil(n / PART_LEAVES)))


def ranked(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The rows (a table, read twice) with `rank`, from 0, in their group, and the group's size `n`.

    Sampled splitters cut the order of all groups into even parts, so a group that
    holds a third of the rows spans a third of the parts. Only the sizes by (part, group)
    meet: a row per part and one per group.
    """
    placed = rows.repartitionByRange(_parts(n), *group, *order).sortWithinPartitions(*group, *order)
    placed = settle(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = placed.groupBy("part", *group).agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    own = Window.partitionBy(*group)
    earlier = F.sum("here").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(
        "part", *group, (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(own).alias("n")
    )
    same = [F.col("l.part") == F.col("r.part"), *[F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]]
    joined = placed.alias("l").join(sizes.alias("r"), same)
    return joined.select(*[f"l.{c}" for c in rows.columns], (F.col("at") + F.col("shift")).alias("rank"), "n")


def _up(n: Column, levels: int) -> Column:
    """Nodes that n nodes have become after some levels."""
    return F.ceil(n / F.lit(FANOUT**levels)).cast("long")


def _rollup(nodes: DataFrame, group: list[str], payload: list[str], digits: int) -> DataFrame:
    """Blocks of nodes: columns of the group, block, n, hash and kids.

    `nodes` has the group's columns, rank, n (nodes of the group), hash and the payload.
    `kids` nests `digits` arrays of structs (digit, hash, kids); the innermost has the
    payload in place of kids. A group of a single node isn't hashed any further.
    """
    wide = FANOUT**digits
    keys = [f"d{k}" for k in range(1, digits)]  # d1: the last digit but one, and so on
    cut = lambda k: F.floor(F.col("rank") / F.lit(FANOUT**k)).cast("long")
    level = nodes.select(
        *group,
        "n",
        cut(digits).alias("block"),
        *[(cut(k) % FANOUT).cast("int").alias(f"d{k}") for k in range(digits)],
        "hash",
        F.struct(*[F.col(c) for c in payload]).alias("kids"),
    )
    # One exchange, by block; every grouping after it is finer and stays where it is.
    level = level.repartition(*group, "block")
    for k in range(digits):
        rest = keys[k:]
        level = level.groupBy(*group, "n", "block", *rest).agg(
            F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "hash", "kids"))).alias("kids")
        )
        several = _up(F.col("n"), k) > 1
        level = level.withColumn("hash", F.when(several, _hash_of("kids")).otherwise(F.col("kids")[0]["hash"]))
    return level.select(*group, "n", "block", "hash", "kids", F.lit(wide).alias("wide"))


def _hash_of(kids) -> Column:
    kids = F.col(kids) if isinstance(kids, str) else kids
    return digest(F.array_join(F.transform(kids, lambda x: x["hash"]), ""))


def _step(kids: Column, at: Column, n: Column, level: int) -> Column:
    """The path's entry for the child at a place of a run, none where the level doesn't exist."""
    entry = F.array(F.struct(at.cast("int").alias("i"), F.transform(kids, lambda x: x["hash"]).alias("run")))
    return F.when(_up(n, level) > 1, entry).otherwise(F.array().cast(_PATH))


def _handed_down(blocks: DataFrame, group: list[str], digits: int) -> DataFrame:
    """The path of every node below blocks that know theirs: group, rank, path (from the node upwards)."""

    def below(kids: Column, level: int, above: Column, rank: Column) -> Column:
        """Flat array of (rank, path) of the nodes under one array of siblings."""

        def one(x: Column, i: Column) -> Column:
            path = F.concat(_step(kids, i, F.col("n"), level), above)
            here = rank * FANOUT + i
            if level == 0:
                return F.array(F.struct(here.cast("long").alias("rank"), path.alias("path")))
            return below(x["kids"], level - 1, path, here)

        return F.flatten(F.transform(kids, one))

    found = below(F.col("kids"), digits - 1, F.col("path"), F.col("block"))
    return blocks.select(*group, F.explode(found).alias("x")).select(*group, "x.rank", "x.path")


def _with_paths(blocks: DataFrame, paths: DataFrame, group: list[str]) -> DataFrame:
    """Blocks joined with their own paths by number: one narrow row per block on either side."""
    same = [F.col("b.block") == F.col("p.rank"), *[F.col(f"b.{g}").eqNullSafe(F.col(f"p.{g}")) for g in group]]
    return blocks.alias("b").join(paths.alias("p"), same).select("b.*", "p.path")


def _climb(nodes: DataFrame, group: list[str], payload: list[str], most: int, digits: int) -> list[DataFrame]:
    """Rounds of blocks from the nodes up to one block per group; `most` is the largest group's size."""
    rounds = [settle(_rollup(nodes, group, payload, digits))]
    left = math.ceil(most / FANOUT**digits)
    while left > 1:
        done = rounds[-1]
        upper = done.select(*group, F.col("block").alias("rank"), _up(F.col("n"), digits).alias("n"), "hash")
        rounds.append(settle(_rollup(upper, group, ["rank"], digits)))
        left = math.ceil(left / FANOUT**digits)
    return rounds


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    other_cols: tuple = ("lang", "n_chars"),
    text_col: str = "text",
    digits: int = DIGITS,
) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A source's leaves ascend by id, null ids first; rows that repeat an id ascend by
    their leaves, so equal rows get the same set of proofs whichever comes first. Null is a
    source of its own, before all others; an empty text is one of length 0, unlike a null
    one. A null id is never tampered with. A single row is its own subroot and root, and
    its proof the digest of nothing. An empty table gives an empty result. Other columns
    are not read.
    """
    found = settle(leaves(docs, id_col, source_col, other_cols, text_col))
    placed = ranked(found, ["source"], ["id", "leaf"], found.count())
    most = found.groupBy("source").count().agg(F.max("count")).collect()[0][0] or 0
    nodes = placed.select("source", "rank", "n", F.col("leaf").alias("hash"), "id", "tampered")
    rounds = _climb(nodes, ["source"], ["id", "tampered"], most, digits)

    # The tree over the sources' subroots: one group of all.
    subroots = settle(rounds[-1].select(F.lit(0).alias("all"), "source", "hash"))
    n_sources = subroots.count()
    tops = ranked(subroots, ["all"], ["source"], n_sources)
    top_rounds = _climb(tops, ["all"], ["source"], n_sources, digits)
    root = top_rounds[-1].select("hash").first()  # one value, or none

    # Down again: the path of every round's blocks, then of the sources, then of theirs.
    paths = top_rounds[-1].select("all", F.col("block").alias("rank"), F.array().cast(_PATH).alias("path"))
    for blocks in reversed(top_rounds):
        paths = _handed_down(_with_paths(blocks, paths, ["all"]), ["all"], digits)
    same = (F.col("s.all") == F.col("p.all")) & (F.col("s.rank") == F.col("p.rank"))
    ranks = tops.select("all", "rank", "source", "hash")
    of_source = settle(ranks.alias("s").join(paths.alias("p"), same).select("s.source", "path", F.col("s.hash").alias("subroot")))
    paths = of_source.select("source", F.lit(0).cast("long").alias("rank"), "path")
    for blocks in reversed(rounds[1:]):
        paths = _handed_down(_with_paths(blocks, paths, ["source"]), ["source"], digits)
    known = _with_paths(rounds[0], paths, ["source"])
    named = known.alias("k").join(
        of_source.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source"))
    ).select("k.*", "s.subroot")
    return _proofs(named.withColumn("root", F.lit(root[0] if root else None).cast("string")), id_col, digits)


def _others(run: Column, i: Column) -> Column:
    return F.array_join(F.concat(F.slice(run, 1, i), F.slice(run, i + 2, F.lit(FANOUT))), "")


def _fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path of (place, run)."""

    def up(hashed: Column, step: Column) -> Column:
        run, i = step["run"], step["i"]
        before, after = F.slice(run, 1, i), F.slice(run, i + 2, F.lit(FANOUT))
        return digest(F.array_join(F.concat(before, F.array(hashed), after), ""))

    return F.aggregate(path, start, up)


def _proofs(blocks: DataFrame, id_col: str, digits: int) -> DataFrame:
    """Transform every block's nested arrays into its leaves' proofs and explode them."""
    above = F.array_join(F.transform("path", lambda s: _others(s["run"], s["i"])), "")
    ready = blocks.withColumn("above", above)

    def below(kids: Column, level: int, steps: Column, siblings: Column) -> Column:
        """`steps` and `siblings` are those of the run's parent within the block, and upwards."""
        exists = _up(F.col("n"), level) > 1

        def one(x: Column, i: Column) -> Column:
            step = _step(kids, i, F.col("n"), level)
            own = F.when(exists, _others(F.transform(kids, lambda y: y["hash"]), i)).otherwise(F.lit(""))
            path, said = F.concat(step, steps), F.concat(own, siblings)
            if level:
                return below(x["kids"], level - 1, path, said)
            return F.array(
                F.struct(
                    x["kids"]["id"].alias("id"),
                    x["hash"].alias("leaf"),
                    digest(said).alias("proof_sha256"),
                    _fold(F.coalesce(x["kids"]["tampered"], x["hash"]), path).alias("folded_root"),
                )
            )

        return F.flatten(F.transform(kids, one))

    found = below(F.col("kids"), digits - 1, F.col("path"), F.col("above"))
    rows = ready.select("subroot", "root", F.explode(found).alias("x"))
    return rows.select(
        F.col("x.id").alias(id_col),
        F.col("x.leaf").alias("leaf"),
        "subroot",
        "root",
        F.col("x.proof_sha256").alias("proof_sha256"),
        F.col("x.folded_root").alias("folded_root"),
        (F.col("x.folded_root") == F.col("root")).alias("verified"),
    )


# The same manifest in DuckDB SQL. `tree` has every level of both trees: a source's nodes, then
# (tag 1) those above the subroots. The checksum goes through the id's digits bit by bit.
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_ALTERED = f"translate(text, '{_UPPER}', '{_LOWER}')"
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS t, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, t, k + 1,
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
  FROM (SELECT doc_id, t, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(t, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x
        FROM bits WHERE k < 8 * length(t))),
sums AS (SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS crc FROM bits WHERE k = 8 * length(t)),
leaf AS (
  SELECT row_number() OVER () AS u, d.doc_id, source, sha256({_FIELDS.replace('doc_id', 'd.doc_id')} || {_FIELD.format('text')}) AS leaf,
    sha256({_FIELDS.replace('doc_id', 'd.doc_id')} || {_FIELD.format(f"CASE WHEN crc % {TAMPERED} = 0 THEN {_ALTERED} ELSE text END")}) AS altered
  FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM leaf),
tree AS (
  SELECT 0 AS lvl, s, CAST(i AS BIGINT) AS i, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM placed
  UNION ALL
  SELECT lvl + 1, s, i // 16, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(max(n) / 16.0) AS BIGINT)
  FROM tree WHERE n > 1 GROUP BY lvl, s, i // 16),
subroots AS (SELECT s, h FROM tree WHERE n = 1),
above AS (
  SELECT 0 AS lvl, CAST(s AS BIGINT) AS i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(max(n) / 16.0) AS BIGINT)
  FROM above WHERE n > 1 GROUP BY lvl, i // 16),
runs AS (SELECT lvl, s, i // 16 AS p, list(h ORDER BY i) AS r FROM tree WHERE n > 1 GROUP BY lvl, s, i // 16),
top_runs AS (SELECT lvl, i // 16 AS p, list(h ORDER BY i) AS r FROM above WHERE n > 1 GROUP BY lvl, i // 16),
depth AS (SELECT s, max(lvl) AS d FROM tree GROUP BY s),
walk AS (
  SELECT u, d.s, 0 AS lvl, CAST(i AS BIGINT) AS i, altered AS h, '' AS said, d.d FROM placed JOIN depth d ON d.s = placed.s
  UNION ALL
  SELECT w.u, w.s, w.lvl + 1, CASE WHEN w.lvl + 1 = w.d THEN w.s ELSE w.i // 16 END,
    sha256(array_to_string(list_concat(r.r[1:w.i % 16], [w.h], r.r[w.i % 16 + 2:16]), '')),
    w.said || array_to_string(list_concat(r.r[1:w.i % 16], r.r[w.i % 16 + 2:16]), ''), w.d
  FROM walk w JOIN runs r ON w.lvl < w.d AND r.lvl = w.lvl AND r.s = w.s AND r.p = w.i // 16),
up AS (
  SELECT u, s, 0 AS lvl, CAST(s AS BIGINT) AS i, h, said FROM walk WHERE lvl = d
  UNION ALL
  SELECT w.u, w.s, w.lvl + 1, w.i // 16,
    sha256(array_to_string(list_concat(r.r[1:w.i % 16], [w.h], r.r[w.i % 16 + 2:16]), '')),
    w.said || array_to_string(list_concat(r.r[1:w.i % 16], r.r[w.i % 16 + 2:16]), '')
  FROM up w JOIN top_runs r ON r.lvl = w.lvl AND r.p = w.i // 16),
root AS (SELECT lvl, h FROM above WHERE n = 1)
SELECT p.doc_id, p.leaf, sr.h AS subroot, root.h AS root, sha256(up.said) AS proof_sha256, up.h AS folded_root, up.h = root.h AS verified
FROM placed p JOIN subroots sr ON sr.s = p.s CROSS JOIN root JOIN up ON up.u = p.u AND up.lvl = root.lvl"""
