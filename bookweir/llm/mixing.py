"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, native throughout.

A source's documents are dealt by hash into blocks. The weights give each source a
target in words; whole passes take every block, the last pass takes blocks in a permuted
order up to the target. That fixes, exactly, how many block draws each source puts into
the mix. The tree then hands these quotas to the output shards: a node splits its counts
per source between its two halves by a multivariate-hypergeometric draw, down to single
shards. A shard takes the next blocks of each source's permuted order, so no block is
drawn twice in a pass, and its documents are shuffled among themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweir.llm.work import WORD, quoted, settle

#: Weights of the sources by code point (null last), repeating; the mix's
#: share of all words; how often a document may be taken.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of a block; larger where the corpus would have more than MOST_BLOCKS of them.
BLOCK_WORDS = 1 << 16
MOST_BLOCKS = 1 << 20
#: Block draws of an output shard.
SHARD_BLOCKS = 64
#: Block draws up to which the decisions on blocks are broadcast (some 20 MB).
BROADCAST_DRAWS = 200_000
SEED = 20


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of the sources: columns source, source_size, s (rank from 0) and target.

    `totals` has one row per source. Weights share out the mix; a source stops at
    `most` times its size and what it can't take goes to the others by weight. With
    sources ordered by size over weight, those that stop are a prefix, so one running
    sum finds the level at which the rest are filled.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("s", rank.cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("w", weight).withColumn("top", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("top") / F.col("w"), "s")
    everything = Window.partitionBy()
    filled = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("total"),
        F.coalesce(F.sum("top").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("below"),
        F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("above"),
    )
    stops = F.col("below") + F.col("top") / F.col("w") * F.col("above") <= F.col("total")
    marked = filled.withColumn("stops", stops)
    level = (F.col("total") - F.sum(F.when(F.col("stops"), F.col("top")).otherwise(0.0)).over(everything)) / F.sum(
        F.when(F.col("stops"), 0.0).otherwise(F.col("w"))
    ).over(everything)
    target = F.when(F.col("stops"), F.col("top")).otherwise(F.least("top", level * F.col("w")))
    return marked.select("source", "source_size", "s", target.alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _let(value: Column, use) -> Column:
    """Evaluate `value` once and use it."""
    return F.transform(F.array(value), use)[0]


def _draw(counts: Column, most: Column, node: Column) -> Column:
    """How many of each source's draws go to a side that takes `most` of the node's draws.

    Draws are dealt one by one, without replacement: each goes to this side with the
    chance of places left over draws left, which is exactly the hypergeometric law.
    """
    everything = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    start = F.struct(most.alias("m"), everything.alias("n"), F.array().cast("array<bigint>").alias("left"))

    def source(state: Column, x: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            hit = (_uniform(node, x["s"], i) * a["n"] < a["m"]).cast("long")
            return F.struct((a["m"] - hit).alias("m"), (a["n"] - 1).alias("n"))

        items = F.when(x["n"] > 0, F.sequence(F.lit(1).cast("long"), x["n"])).otherwise(F.array().cast("array<bigint>"))
        dealt = F.aggregate(items, F.struct(state["m"].alias("m"), state["n"].alias("n")), one)
        return _let(
            dealt,
            lambda d: F.struct(d["m"].alias("m"), d["n"].alias("n"), F.array_append(state["left"], state["m"] - d["m"]).alias("left")),
        )

    numbered = F.transform(counts, lambda n, s: F.struct(n.alias("n"), s.alias("s")))
    return F.aggregate(numbered, start, source, lambda a: a["left"])


def splitting_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """Shares of the shards: columns shard and counts (draws by source, in the order of the quotas).

    `quotas` is one row with the array `counts`. Shard sizes differ by one draw at most.
    """
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    level = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "counts", total.alias("draws"))
    cut = lambda place: F.floor(F.col("draws") * place / F.lit(shards)).cast("long")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        most = cut(mid) - cut(F.col("lo"))
        left = F.when(F.col("hi") - F.col("lo") > 1, _draw(F.col("counts"), most, F.struct("lo", "hi")))
        parted = level.withColumn("left", left)
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        halves = F.when(
            F.col("left").isNull(), F.array(F.struct("lo", "hi", "counts"))
        ).otherwise(
            F.array(
                F.struct(F.col("lo"), mid.alias("hi"), F.col("left").alias("counts")),
                F.struct(mid.alias("lo"), F.col("hi"), right.alias("counts")),
            )
        )
        level = parted.select("draws", F.explode(halves).alias("half")).select("half.*", "draws")
    return level.select(F.col("lo").alias("shard"), "counts")


def _draws(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Block draws of the mix: s, block, pass, place (in the source's order of draws), and rest.

    `rest` is null if the whole block is taken, else the words still wanted of it.
    """
    whole = F.floor(F.col("target") / F.col("source_size"))
    wanted = sources.filter("source_size > 0").select(
        "s",
        whole.cast("long").alias("passes"),
        (F.col("target") - whole * F.col("source_size")).alias("partial"),
    )
    dealt = blocks.join(wanted, "s")
    passes = F.sequence(F.lit(0).cast("long"), F.col("passes"))
    each = dealt.select("*", F.explode(passes).alias("pass"))
    order = Window.partitionBy("s", "pass").orderBy(F.xxhash64(F.lit(SEED), "s", "pass", "block"), "block")
    before = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    each = each.select("*", before.alias("before"), (F.row_number().over(order) - 1).alias("nth"))
    last = F.col("pass") == F.col("passes")
    each = each.filter(~last | (F.col("before") < F.col("partial")))
    left = F.col("partial") - F.col("before")
    return each.select(
        "s",
        "block",
        "pass",
        (F.col("pass") * F.col("n_blocks") + F.col("nth")).alias("place"),
        F.when(last & (left < F.col("words")), left).alias("rest"),
    )


def mix(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every document with what the mix takes of it.

    Columns: row (a struct of the columns in `keep`, all by default), size (words),
    source_size, target, and `taken`, an array with a struct (shard, place) for each time
    the document is taken; `place` orders a shard's documents at random. Documents are
    taken whole. Where a pass ends inside a block, its documents are taken in order as long
    as they fit, so what is left open is less than the smallest that isn't taken.

    Null text has no words and is never taken; null is a source of its own, ordered last;
    repeated rows fall into one block and count each; a source without words has target 0;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    columns = docs.columns if keep is None else keep
    named = [F.col(quoted(f.name)) for f in docs.schema if f.name in (source_col, text_col, "doc_id")]
    measured = [
        F.col(quoted(source_col)).alias("source"),
        words(F.col(quoted(text_col))).alias("size"),
        F.xxhash64(F.lit(SEED), *named).alias("h"),
    ]
    inputs = docs.select(F.struct(*[F.col(quoted(name)) for name in columns]).alias("row"), *measured)
    # Three numbers a document, which every step but the last works on.
    narrow = settle(docs.select(*measured))
    sources = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    # One row per source; the rest of the plan hangs on it three times.
    rows = sources.collect()
    sources = spark.createDataFrame(rows, sources.schema)
    total = sum(r["source_size"] for r in rows)
    block = max(block_words, math.ceil(total / MOST_BLOCKS))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block))).cast("long")
    sources = sources.withColumn("n_blocks", n_blocks)
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    sized = (
        inputs.alias("d")
        .join(sources.alias("t"), same)
        .select("row", "size", "h", "t.s", "source_size", "target", "n_blocks", F.pmod(F.xxhash64("h"), F.col("n_blocks")).alias("block"))
    )
    lean = (
        narrow.alias("d")
        .join(sources.alias("t"), same)
        .select("t.s", "size", "h", "n_blocks", F.pmod(F.xxhash64("h"), F.col("n_blocks")).alias("block"))
    )
    blocks = lean.groupBy("s", "block", "n_blocks").agg(F.sum("size").alias("words"))
    draws = settle(_draws(blocks, sources))
    quotas = draws.groupBy("s").count()
    n_draws = {r["s"]: r["count"] for r in quotas.collect()}  # one row per source
    counts = [n_draws.get(s, 0) for s in range(len(rows))]
    shards = max(1, math.ceil(sum(counts) / shard_blocks))
    root = spark.range(1).select(F.array(*[F.lit(n).cast("long") for n in counts]).cast("array<bigint>").alias("counts"))
    tree = splitting_tree(root, shards).select("shard", F.posexplode("counts").alias("s", "n"))
    up_to = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    spans = tree.select(F.col("s").cast("long").alias("s"), "shard", "n", (F.sum("n").over(up_to) - F.col("n")).alias("first")).filter("n > 0")
    places = spans.select("s", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("nth"))
    # The draws of a source, numbered without gaps in their order, meet the places that the tree gave it.
    in_order = Window.partitionBy("s").orderBy("place")
    drawn = draws.withColumn("nth", (F.row_number().over(in_order) - 1).cast("long")).join(places, ["s", "nth"])
    decided = drawn.groupBy("s", "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("rest").isNull(), F.struct("pass", "shard")))).alias("whole"),
        F.max("rest").alias("rest"),
        F.max(F.when(F.col("rest").isNotNull(), F.struct("pass", "shard"))).alias("partly"),
    )
    # A block that is cut, one for each source at most: its documents go in, in the order of
    # their hashes, as long as they fit. A block has so many words at most, so many documents.
    cut = lean.join(decided.filter("rest IS NOT NULL").select("s", "block", "rest"), ["s", "block"]).filter("size > 0")
    alike = cut.groupBy("s", "block", "rest", "h").agg(F.sum("size").alias("size"))
    items = alike.groupBy("s", "block").agg(
        F.sort_array(F.collect_list(F.struct("h", "size"))).alias("items"), F.max("rest").alias("room")
    )
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("chosen"))

    def add(a: Column, i: Column) -> Column:
        more = F.struct((a["room"] - i["size"]).alias("room"), F.array_append(a["chosen"], i["h"]).alias("chosen"))
        return F.when(i["size"] <= a["room"], more).otherwise(a)

    fitting = items.select("s", "block", F.aggregate("items", start, add, lambda a: a["chosen"]).alias("chosen"))
    decided = decided.join(fitting, ["s", "block"], "left").select("s", "block", "whole", "partly", "chosen")
    if sum(counts) <= BROADCAST_DRAWS:
        # Rows of at most one per draw, each below a hundred bytes, and a cut block's hashes once a
        # source: texts stay where they are. Beyond that many the two sides meet by block.
        decided = F.broadcast(settle(decided))
    one_more = F.coalesce(F.array_contains("chosen", F.col("h")), F.lit(False))
    times = F.concat(
        F.coalesce("whole", F.array().cast("array<struct<pass:bigint,shard:bigint>>")),
        F.when(one_more, F.array("partly")).otherwise(F.array().cast("array<struct<pass:bigint,shard:bigint>>")),
    )
    placed = F.transform(times, lambda t: F.struct(t["shard"].alias("shard"), F.xxhash64(F.lit(SEED), t["shard"], t["pass"], F.col("h")).alias("place")))
    none = F.array().cast("array<struct<shard:bigint,place:bigint>>")
    return sized.join(decided, ["s", "block"], "left").select(
        "row", "size", "source_size", "target", F.when(F.col("size") > 0, placed).otherwise(none).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: documents as often as taken, dealt to shards and shuffled inside each."""
    drawn = mix(docs, **options).select("row", F.explode("taken").alias("t")).select("row", "t.shard", "t.place")
    return drawn.repartition("shard").sortWithinPartitions("shard", "place").select("row.*")


def mix_shares(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted)."""
    found = mix(docs, keep=[id_col], **options)
    taken = F.size("taken").cast("long") * F.col("size")
    return found.select(F.col("row")[id_col].alias(id_col), "size", "source_size", "target", taken.alias("taken"))
