"""Hard negatives by coordinate pruning over length buckets (after LEMP).

Vectors are range-partitioned by length into buckets, and a bucket is packed into one row:
its vectors, and for every coordinate the list of its vectors sorted by that coordinate of
the vector's direction. A score q.p of at least s asks for an angle between q and p of at
most arccos(s / (|q| l)), l the bucket's greatest length; so on every coordinate p must lie
in a range around q's own value. The ranges of an anchor's focus coordinates, its largest,
are looked up in the sorted lists and the sets found there intersected; what is left is
scored exactly. A bucket too short for s is skipped unread.

s comes from a bounded sample of rows: the k-th best score of an anchor among them is a
lower bound of its k-th best of all, so it prunes but never changes a result. Anchors meet
buckets in blocks, so no task holds more than a block of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookweir.llm.work import begin, quoted, settle

#: Vectors of a bucket: more of them in larger tables, up to what a list's 16-bit places can hold.
BUCKET_ROWS = 8192
MOST_BUCKET_ROWS = 65_000
#: Bytes of a bucket's vectors at most (wide vectors), of an anchor block and of the sample.
BLOCK_BYTES = 8 << 20
ANCHOR_BYTES = 2 << 20
SAMPLE_BYTES = 1 << 20
SAMPLE_ROWS = 4096
#: Coordinates on which an anchor's candidates are cut.
FOCUS = 6
#: Room for rounding where angles are compared.
_SLACK = 1e-9
#: Float sums of whole numbers are exact below this (with room for a factor of five).
_EXACT = 2.0**50

_ROWS = "uid long, id long, label long, len double, dim int, vec binary"
_BUCKET = "bucket long, n int, dim int, longest double, wide boolean, uids binary, ids binary, labels binary, vecs binary, lists binary"
_BLOCK = "block long, n int, dim int, wide boolean, uids binary, ids binary, labels binary, vecs binary, least binary, positives binary"


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * x)


def _as_rows(batches):
    """Whole-number vectors of the rows that take part, with their lengths."""
    begin()
    for batch in batches:
        known = pc.and_(pc.and_(batch.column(1).is_valid(), batch.column(2).is_valid()), batch.column(3).is_valid())
        batch = batch.filter(known)
        lists = batch.column(3)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are NaN
        with np.errstate(over="ignore", invalid="ignore"):
            whole = quantised(flat)
        of = np.repeat(np.arange(len(sizes)), sizes)
        good = np.bincount(of, ~np.isfinite(whole), minlength=len(sizes)) == 0
        with np.errstate(over="ignore"):
            lengths = np.sqrt(np.bincount(of, np.where(np.isfinite(whole), whole, 0.0) ** 2, minlength=len(sizes)))
        ends = np.cumsum(sizes)
        vecs = [whole[e - s : e].astype("<f8").tobytes() if g else None for e, s, g in zip(ends, sizes, good)]
        columns = [
            batch.column(0),
            batch.column(1),
            batch.column(2).cast(pa.int64()),
            pa.array(lengths),
            pa.array(sizes, pa.int32()),
            pa.array(vecs, pa.binary()),
        ]
        out = pa.RecordBatch.from_arrays(columns, names=["uid", "id", "label", "len", "dim", "vec"])
        yield out.filter(pa.array(good))


def _matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones count as filled up with zeros."""
    out = np.zeros((len(vecs), dim))
    if vecs and all(len(v) == 8 * dim for v in vecs):
        out[:] = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), dim)
    else:
        for k, v in enumerate(vecs):
            out[k, : len(v) // 8] = np.frombuffer(v, "<f8")
    return out


def _packed(matrix: np.ndarray) -> tuple[bool, bytes]:
    """Whether eight bytes a component are needed, and the bytes."""
    wide = bool(len(matrix)) and bool(matrix.size) and float(np.abs(matrix).max()) > 32767
    return wide, matrix.astype("<f8" if wide else "<i2").tobytes()


def _unpacked(wide: bool, data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8" if wide else "<i2").reshape(n, dim).astype(np.float64)


def _directions(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        lengths = np.sqrt((matrix**2).sum(1, keepdims=True))
        return np.nan_to_num(matrix / lengths, nan=0.0, posinf=1.0, neginf=-1.0)


def _pack_buckets(most: int):
    """Pack a partition, longest vectors first, into buckets with their sorted lists."""

    def bucket(rows: list[tuple]) -> dict:
        uids, ids, labels, lengths, dims, vecs = zip(*rows)
        dim = max(dims)
        matrix = _matrix(list(vecs), dim)
        lists = np.argsort(_directions(matrix), axis=0, kind="stable").T.astype("<u2")
        wide, data = _packed(matrix)
        return {
            "bucket": uids[0],
            "n": len(rows),
            "dim": dim,
            "longest": max(lengths),
            "wide": wide,
            "uids": np.array(uids, "<i8").tobytes(),
            "ids": np.array(ids, "<i8").tobytes(),
            "labels": np.array(labels, "<i8").tobytes(),
            "vecs": data,
            "lists": np.ascontiguousarray(lists).tobytes(),
        }

    def run(batches):
        begin()
        held, widest = [], 1
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                widest = max(widest, row[4])
                if held and (len(held) >= most or (len(held) + 1) * 8 * widest > BLOCK_BYTES):
                    yield pa.RecordBatch.from_pylist([bucket(held)], schema=_BUCKET_ARROW)
                    held, widest = [], max(1, row[4])
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([bucket(held)], schema=_BUCKET_ARROW)

    return run


_BUCKET_ARROW = pa.schema(
    [
        ("bucket", pa.int64()),
        ("n", pa.int32()),
        ("dim", pa.int32()),
        ("longest", pa.float64()),
        ("wide", pa.bool_()),
        *[(name, pa.binary()) for name in ("uids", "ids", "labels", "vecs", "lists")],
    ]
)
_BLOCK_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("n", pa.int32()),
        ("dim", pa.int32()),
        ("wide", pa.bool_()),
        *[(name, pa.binary()) for name in ("uids", "ids", "labels", "vecs", "least", "positives")],
    ]
)


def scores(matrix: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, exact: as floats where these are exact, else as integers."""
    dim = min(matrix.shape[1], anchors.shape[1])
    a, b = matrix[:, :dim], anchors[:, :dim]
    if not dim or not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * dim < _EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return whole(a) @ whole(b).T


class Bucket:
    """A bucket in a task: exact vectors, and their directions by sorted coordinate."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.n, self.dim, self.longest = n, dim, row["longest"]
        self.uids, self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("uids", "ids", "labels"))
        self.vectors = _unpacked(row["wide"], row["vecs"], n, dim)
        self.lists = np.frombuffer(row["lists"], "<u2").reshape(dim, n)
        directions = _directions(self.vectors)
        self.sorted = np.take_along_axis(directions.T, self.lists.astype(np.int64), axis=1)

    def candidates(self, anchor: np.ndarray, least: float, focus: int = FOCUS) -> np.ndarray | None:
        """Places of all vectors that may score `least`; None for every vector of the bucket."""
        with np.errstate(over="ignore", invalid="ignore"):
            norm = float(np.sqrt((anchor**2).sum()))
            reach = norm * self.longest
        if not least > 0 or not math.isfinite(reach):
            return None  # a score of nothing, or less, puts no bound on the angle
        if least > reach * (1 + _SLACK):
            return np.zeros(0, np.int64)
        widest = math.acos(max(-1.0, min(1.0, least / reach - _SLACK)))
        own = anchor[: self.dim] / norm
        met, used = np.zeros(self.n, np.uint8), 0
        for f in np.argsort(-np.abs(own), kind="stable")[:focus]:
            angle = math.acos(max(-1.0, min(1.0, own[f])))
            low = math.cos(min(math.pi, angle + widest)) - _SLACK
            high = math.cos(max(0.0, angle - widest)) + _SLACK
            lo, hi = np.searchsorted(self.sorted[f], low, "left"), np.searchsorted(self.sorted[f], high, "right")
            if hi - lo < self.n:
                met[self.lists[f, lo:hi]] += 1
                used += 1
        return np.flatnonzero(met == used) if used else None


class Anchors:
    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.n = n
        self.uids, self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("uids", "ids", "labels"))
        self.vectors = _unpacked(row["wide"], row["vecs"], n, dim)
        self.least = np.frombuffer(row["least"], "<f8")
        # Score and id of each anchor's positives, best first, and 1; zeros where there are fewer.
        self.positives = np.frombuffer(row["positives"], "<i8").reshape(n, -1, 3)


def _best(score: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(score) > 4 * k and score.dtype != object:
        least = np.partition(score, len(score) - k)[len(score) - k]
        places = np.flatnonzero(score >= least)
    else:
        places = np.arange(len(score))
    order = sorted(places.tolist(), key=lambda p: (-score[p], ids[p], uids[p])) if score.dtype == object else places[
        np.lexsort((uids[places], ids[places], -score[places]))
    ].tolist()
    return np.array(order[:k], np.int64)


def _long(values: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; one beyond them counts as the largest or smallest of them."""
    if values.dtype == object:
        return np.array([min(max(int(v), -(2**63)), 2**63 - 1) for v in values], np.int64)
    return values.astype(np.int64)


_FOUND = "auid long, aid long, nth int, pid long, pscore long, score long, id long, uid long"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _found(parts: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(8)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_FOUND_NAMES)


def _each(bucket: Bucket, anchors: Anchors, focus: int):
    """Every anchor with the places and exact scores of its candidates of the bucket."""
    for lo in range(0, anchors.n, 64):
        some = range(lo, min(lo + 64, anchors.n))
        found = {k: bucket.candidates(anchors.vectors[k], float(anchors.least[k]), focus) for k in some}
        # Where many are left, one product for all of these anchors is cheaper than picking rows.
        broad = [k for k in some if found[k] is None or len(found[k]) > bucket.n // 16]
        column = {k: c for c, k in enumerate(broad)}
        all_scores = scores(bucket.vectors, anchors.vectors[broad]) if broad else None
        for k in some:
            places = np.arange(bucket.n) if found[k] is None else found[k]
            if not len(places):
                continue
            if k in column:
                yield k, places, all_scores[places, column[k]]
            else:
                yield k, places, scores(bucket.vectors[places], anchors.vectors[k : k + 1])[:, 0]


def _positives_of(most: int, focus: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            bucket, anchors = Bucket(left.to_pylist()[0]), Anchors(right.to_pylist()[0])
            for k, places, score in _each(bucket, anchors, focus):
                fits = (bucket.labels[places] == anchors.labels[k]) & (bucket.uids[places] != anchors.uids[k])
                places, score = places[fits], score[fits]
                best = _best(score, bucket.ids[places], bucket.uids[places], most)
                if len(best):
                    size, chosen = len(best), places[best]
                    none = np.zeros(size, np.int64)
                    parts.append(
                        (none + anchors.uids[k], none + anchors.ids[k], none, none, none, _long(score[best]), bucket.ids[chosen], bucket.uids[chosen])
                    )
        return _found(parts)

    return run


def _negatives_of(most: int, share: tuple[int, int], focus: int):
    low, high = share

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            bucket, anchors = Bucket(left.to_pylist()[0]), Anchors(right.to_pylist()[0])
            for k, places, score in _each(bucket, anchors, focus):
                positives = [p for p in anchors.positives[k].tolist() if p[2]]
                fits = bucket.labels[places] != anchors.labels[k]
                fits &= (score >= anchors.least[k]) & (score <= positives[0][0])
                places, score = places[fits], score[fits]
                if not len(places):
                    continue
                order = _best(score, bucket.ids[places], bucket.uids[places], len(places))
                places, score = places[order], score[order]
                for nth, (top, pid, _) in enumerate(positives):
                    first = int(np.argmax(score <= top)) if score[-1] <= top else len(score)
                    some = slice(first, first + most)
                    chosen = places[some][high * score[some] >= low * top]
                    value = score[some][: len(chosen)]  # scores fall, so the ones that fit come first
                    none = np.zeros(len(chosen), np.int64)
                    parts.append(
                        (none + anchors.uids[k], none + anchors.ids[k], none + nth, none + pid, none + top, _long(value), bucket.ids[chosen], bucket.uids[chosen])
                    )
        return _found(parts)

    return run


def _sample(rows: DataFrame, dim: int) -> dict:
    """A bounded sample of the rows, by the hash of their numbers, at the driver."""
    size = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, dim))))
    found = rows.orderBy(F.xxhash64("uid"), "uid").limit(size).collect()
    return {
        "uids": np.array([r.uid for r in found], np.int64),
        "labels": np.array([r.label for r in found], np.int64),
        "vecs": _matrix([bytes(r.vec) for r in found], max([r.dim for r in found], default=0)),
    }


def _kth(values: np.ndarray, k: int) -> float:
    """A lower bound of the k-th best; no bound where there are fewer."""
    if len(values) < k:
        return -math.inf
    kth = sorted(values.tolist(), reverse=True)[k - 1]
    return float(kth) * (1 - 1e-12) if kth > 0 else -math.inf


def _pack_anchors(sample: dict, most: int, chosen: int, share: tuple[int, int] | None):
    """Pack a block of anchors with the least score that can count for each.

    Without `share` that is for positives; with it for negatives, whose anchors come with
    their positives.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        # (a key never comes without rows)
        dim = max(r["dim"] for r in rows)
        vectors = _matrix([r["vec"] for r in rows], dim)
        least, positives = np.full(len(rows), -math.inf), np.zeros((len(rows), chosen, 3), np.int64)
        against = scores(sample["vecs"], vectors)
        for k, row in enumerate(rows):
            if share is None:
                fits = (sample["labels"] == row["label"]) & (sample["uids"] != row["uid"])
                least[k] = _kth(against[fits, k], chosen)
                continue
            own = against[sample["labels"] != row["label"], k]
            bounds = []
            for nth, p in enumerate(row["positives"]):
                positives[k, nth] = p["score"], p["id"], 1
                floor = share[0] * p["score"] / share[1]
                in_band = own[(own <= p["score"]) & (own >= floor)]
                bounds.append(max(floor * (1 - 1e-12) if floor > 0 else floor, _kth(in_band, most)))
            least[k] = min(bounds)
        wide, data = _packed(vectors)
        row = {"block": rows[0]["block"], "n": len(rows), "dim": dim, "wide": wide, "vecs": data}
        for name, column in (("uids", "uid"), ("ids", "id"), ("labels", "label")):
            row[name] = np.array([r[column] for r in rows], "<i8").tobytes()
        row |= {"least": least.astype("<f8").tobytes(), "positives": positives.astype("<i8").tobytes()}
        return pa.Table.from_pylist([row], schema=_BLOCK_ARROW)

    return run


def _met(buckets: DataFrame, n_buckets: int, blocks: DataFrame, n_blocks: int, work) -> DataFrame:
    """Every block of anchors at every bucket, one pair of them a group."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = buckets.select("*", every(n_blocks).alias("block"))
    right = blocks.select("*", every(n_buckets).alias("slot"))
    return left.groupBy("slot", "block").cogroup(right.groupBy("slot", "block")).applyInArrow(work, _FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows per key; the limit is applied before the shuffle as well."""
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    focus: int = FOCUS,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A row's score is the integer inner product of its vector, as whole numbers floor(256 x),
    with the anchor's; higher scores come first, ties by smaller id. An anchor's positives
    are its first other rows of the same label. For each the first rows of another label
    are returned whose score is at least share[0]/share[1] of the positive's, and not above it.

    `is_anchor` is a condition on the columns of `vectors`. Rows with a null id, label,
    vector or component, or one that isn't finite, take no part. Rows that repeat are
    rows of their own: an anchor that is there twice is its own copy's positive, and
    has its results twice. Vectors of different lengths compare over the
    components both have; an empty one scores 0. Scores beyond 64 bits count as the
    largest there are. An empty table, or one without anchors, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(quoted(id_col)).cast("long").alias("id"),
        F.col(quoted(label_col)).cast("long").alias("label"),
        F.col(quoted(vector_col)).cast("array<double>").alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    # Odd numbers mark anchors. Numbers are written once, with their rows, and read from there.
    uid = (F.col("uid") * 2 + F.col("anchor").cast("long")).alias("uid")
    numbers = settle(rows.select(uid, "id", "label", "vec").mapInArrow(_as_rows, _ROWS))
    is_marked = F.col("uid") % 2 == 1
    n, n_anchors, dim = numbers.agg(F.count(F.lit(1)), F.count_if(is_marked), F.max("dim")).collect()[0]
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n_anchors:
        return empty
    most = bucket_rows or min(MOST_BUCKET_ROWS, max(BUCKET_ROWS, n // 64))
    ordered = numbers.repartitionByRange(max(1, math.ceil(n / most)), F.col("len").desc(), "id", "uid")
    ordered = ordered.sortWithinPartitions(F.col("len").desc(), "id", "uid")
    packed = settle(ordered.mapInArrow(_pack_buckets(most), _BUCKET))
    # One number a bucket.
    slots = packed.select("bucket", (F.row_number().over(Window.orderBy("bucket")) - 1).cast("long").alias("slot"))
    buckets = packed.join(slots, "bucket")
    n_buckets = packed.count()

    sample = _sample(numbers, dim or 1)
    n_blocks = max(1, math.ceil(n_anchors * 8 * max(1, dim or 1) / ANCHOR_BYTES))
    block = F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block")
    anchors = numbers.filter(is_marked)
    blocks = anchors.select("*", block).groupBy("block").applyInArrow(_pack_anchors(sample, negatives, positives, None), _BLOCK)
    found = _met(buckets, n_buckets, blocks, n_blocks, _positives_of(positives, focus))
    own = _first(found, ["auid"], positives).groupBy("auid").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("positives")
    )
    with_own = settle(anchors.join(own, F.col("uid") == F.col("auid")).drop("auid"))
    blocks = with_own.select("*", block).groupBy("block").applyInArrow(_pack_anchors(sample, negatives, positives, share), _BLOCK)
    found = _met(buckets, n_buckets, blocks, n_blocks, _negatives_of(negatives, share, focus))
    ranked = _first(found, ["auid", "nth"], negatives)
    return ranked.select(
        F.col("aid").alias("anchor_id"),
        F.col("pid").alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.col("pscore").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


#: Every such id is an anchor; every such id's label moves to the next of ten first.
ANCHORS, MOVED, LABELS = 100, 7, 10


def mined(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the anchors of a table (vec_id, label, embedding)."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    rows = vectors.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(rows, F.col("vec_id") % ANCHORS == 0)


ORACLE_SQL = f"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHORS} = 0),
pos AS (SELECT a, b, s FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank,
  n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM pos p JOIN scored n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 5"""
