"""Hard negatives against plain loops over all pairs of an anchor and a row."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookweir.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def expected(rows: list[tuple]) -> collections.Counter:
    whole = []
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        whole.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in vec]))
    out = collections.Counter()
    for k, (anchor, label, vec) in enumerate(whole):
        if anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(vec, v)), i, y) for j, (i, y, v) in enumerate(whole) if j != k]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for top, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * top <= 100 * s[0] <= 100 * top]
            for rank, (score, i, _) in enumerate(fits[:5], 1):
                out[anchor, positive, rank, i, top, score] += 1
    return out


def _rows(seed: int, n: int, dim: int, spread: float) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    hot = [round(x, 2) for x in centres[0]]
    rows = []
    for k in range(n):
        length = math.exp(rng.gauss(0, spread))
        vec = hot if rng.random() < 0.3 else [length * (c + rng.gauss(0, 0.4)) for c in rng.choice(centres)]
        rows.append((k, rng.choice([None, 0, 1, 2, 2, 2, 9]), vec))
    odd = [
        (100 * n, 2, None),
        (100 * n + 100, 2, [None] + hot[1:]),
        (100 * n + 200, 2, [math.nan] + hot[1:]),
        (100 * n + 300, 2, [math.inf] + hot[1:]),
        (None, 2, hot),
        (100 * n + 400, 2, []),
        (100 * n + 500, 2, hot[:1]),
        (100 * n + 600, 2, [0.0] * dim),
        (n + 1, 1, [*hot, 1.0]),
    ]
    return rows + odd + rows[:3] + rows[100:103]


def _frame(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("uid", "id", "score", "bucket", "slot", "block", "anchor", "vec", "rank", "n"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame.repartition(3)


@pytest.mark.parametrize(("n", "dim", "spread", "bucket_rows"), [(420, 6, 0.0, 64), (420, 3, 1.0, 40), (250, 16, 0.5, None)])
def test_negatives_equal_plain_loops(spark, monkeypatch, n, dim, spread, bucket_rows):
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 3 * 8 * dim)  # several blocks of anchors
    monkeypatch.setattr(negatives, "BUCKET_ROWS", bucket_rows or negatives.BUCKET_ROWS)
    rows = _rows(n + dim, n, dim, spread)
    found = negatives.mined(_frame(spark, rows))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = collections.Counter(map(tuple, found.collect()))
    assert got == expected(rows) and got


def test_scores_too_large_for_floats(spark):
    rng = random.Random(5)
    rows = [(k, k % 2, [rng.uniform(-1, 1) * 2.0**20 for _ in range(4)]) for k in range(0, 300, 3)]
    assert collections.Counter(map(tuple, negatives.mined(_frame(spark, rows)).collect())) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, 2, [0.5])], [(100, 2, [0.5])], [(100, 2, [0.5]), (101, 2, [0.5])]])
def test_nothing_to_mine(spark, rows):
    assert negatives.mined(_frame(spark, rows)).collect() == []


def test_ranges_lose_no_candidate():
    rng = np.random.default_rng(1)
    vectors = negatives.quantised(rng.normal(size=(500, 8)))
    lists = np.argsort(negatives._directions(vectors), axis=0, kind="stable").T.astype("<u2")
    wide, data = negatives._packed(vectors)
    ids = np.arange(500, dtype="<i8").tobytes()
    longest = float(np.sqrt((vectors**2).sum(1)).max())
    row = {"n": 500, "dim": 8, "longest": longest, "wide": wide, "uids": ids, "ids": ids, "labels": ids, "vecs": data}
    bucket = negatives.Bucket(row | {"lists": np.ascontiguousarray(lists).tobytes()})
    pruned = 0
    for anchor in negatives.quantised(rng.normal(size=(40, 8))):
        exact = vectors @ anchor
        for least in np.quantile(exact, [0.5, 0.9, 0.99, 1.0]):
            found = bucket.candidates(anchor, float(least), 8)
            missing = np.flatnonzero(exact >= least) if found is None else np.setdiff1d(np.flatnonzero(exact >= least), found)
            assert found is None or not len(missing)
            pruned += 0 if found is None else 500 - len(found)
    assert pruned > 1000  # and they do cut
