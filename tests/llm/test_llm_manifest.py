"""The Merkle manifest against a tree built by plain loops."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bookweir.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return levels


def _steps(levels: list[list[str]], i: int):
    for nodes in levels[:-1]:
        first = i // 16 * 16
        yield nodes[first : first + 16], i - first
        i //= 16


def expected(rows: list[tuple]) -> collections.Counter:
    by_source = collections.defaultdict(list)
    for i, source, lang, n, text in rows:
        leaf = _h(*map(_field, (i, source, lang, n, text)))
        altered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by_source[source].append((i is not None, i or 0, leaf, _h(*map(_field, (i, source, lang, n, _lower(text)))) if altered else leaf, i))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(by_source[s])]) for s in sources}
    top = _levels([trees[s][-1][0] for s in sources]) if sources else []
    out = collections.Counter()
    for k, s in enumerate(sources):
        for at, (_, _, leaf, start, i) in enumerate(sorted(by_source[s])):
            said, folded = [], start
            for run, place in [*_steps(trees[s], at), *_steps(top, k)]:
                said += run[:place] + run[place + 1 :]
                folded = _h(*run[:place], folded, *run[place + 1 :])
            out[i, leaf, trees[s][-1][0], top[-1][0], _h(*said), folded, folded == top[-1][0]] += 1
    return out


def _rows(seed: int, n: int, n_sources: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice([None, "", *[f"s{j}" for j in range(n_sources)]])
        text = rng.choice([None, "", "Plain Text", "small letters", "É long " + "x" * rng.randrange(50), "Z" * 5000])
        rows.append((rng.choice([k, k, k, k % 7, None]), source, rng.choice([None, "en", ""]), rng.choice([None, 0, k]), text))
    return [*rows, *rows[:5], (10**12, "alone in its source", None, None, "One Row"), (-5, "hot", "en", 1, "A")]


def _frame(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "leaf", "rank", "n", "part", "at", "hash", "kids", "block", "root", "all", "d0", "path", "x"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame.repartition(4)


@pytest.mark.parametrize(("digits", "n", "n_sources"), [(1, 700, 40), (2, 300, 3), (3, 60, 300)])
def test_manifest_equals_plain_loops(spark, monkeypatch, digits, n, n_sources):
    monkeypatch.setattr(merkle, "PART_LEAVES", 50)  # the hot source spans several parts
    rows = _rows(digits, n, n_sources)
    found = merkle.manifest(_frame(spark, rows), digits=digits)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert collections.Counter(map(tuple, found.collect())) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a", "en", 1, "A")] * 3, [(5, "a", "en", 1, None), (6, "b", "en", 1, "Ü")]])
def test_small_manifests(spark, rows):
    found = merkle.manifest(_frame(spark, rows))
    assert collections.Counter(map(tuple, found.collect())) == expected(rows)


def test_tampering_shows_only_where_letters_change(spark):
    rows = [(k, "s", "en", 1, "UPPER" if k % 2 else "lower") for k in range(200)]
    got = {r.doc_id: r.verified for r in merkle.manifest(_frame(spark, rows)).collect()}
    assert got == {k: not (k % 2 and zlib.crc32(str(k).encode()) % 5 == 0) for k in range(200)}


def test_leaves_are_never_joined_to_leaves(spark):
    """The hashes of texts go through one exchange by block; texts through none."""
    plan = merkle.leaves(_frame(spark, _rows(9, 20, 2)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
