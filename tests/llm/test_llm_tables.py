"""Exact dedup, quality rules, mixing and near duplicates against plain loops."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookweir.llm import dedup, mixing, near, quality
from tests.llm import brute

EMPTY = "doc_id long, text string, lang string, source string"


def _copies(seed: int, n: int = 300) -> list[tuple]:
    """Texts with nulls, empties, copies of a third of all rows, case variants and common openings."""
    rng = random.Random(seed)
    base = ["Same opening of many texts, long enough to fill the key. " + str(k % 7) for k in range(20)]
    rows = []
    for k in range(n):
        text = rng.choice([None, "", "Hot text", "hot TEXT", "Hot text", rng.choice(base), rng.choice(base).upper(), "É " + str(k), "é " + str(k % 5)])
        rows.append((k, text))
    return [*rows, (n, "x" * 200_000), (n + 1, "X" * 200_000), (None, "Hot text"), (3, rows[3][1])]


def _frame(spark, rows):
    """With columns whose names clash with those of the operators."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "out", "kept", "size", "sha", "shard", "taken", "part", "run", "key", "_ident", "_kept"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame.repartition(5)


def test_groups_of_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART_BYTES", 20_000)  # the hot text is in several partitions
    rows = _copies(1)
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[brute.lowered(text)].append(i)
    got = dedup.exact_groups(_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    import hashlib

    by_hash = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    seen = collections.Counter()
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        seen[r.text_sha256] += r.kept
    assert set(seen.values()) == {1}


def test_dropping_copies_keeps_the_columns(spark):
    frame = _frame(spark, _copies(2, 60))
    kept = dedup.drop_copies(frame)
    assert kept.columns == frame.columns
    texts = [brute.lowered(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({brute.lowered(t) for _, t in _copies(2, 60)})


def test_quality_figures(spark):
    rng = random.Random(5)
    pieces = ["word", "é", "#", "***", "\n", " ", "\t", "a b c", "<p>", "line one\n", "  \n", "x" * 50, "\r", "ALL CAPS"]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randint(0, 120)))) for k in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "a b c " * 30_000), (1003, "q" * 100_000), (5, rows[5][1])]
    got = quality.verdicts(_frame(spark, rows)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = brute.quality_figures(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert not (r.base_failed and r.kept)


def test_order_of_the_rules_changes_no_verdict(spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    batch = pa.array(texts, pa.string())
    base = quality.figures(batch)
    one = quality.cascade(batch, base, quality.RULES)
    two = quality.cascade(batch, base, quality.RULES[::-1])
    assert one.tolist() == two.tolist() and 0 < one.sum() < len(one)


def test_rules_keep_good_documents_and_drop_bad_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.verdicts(docs).join(labels, "doc_id").filter("NOT base_failed")
    right = found.filter("kept = (quality = 1)").count()
    assert right >= 0.98 * found.count()


def _sources(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for k in range(600):
        source = rng.choice(["hot"] * 6 + ["b", "c", "é", None, "tiny"] if k > 3 else ["none"])
        n = 0 if source == "none" else rng.choice([0, 1, 5, 40, 200, 900])
        rows.append((k, None if n == 0 and k % 2 else "w " * n, source))
    return rows


def _mixed(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("s", F.lit(1)).withColumn("block", F.lit(2))
    return {r.doc_id: r for r in mixing.mix_shares(frame, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"block_words": 500, "shard_blocks": 7}])
def test_mix_comes_near_its_targets(spark, options):
    rows = _sources(3)
    got = _mixed(spark, rows, **options)
    sizes = collections.Counter()
    for i, text, source in rows:
        sizes[source] += len(brute.words(text))
        assert got[i].size == len(brute.words(text)) and got[i].taken in (0, got[i].size, 2 * got[i].size)
    want = brute.targets(sizes)
    taken = collections.Counter()
    for i, _, source in rows:
        assert got[i].source_size == sizes[source] and abs(got[i].target - want[source]) < 1e-6 * (want[source] + 1)
        taken[source] += got[i].taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 100
    assert got == _mixed(spark, rows, **options)


def test_splitting_tree_hands_out_every_draw(spark):
    counts = [700, 0, 33, 1]
    root = spark.range(1).select(F.array(*[F.lit(n).cast("long") for n in counts]).alias("counts"))
    rows = mixing.splitting_tree(root, 11).orderBy("shard").collect()
    assert [r.shard for r in rows] == list(range(11))
    assert [sum(c) for c in zip(*[r.counts for r in rows])] == counts
    sizes = [sum(r.counts) for r in rows]
    assert max(sizes) - min(sizes) <= 1


def test_mixed_rows_repeat_as_often_as_taken(spark):
    rows = _sources(4)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = collections.Counter(r.doc_id for r in mixing.mixed(frame).collect())
    got = _mixed(spark, rows)
    assert all(times[i] * r.size == r.taken for i, r in got.items())


def _near(seed: int, n: int) -> dict:
    """Clusters of near copies, chains of them, a hot group, shared passages and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    originals = [rng.choices(vocabulary, k=rng.choice([5, 8, 30, 80, 200])) for _ in range(12)]
    texts = {}
    for k in range(n):
        kind = rng.random()
        words = list(rng.choice(originals[:3] if kind < 0.4 else originals))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if kind > 0.9:
            words = words[: rng.randint(0, 6)]
        text = " ".join(words)
        texts[k] = f"{passage} {text}" if kind > 0.7 and rng.random() < 0.5 else text.upper() if kind < 0.05 else text
    return texts | {n: None, n + 1: "", n + 2: " \n ", n + 3: passage * 100, n + 4: passage * 100}


@pytest.mark.parametrize("frequent", [3, near.FREQUENT])
def test_near_duplicates(spark, monkeypatch, frequent):
    monkeypatch.setattr(near.signatures, "__defaults__", (frequent,))
    monkeypatch.setattr(near, "BLOCK_TOKENS", 3_000)
    monkeypatch.setattr(near, "PART_TOKENS", 2_000)
    texts = _near(frequent, 400)
    got = near.near_duplicates(_frame(spark, list(texts.items()))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(texts)


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"a{k}" for k in range(30))
    rows = [(7, long), (7, long), (None, long), (9, long + " more"), (None, None), (None, "one two")]
    got = near.near_duplicates(_frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [
        (-1, 0, -1), (-1, 1, -1), (-1, 26, 7), (7, 26, 7), (7, 26, 7), (9, 27, 7),
    ]


def test_links_share_a_signature():
    """Whatever the order of shingles by frequency: sets that reach the threshold have a signature in common."""
    import numpy as np

    rng = random.Random(8)
    for _ in range(600):
        n = rng.randint(3, 120)
        universe = [rng.getrandbits(48) for _ in range(2 * n)]
        counts = {t: rng.choice([2, 3, 50, 90]) for t in universe}
        x = set(universe[:n])
        y = set(x)
        for t in rng.sample(sorted(x), rng.randint(0, n // 5)):
            y.discard(t)
        y |= set(universe[n : n + rng.randint(0, n // 5)])
        if 4 * len(x & y) >= 3 * len(x | y):
            common = -(-3 * (len(x) + len(y)) // 7)
            needed = []
            for s in (x, y):
                sigs, levels = near.signatures(len(s), np.array(sorted(s), np.uint64), np.array([counts[t] for t in sorted(s)]))
                needed.append(set(sigs[levels <= len(s) - common + 1].tolist()))
            assert needed[0] & needed[1], (len(x), len(y))


def test_one_of_each_component_stays(spark):
    texts = _near(11, 120)
    frame = _frame(spark, list(texts.items()))
    kept = near.one_of_each(frame)
    assert kept.columns == frame.columns
    want = {c for _, c in brute.near_components(texts).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], EMPTY)
    assert dedup.exact_groups(empty).collect() == []
    assert quality.verdicts(empty).collect() == []
    assert mixing.mix_shares(empty).collect() == []
    assert near.near_duplicates(empty).collect() == []


def test_a_join_asks_for_no_more_parts_than_its_sides(spark):
    from bookweir.llm.work import estimated_bytes, parts_for
    from bookweir.sources.tables import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    joined = docs.join(docs.select("doc_id"), "doc_id")
    assert estimated_bytes(joined) <= 2 * estimated_bytes(docs)
    assert parts_for(joined) <= 2 * parts_for(docs)
