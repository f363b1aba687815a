"""Scoring texts by context-tree weighting, beside a unigram base; the work around `ctw`.

One pass over the corpus packs blocks of documents: the distinct grams and words of each block with
their counts in training texts, which words each document has, and the texts themselves. Grams
meet by their two latest context bytes, words by hash: a part gets one entry per block,
however often a word or gram occurs, so frequent ones are no burden. Parts of grams
build the subtrees below them; what they hand up has one number per context byte and node.
With the highest two levels known, each part answers every block with the log-probabilities of
just the grams that the block has, and the block scores its documents by them. No task
and not the driver ever holds the whole model.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweir.llm import ctw, spans
from bookweir.llm.work import begin, bounds, estimated_bytes, quoted, settle, utf8

#: Word entries and bytes of text of a block, about; a longer text is a block of its own.
BLOCK_ENTRIES = 1 << 20
BLOCK_BYTES = 8 << 20
#: Distinct grams a block holds before it sums them.
HELD_GRAMS = 2 << 20
#: Compressed bytes of input per part.
PART_BYTES = 10 << 20
_PACKED = "part long, block long, a binary, b binary, c binary, d binary, x long, y long, e binary, f binary"
_NAMES = ["part", "block", "a", "b", "c", "d", "x", "y", "e", "f"]
_KINDS = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64(), *[pa.binary()] * 2]
_TEXTS = 1  # `y` of the row that holds a block's texts


def _planes(values: np.ndarray, width: int) -> bytes:
    """Integers byte by byte: all lowest bytes, then all second ones; what is regular compresses."""
    return np.ascontiguousarray(np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _whole(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*[r + (None,) * (len(_NAMES) - len(r)) for r in rows])) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _gram_part(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """The part of a gram, by its two latest context bytes."""
    return (spans.mix(keys >> np.uint64(8 * (depth - 1)) << np.uint64(1) | np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The order by part, and the places of each part that is met."""
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(part) else np.zeros(0, np.int64)
    return order, list(zip(ordered[starts].tolist(), np.split(order, starts[1:])))


class _Task:
    """What a task has read and not yet packed into a block."""

    def __init__(self, depth: int, parts: int):
        self.depth, self.parts, self.serial = depth, parts, 0
        self.clear()

    def clear(self) -> None:
        self.one, self.two, self.held_out, self.sizes = [], [], [], []
        self.words, self.times, self.entries = [], [], 0
        self.grams, self.texts, self.lengths, self.bytes = [], [], [], 0

    def add(self, one: np.ndarray, two: np.ndarray, held_out: np.ndarray, texts: pa.Array) -> None:
        data, offsets = utf8(texts)
        data = spans.lower(data)
        self.texts.append(data.tobytes())
        self.lengths.append(np.diff(offsets))
        self.bytes += len(data)
        keys, of = ctw.grams(data, offsets, self.depth)
        for some, weight in ((keys[~held_out[of]], 1), (keys[held_out[of]], 0)):
            ordered = np.sort(some)
            fresh = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(some) else np.zeros(0, np.int64)
            self.grams.append((ordered[fresh], np.diff(fresh, append=len(some)) * weight))
        if len(self.grams) > 2 and sum(len(k) for k, _ in self.grams[1:]) > HELD_GRAMS:
            self.grams = [self.summed_grams()]
        starts, ends, text = spans.word_spans(data, offsets)
        hashes = spans.span_hashes(data, starts, ends) >> np.uint64(8)
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        places = np.flatnonzero(fresh)
        self.words.append(hashes[places])
        self.times.append(np.diff(places, append=len(hashes)))
        self.sizes.append(np.bincount(text[places], minlength=len(texts)))
        for kept, more in ((self.one, one), (self.two, two), (self.held_out, held_out)):
            kept.append(more)
        self.entries += len(places)

    def summed_grams(self) -> tuple[np.ndarray, np.ndarray]:
        return ctw.summed(*(np.concatenate(x) for x in zip(*self.grams)))

    def full(self) -> bool:
        return self.entries >= BLOCK_ENTRIES or self.bytes >= BLOCK_BYTES

    def block(self):
        """The words and lists of the documents gathered so far."""
        if not self.sizes:
            return
        block = (TaskContext.get().partitionId() << 24) + self.serial
        self.serial += 1
        words, times, sizes = np.concatenate(self.words), np.concatenate(self.times), np.concatenate(self.sizes)
        one, two, held_out = np.concatenate(self.one), np.concatenate(self.two), np.concatenate(self.held_out)
        keys, counts = self.summed_grams()
        text, lengths = b"".join(self.texts), np.concatenate(self.lengths)
        self.clear()
        rows = [(-1 - block, block, pa.compress(text, codec="zstd", asbytes=True) if text else b"", _planes(lengths, 5), None, None, 0, _TEXTS)]
        del text
        for p, chosen in _by_part(_gram_part(keys, self.depth, self.parts))[1]:
            rows.append((p, block, _planes(keys[chosen], self.depth + 1), _planes(counts[chosen], 4)))
        del keys, counts
        of = np.repeat(np.arange(len(sizes)), sizes)
        first, number = spans.distinct(words)
        known = words[first]
        train = np.bincount(number, times * ~held_out[of], minlength=len(known)).astype(np.int64)
        # Words are numbered in the order in which the parts will answer.
        part = (known % np.uint64(self.parts)).astype(np.int64)
        order, met = _by_part(part)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for p, chosen in met:
            rows.append((self.parts + p, block, _planes(known[chosen], 7), _planes(train[chosen], 4)))
        listed = place[number]
        by_text = np.lexsort((listed, of))
        listed, times = listed[by_text], times[by_text]
        steps = np.diff(listed, prepend=0)
        starts = np.cumsum(sizes) - sizes
        starts = starts[sizes > 0]
        steps[starts] = listed[starts]
        idents = one.astype(np.int64).tobytes() + two.astype(np.int64).tobytes()
        rows.append((-1 - block, block, idents, _planes(sizes, 4), _planes(steps, 4), _planes(times, 4), int((~held_out).sum()), 0))
        for at in range(0, len(rows), 64):
            yield _packed(rows[at : at + 64])


def _gathered(depth: int, parts: int):
    def run(batches):
        begin()
        task = _Task(depth, parts)
        for batch in batches:
            one, two, held_out = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            texts = pc.fill_null(batch.column(3), "")
            for lo, hi in bounds(pc.binary_length(texts).to_numpy(zero_copy_only=False), 1 << 20):
                task.add(one[lo:hi], two[lo:hi], held_out[lo:hi], texts.slice(lo, hi - lo))
                if task.full():
                    yield from task.block()
        yield from task.block()

    return run


def _met(depth: int, parts: int):
    """What the rows of one part make together."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        out = []
        if part < parts:
            # Read from the table's own memory, and a block's grams twice: a part may be large.
            of_blocks, times = ([x.as_buffer() for x in group.column(name)] for name in ("a", "b"))
            keys, counts = ctw.summed(
                np.concatenate([_whole(x, depth + 1) for x in of_blocks]),
                np.concatenate([_whole(x, 4).astype(np.int64) for x in times]),
            )
            # Where each block's grams are among the part's, as steps; a block has them in the same order.
            asked = b"".join(_planes(np.diff(np.searchsorted(keys, _whole(x, depth + 1)), prepend=0), 4) for x in of_blocks)
            sizes = [len(x) // (depth + 1) for x in of_blocks]
            blocks = np.stack([group.column("block").to_numpy(), sizes], axis=1).astype(np.int64).tobytes()
            found, _ = ctw.levels(keys, counts.astype(float), depth, ctw.PARTED)
            top = found[-1]  # two bytes of context: what they hand up to one byte
            shorter = ctw.drop_oldest(top.keys, ctw.PARTED)
            ones, up = np.unique(shorter, return_inverse=True)
            tops = np.bincount(up, _gram_counts(top))
            nodes, sums = [], []
            for k in range(8):
                number = ctw.numbers(shorter[top.first[k]], k)
                own, at = np.unique(number, return_inverse=True)
                nodes.append(own)
                sums.append(np.bincount(at, top.weighted[k]))
            handed = np.concatenate(nodes).astype(np.int64).tobytes(), np.concatenate(sums).tobytes()
            packed = np.concatenate([ones.astype(np.int64), tops.astype(np.int64)]).tobytes()
            out.append((part, len(keys), _planes(keys, depth + 1), _planes(counts, 6), handed[0], handed[1], None, None, asked, blocks))
            out.append((part, -1, packed, None, None, None, None, None))
        else:
            rows = group.select(["block", "a", "b"]).to_pylist()
            words = [_whole(r["a"], 7) for r in rows]
            counts = np.concatenate([_whole(r["b"], 4).astype(np.int64) for r in rows])
            _, number = spans.distinct(np.concatenate(words))
            total = np.bincount(number, counts).astype(np.int64)
            answer, at = total[number], 0
            for r, own in zip(rows, words):
                out.append((part, r["block"], _planes(answer[at : at + len(own)], 5), None, None, None, None, None))
                at += len(own)
            out.append((part, -2, None, None, None, None, int(np.count_nonzero(total)), int(total.sum())))
        return pa.Table.from_batches([_packed(out)])

    return run


def _gram_counts(level: ctw.Level) -> np.ndarray:
    """Counts of a level's grams: those of the last decision's node, on the side of its bit."""
    node, bit = level.nodes[7], level.bits[7]
    return np.where(bit == 1, level.ones[7][node], level.zeros[7][node])


def _handed_up(batches):
    """Rows (kind, key, value): weighted probabilities handed up to nodes, and counts of grams of one context byte."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] == -1:
                keys, counts = np.split(np.frombuffer(row["a"], np.int64), 2)
                kind, values = 1, counts.astype(float)
            else:
                keys, values, kind = np.frombuffer(row["c"], np.int64), np.frombuffer(row["d"], np.float64), 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind)), pa.array(keys), pa.array(values)], names=["kind", "key", "value"])


def _answered(depth: int, sent):
    """For each block that has grams of a part, the log10 of their chances, mixed up to the root."""

    def run(batches):
        ones, counts, nodes, sums = sent.value
        one, zero = ctw.top_levels(ones.astype(np.uint64), counts, nodes, sums)
        up = np.searchsorted(zero.keys, ctw.drop_oldest(one.keys, 1))
        for batch in batches:
            for row in batch.to_pylist():
                found, places = ctw.levels(_whole(row["a"], depth + 1), _whole(row["b"], 6).astype(float), depth, ctw.PARTED)
                chance = ctw.mixed_chances(found, places)
                shorter = ctw.drop_oldest(found[-1].keys, ctw.PARTED)
                place = np.searchsorted(one.keys, shorter)[places[-1]]
                for level, at in ((one, place), (zero, up[place])):
                    for k in range(8):
                        share = level.share[k][level.nodes[k][at]]
                        chance[k] = share * level.chance(k)[at] + (1 - share) * chance[k]
                logs = np.log10(chance).sum(axis=0).astype(np.float32)
                out, at = [], 0
                for block, n in np.frombuffer(row["f"], np.int64).reshape(-1, 2).tolist():
                    asked = np.cumsum(_whole(row["e"][4 * at : 4 * (at + n)], 4).astype(np.int64))
                    out.append((row["part"], block, logs[asked].tobytes()))
                    at += n
                    if len(out) == 64:
                        yield _packed(out)
                        out = []
                yield _packed(out)

    return run


def _text_logs(texts: dict, answers: list[bytes], depth: int, parts: int) -> np.ndarray:
    """The score of each text of a block, given the parts' answers on its grams in the order of the parts."""
    lengths = _whole(texts["b"], 5).astype(np.int64)
    data = np.frombuffer(pa.decompress(texts["a"], int(lengths.sum()), codec="zstd", asbytes=True) if texts["a"] else b"", np.uint8)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    runs = []
    for lo, hi in bounds(lengths, 1 << 20):
        keys, of = ctw.grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], depth)
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        runs.append((lo, hi, ordered[fresh], (np.cumsum(fresh) - 1).astype(np.int32), of[order].astype(np.int32)))
    keys = np.unique(np.concatenate([own for _, _, own, _, _ in runs]))
    logs = np.empty(len(keys), np.float32)
    logs[_by_part(_gram_part(keys, depth, parts))[0]] = np.concatenate([np.frombuffer(x, np.float32) for x in answers])
    score = np.empty(len(lengths))
    for lo, hi, own, number, of in runs:
        values = logs[np.searchsorted(keys, own)].astype(float)
        score[lo:hi] = np.bincount(of, values[number], minlength=hi - lo)
    return score


def _scored(depth: int, parts: int):
    """Per document of a block: words, known words, the sum of log10(count + 1) and the score."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        texts, listed = sorted(rows[:2], key=lambda r: r["y"] != _TEXTS)
        score = _text_logs(texts, [r["a"] for r in rows[2:] if r["part"] < parts], depth, parts)
        counts = [_whole(r["a"], 5).astype(np.int64) for r in rows[2:] if r["part"] >= parts]
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        one, two = np.split(np.frombuffer(listed["a"], np.int64), 2)
        sizes = _whole(listed["b"], 4).astype(np.int64)
        steps, times = _whole(listed["c"], 4).astype(np.int64), _whole(listed["d"], 4).astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.cumsum(steps)
        starts = np.cumsum(sizes) - sizes
        before = np.concatenate(([0], sums))[starts]
        c = counts[sums - before[of]]
        n = len(sizes)
        return pa.table(
            {
                "one": pa.array(one),
                "two": pa.array(two),
                "n_words": pa.array(np.bincount(of, times, minlength=n).astype(np.int64)),
                "known": pa.array(np.bincount(of, times * (c > 0), minlength=n).astype(np.int64)),
                "logs": pa.array(np.bincount(of, times * np.log10(c + 1.0), minlength=n)),
                "score": pa.array(score),
            }
        )

    return run


def is_held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 when divided by 7 (null id: not)."""
    ident = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    return F.crc32(ident.cast("binary")) % 7 == 2


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = ctw.DEPTH) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows that aren't held out. Both scores are log10 probabilities of the
    text with A-Z in lower case: `base_score` by counts of single words and the end, `score`
    by context-tree weighting of its bytes and the end. Null text is empty and has its end
    alone; repeated rows count each in training and get the same scores; without training
    rows every word is unknown and every decision has the chance of a half; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    ident, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    keyed = docs.select(
        F.xxhash64(ident, text).alias("one"),
        F.xxhash64(F.lit(1), text, ident).alias("two"),
        is_held_out(id_col).alias("held_out"),
        text.alias("text"),
        ident.alias("ident"),
    )
    parts = max(1, math.ceil(estimated_bytes(docs.select(ident, text)) / PART_BYTES))
    packed = settle(keyed.select("one", "two", "held_out", "text").mapInArrow(_gathered(depth, parts), _PACKED))
    met = settle(packed.filter("part >= 0").groupBy("part").applyInArrow(_met(depth, parts), _PACKED))
    grams = met.filter(F.col("part") < parts)
    # Sums per context byte and node: 256 x 256 of either kind at most.
    handed = grams.select("block", "a", "c", "d").mapInArrow(_handed_up, "kind long, key long, value double")
    tops = handed.groupBy("kind", "key").agg(F.sum("value").alias("value")).toPandas().sort_values("key")
    ones, nodes = tops[tops["kind"] == 1], tops[tops["kind"] == 0]
    blocks = packed.filter("part < 0").unionByName(met.filter((F.col("part") >= parts) & (F.col("block") >= 0)))
    if len(ones):
        sent = spark.sparkContext.broadcast([x[name].to_numpy() for x in (ones, nodes) for name in ("key", "value")])
        blocks = blocks.unionByName(grams.filter("block >= 0").select("part", "a", "b", "e", "f").mapInArrow(_answered(depth, sent), _PACKED))
    result = "one long, two long, n_words long, known long, logs double, score double"
    # Rows that repeat one another have one score.
    scored = blocks.groupBy("block").applyInArrow(_scored(depth, parts), result).dropDuplicates(["one", "two"])
    texts = packed.filter("part < 0").agg(F.coalesce(F.sum("x"), F.lit(0)).alias("texts")).collect()[0]["texts"]
    sums = met.agg(
        F.coalesce(F.sum(F.when(F.col("block") == -2, F.col("x"))), F.lit(0)).alias("kinds"),
        F.coalesce(F.sum(F.when(F.col("block") == -2, F.col("y"))), F.lit(0)).alias("words"),
    ).collect()[0]
    n_train, n_kinds = texts + sums["words"], sums["kinds"] + (texts > 0)
    n_tokens = F.col("n_words") + 1
    base = F.col("logs") + math.log10(texts + 1) - n_tokens * math.log10(n_train + n_kinds + 1)
    rows = keyed.select("one", "two", "held_out", F.col("ident").alias(id_col))
    return rows.join(scored, ["one", "two"]).select(
        id_col,
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + int(texts > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
