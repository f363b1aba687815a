"""Near duplicates by exact Jaccard join over word shingles, with token-combination prefixes.

Two documents link when the share of common shingles reaches the threshold. The join runs on
what can matter for it:

1. Documents with equal shingle sets are one class from here on. Inside a task, equal sets
   are put together at once, so a text that a third of all rows share moves once a task.
2. The shingles of all classes meet by hash, packed into one row per task and hash part; a
   part finds out which are in more than one class and in how many. A shingle in one class
   only is never sent on: no pair has it in common. A class whose shared shingles are less
   than the threshold's part of its set has no partner. This runs twice: over all documents,
   then over the classes that are left, where whole copies count once.
3. Shingles are ordered by how many classes hold them, rare ones first. With at most `tau`
   shingles of a set missing in a partner, a prefix of `tau + 1` contains a common one. Rare
   shingles of the prefix are signatures by themselves. Frequent ones are dealt into token
   classes; the prefix is extended until the shingles beyond the first of each token class
   make up for `tau + 1`, so that some token class has two in common, and its pairs are the
   signatures. The number of token classes follows the size of the set, by bands; a document
   uses its own band and the next, which is all that a partner's size allows.
4. In each group of equal signatures one class, the same in most groups, is compared with all
   others and then leaves the group; what links is one component. After some such rounds only
   members of different components that are left in a group have to be compared, and all are.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweir.llm import spans
from bookweir.llm.work import begin, bounds, estimated_bytes, quoted, settle, utf8

#: Words of a shingle, and the threshold as a fraction: 100 * common >= 75 * all.
SHINGLE = 5
NUMERATOR, DENOMINATOR = 3, 4
#: A shingle in so many classes is frequent; a token class has so many shingles of a set on average.
FREQUENT = 32
TOKENS_PER_CLASS = 16
#: Rounds of comparisons with one class per group, before the exact rest.
ROUNDS = 3
#: Shingles of a block (what a task packs at once) and, on average, of a hash part.
BLOCK_TOKENS = 1 << 20
PART_TOKENS = 3 << 19
# Compressed bytes of input that one shingle takes, about; decides the number of parts only.
BYTES_PER_TOKEN = 3
_TOKEN = np.uint64((1 << 48) - 1)
_BAND = math.log(1.34)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a batch (48-bit hashes, sorted within a text), and the text of each.

    A text of fewer words has its whole sequence as one. At most 65,536 texts.
    """
    data, offsets = utf8(texts)
    data = spans.lower(data)
    starts, ends, text = spans.word_spans(data, offsets)
    hashes = spans.span_hashes(data, starts, ends)
    places, keys = spans.windows(hashes, text, size)
    found_text, found = [text[places]], [keys]
    n_words = np.bincount(text, minlength=len(texts))
    for few in range(1, size):
        some = n_words[text] == few
        if some.any():
            places, keys = spans.windows(hashes[some], text[some], few)
            found_text.append(text[some][places])
            found.append(spans.mix(keys + np.uint64(few)))
    text, keys = np.concatenate(found_text).astype(np.uint64), np.concatenate(found)
    both = np.sort(text << np.uint64(48) | (keys & _TOKEN))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both & _TOKEN, (both >> np.uint64(48)).astype(np.int64)


def _prints(tokens: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets and two 64-bit fingerprints of each, which don't depend on order."""
    sizes = np.bincount(text, minlength=n)
    ends = np.cumsum(sizes)
    prints = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spans.mix(tokens + salt), dtype=np.uint64)))
        prints.append(spans.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)))
    return sizes, prints[0], prints[1]


def _thin(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    kind = np.uint8 if not len(values) or values.max() < 256 else np.uint16 if values.max() < 65536 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _full(data: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]]
    return np.frombuffer(data, kind, offset=1).astype(np.int64)


def _six(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens, np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


# One row per block and hash part: which set each shingle is of (as differences), the shingles,
# in how many sets each is. Part -1 - x is the block's directory: ids, sizes, fingerprints.
_PACKED = "part long, block long, a binary, b binary, c binary, d binary"
_NAMES = ["part", "block", "a", "b", "c", "d"]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=_NAMES)


class _Block:
    """Sets of shingles gathered by a task until they are packed."""

    def __init__(self, parts: int):
        self.parts, self.serial = parts, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.known, self.sizes, self.one, self.two = [], [], [], [], []
        self.tokens, self.of, self.n, self.held = [], [], 0, 0

    def add(self, ids: np.ndarray, known: np.ndarray, tokens: np.ndarray, text: np.ndarray) -> None:
        sizes, one, two = _prints(tokens, text, len(ids))
        for kept, more in ((self.ids, ids), (self.known, known), (self.sizes, sizes), (self.one, one), (self.two, two)):
            kept.append(more)
        self.tokens.append(tokens)
        self.of.append(text + self.n)
        self.n += len(ids)
        self.held += len(tokens)

    def pack(self):
        if not self.n:
            return
        block = (TaskContext.get().partitionId() << 24) + self.serial
        ids, known, sizes, one, two = (np.concatenate(x) for x in (self.ids, self.known, self.sizes, self.one, self.two))
        tokens, of = np.concatenate(self.tokens), np.concatenate(self.of)
        self.serial += 1
        self.clear()
        # Of equal sets the first one speaks for all.
        _, first = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True)
        speaks = np.zeros(len(ids), bool)
        speaks[first] = True
        chosen = speaks[of]
        tokens, of = tokens[chosen], of[chosen]
        part = (tokens % np.uint64(self.parts)).astype(np.uint16 if self.parts <= 65536 else np.uint32)
        order = np.argsort(part, kind="stable")
        tokens, of = tokens[order], of[order]
        ends = np.cumsum(np.bincount(part, minlength=self.parts))
        rows, lo = [], 0
        for p, hi in enumerate(ends.tolist()):
            if hi > lo:
                rows.append((p, block, _thin(np.diff(of[lo:hi], prepend=0)), _six(tokens[lo:hi]), None, None))
            lo = hi
        directory = ids.astype(np.int64).tobytes(), np.packbits(known).tobytes(), sizes.astype(np.int64).tobytes()
        rows.append((-1 - block, block, *directory, one.tobytes() + two.tobytes() + np.packbits(speaks).tobytes()))
        for at in range(0, len(rows), 64):
            yield _packed(rows[at : at + 64])


def _from_texts(parts: int, size: int):
    def run(batches):
        begin()
        block = _Block(parts)
        for batch in batches:
            idents, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            known = pc.is_valid(idents).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(idents, 0).to_numpy(zero_copy_only=False)
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for first, last in bounds(lengths, 1 << 20):
                for lo in range(first, last, 65_536):
                    hi = min(last, lo + 65_536)
                    block.add(ids[lo:hi], known[lo:hi], *shingles(texts.slice(lo, hi - lo), size))
                    if block.held >= BLOCK_TOKENS:
                        yield from block.pack()
        yield from block.pack()

    return run


def _from_sets(parts: int):
    def run(batches):
        begin()
        block = _Block(parts)
        for batch in batches:
            for ident, n, tokens in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = np.frombuffer(tokens, np.uint64)
                block.add(np.array([ident]), np.ones(1, bool), own, np.zeros(len(own), np.int64))
                # Shingles that no one shares were left behind: size and class stay what they were.
                block.sizes[-1] = np.array([n])
                block.one[-1] = block.two[-1] = np.array([ident]).view(np.uint64)
                if block.held >= BLOCK_TOKENS:
                    yield from block.pack()
        yield from block.pack()

    return run


def _share(group: pa.Table) -> pa.Table:
    """Of a hash part: for each block, the shingles that more than one set has, and how many have them."""
    if group.column("part")[0].as_py() < 0:
        return group
    rows = group.select(["part", "block", "a", "b"]).to_pylist()
    tokens = [_eight(r["b"]) for r in rows]
    every = np.concatenate(tokens)
    _, number = spans.distinct(every)
    count = np.bincount(number)[number]
    out, at = [], 0
    for r, own in zip(rows, tokens):
        n = count[at : at + len(own)]
        at += len(own)
        shared = n > 1
        if shared.any():
            of = np.cumsum(_full(r["a"]))[shared]
            out.append((r["part"], r["block"], _thin(np.diff(of, prepend=0)), _six(own[shared]), _thin(n[shared]), None))
    return pa.Table.from_batches([_packed(out)])


_SETS = "id long, one long, n long, tokens binary, counts binary"


def _gather(group: pa.Table) -> pa.Table:
    """Of a block: the sets that share enough of their shingles to have a partner, with these."""
    rows = group.to_pylist()
    directory = next(r for r in rows if r["part"] < 0)
    ids, sizes = np.frombuffer(directory["a"], np.int64), np.frombuffer(directory["c"], np.int64)
    one = np.frombuffer(directory["d"], np.int64, count=len(ids))
    rows = [r for r in rows if r["part"] >= 0]
    of = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(_full(r["a"])) for r in rows]])
    tokens = np.concatenate([np.zeros(0, np.uint64), *[_eight(r["b"]) for r in rows]])
    counts = np.concatenate([np.zeros(0, np.int64), *[_full(r["c"]) for r in rows]])
    shared = np.bincount(of, minlength=len(ids))
    enough = (shared * DENOMINATOR >= sizes * NUMERATOR) & (shared > 0)
    chosen = enough[of]
    of, tokens, counts = of[chosen], tokens[chosen], counts[chosen]
    order = np.argsort(of, kind="stable")
    of, tokens, counts = of[order], tokens[order], counts[order]
    which = np.flatnonzero(enough)
    ends = np.searchsorted(of, which, side="right")
    begins = np.searchsorted(of, which, side="left")
    spots = list(zip(begins.tolist(), ends.tolist()))
    return pa.table(
        {
            "id": pa.array(ids[which], pa.int64()),
            "one": pa.array(one[which], pa.int64()),
            "n": pa.array(sizes[which], pa.int64()),
            "tokens": pa.array([tokens[a:b].tobytes() for a, b in spots], pa.binary()),
            "counts": pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in spots], pa.binary()),
        }
    )


def _members(batches):
    """The directories' entries: id, class (first fingerprint) and size of each set."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["a"], np.int64)
            known = np.unpackbits(np.frombuffer(row["b"], np.uint8), count=len(ids)).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=~known),
                    pa.array(np.frombuffer(row["d"], np.int64, count=len(ids))),
                    pa.array(np.frombuffer(row["c"], np.int64)),
                ],
                names=["id", "class", "n"],
            )


def _shared(packed: DataFrame) -> DataFrame:
    """The packed rows with only the shingles that several sets share, on disk, as two steps start from it."""
    return settle(packed.groupBy("part").applyInArrow(_share, _PACKED))


_SIGNED = "sig long, class long, n long, alone long, level long"


def _signatures(batches):
    """Rows (sig, class, n, shingles that no one shares, level) of each set."""
    for batch in batches:
        sigs, levels, owners, sizes, alone = [], [], [], [], []
        for ident, n, tokens, counts in zip(*(batch.column(k).to_pylist() for k in ("id", "n", "tokens", "counts"))):
            tokens, counts = np.frombuffer(tokens, np.uint64), np.frombuffer(counts, np.uint32)
            own, level = signatures(n, tokens, counts)
            sigs.append(own)
            levels.append(level)
            owners.append(np.full(len(own), ident))
            sizes.append(np.full(len(own), n))
            alone.append(np.full(len(own), n - len(tokens)))
        if sigs:
            columns = [np.concatenate(sigs).view(np.int64), *(np.concatenate(x) for x in (owners, sizes, alone, levels))]
            names = ["sig", "class", "n", "alone", "level"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def band(n: int) -> int:
    return int(math.log(n) / _BAND)


def token_classes(scheme: int) -> int:
    return max(1, int(math.exp(scheme * _BAND)) // TOKENS_PER_CLASS)


def signatures(
    n: int, tokens: np.ndarray, counts: np.ndarray, frequent: int = FREQUENT
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of n shingles, of which `tokens` are in `counts` sets each and the others in no other set.

    The level of a signature says for which partners it is needed: a partner that may lack
    `tau` shingles of the set has one of a level of `tau + 1` at most in common.
    """
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    # Shingles that no one shares come first. Of n shingles a partner may lack n - ceil(3n/4).
    alone = n - len(tokens)
    most = n - -(-n * NUMERATOR // DENOMINATOR) + 1
    if alone >= most:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n_rare = int(np.searchsorted(counts, frequent))
    single = min(most - alone, n_rare)
    found, levels = [spans.mix(tokens[:single])], [alone + 1 + np.arange(single)]
    if alone + n_rare < most:
        often = tokens[n_rare:]
        spread = spans.mix(often + np.uint64(11))
        for scheme in (band(n), band(n) + 1):
            kind = (spread % np.uint64(token_classes(scheme))).astype(np.int64)
            first = np.zeros(len(often), bool)
            first[np.unique(kind, return_index=True)[1]] = True
            reached = alone + n_rare + np.cumsum(~first)
            upto = int(np.searchsorted(reached, most)) + 1
            inside, kind_in, reached = often[:upto], kind[:upto], reached[:upto]
            by_kind = np.lexsort((inside, kind_in))
            inside, kind_in, reached = inside[by_kind], kind_in[by_kind], reached[by_kind]
            cuts = np.flatnonzero(np.diff(kind_in, prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo > 1:
                    a, b = np.array(list(itertools.combinations(range(lo, hi), 2))).T
                    found.append(spans.mix(spans.mix(inside[a]) * np.uint64(3) + inside[b] + np.uint64(scheme + 1)))
                    levels.append(np.maximum(reached[a], reached[b]))
    return np.concatenate(found), np.concatenate(levels)


def _similar(batches):
    """The pairs whose sets reach the threshold."""
    for batch in batches:
        a, b, n_a, n_b, t_a, t_b = (batch.column(k) for k in ("a", "b", "n_a", "n_b", "t_a", "t_b"))
        keep = []
        for na, nb, ta, tb in zip(n_a.to_pylist(), n_b.to_pylist(), t_a, t_b):
            x, y = np.frombuffer(ta.as_buffer(), np.uint64), np.frombuffer(tb.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((x, y)))
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(common * DENOMINATOR >= (na + nb - common) * NUMERATOR)
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_similar, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Columns id and component (smallest id reachable) of every id that has a link (a, b).

    Every node hooks on to its smallest neighbour and the graph is contracted, until no
    link is left; each round is written to the shared folder.
    """
    edges = settle(links.select("a", "b").filter("a != b").distinct())
    both = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    found = both.withColumn("component", F.col("id"))
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        hooks = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        hooks = settle(hooks)
        found = settle(
            found.join(hooks, found["component"] == hooks["a"], "left").select("id", F.coalesce("to", "component").alias("component"))
        )
        one = hooks.select(F.col("a"), F.col("to").alias("x"))
        two = hooks.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = settle(
            edges.join(one, "a").join(two, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    return found


def _may_link() -> Column:
    """Whether a signature that two sets (n, level) and (m, other) have in common can be the one that a link needs.

    A link of sets of n and m shingles has 3(n + m)/7 in common, so `tau` of either is what is above that.
    """
    common = F.ceil((F.col("n") + F.col("m")) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    return (F.col("level") <= F.col("n") - common + 1) & (F.col("other") <= F.col("m") - common + 1)


def _groups(sets: DataFrame) -> DataFrame:
    """Rows (sig, class, n, alone, level) of the groups of two or more; groups of the same members are one."""
    rows = sets.mapInArrow(_signatures, _SIGNED)
    groups = rows.groupBy("sig").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y")
    )
    groups = groups.filter("size > 1").select("sig", F.xxhash64("size", "x", "y").alias("members"))
    joined = rows.join(groups, "sig").groupBy("members", "class")
    merged = joined.agg(F.min("n").alias("n"), F.min("alone").alias("alone"), F.min("level").alias("level"))
    return merged.withColumnRenamed("members", "sig")


def linked_classes(sets: DataFrame) -> DataFrame:
    """Columns id and component of the classes that link, from the sets (id, n, tokens, counts)."""
    groups = settle(_groups(sets))
    found, links = groups.select(F.col("class").alias("id")).limit(0).withColumn("component", F.col("id")), None

    for turn in range(ROUNDS + 1):
        # Only groups that hold more than one component go on.
        joined = groups.join(found.withColumnRenamed("id", "class"), "class", "left")
        joined = joined.withColumn("component", F.coalesce("component", "class"))
        several = joined.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
        left = settle(joined.join(several.select("sig"), "sig"))
        if left.isEmpty():
            break
        one = [F.col("class").alias("c"), F.col("n").alias("m"), F.col("level").alias("other"), F.col("component").alias("k")]
        if turn < ROUNDS:
            # Every group compares the member that has least of its own, mostly the same for all groups of a
            # cluster, with all others, and is done with it.
            centre = F.min(F.struct("alone", F.xxhash64("class").alias("h"), *one)).alias("x")
            centres = settle(left.groupBy("sig").agg(centre).select("sig", "x.c", "x.m", "x.other", "x.k"))
            pairs = left.join(centres, "sig").filter(F.col("component") != F.col("k"))
            spent = centres.select("sig", F.col("c").alias("class"))
            groups = left.drop("component").join(spent, ["sig", "class"], "left_anti")
        else:
            pairs = left.join(left.select("sig", *one), "sig").filter(F.col("component") < F.col("k"))
        pairs = pairs.filter(_may_link()).select(F.least("class", "c").alias("a"), F.greatest("class", "c").alias("b"))
        fresh = settle(verified(pairs.distinct(), sets))
        if not fresh.isEmpty():
            links = fresh if links is None else links.union(fresh)
            found = components(links)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id reachable by links.

    Words are runs without ASCII white space, A-Z in lower case; a document's set has its
    distinct shingles, or its whole sequence if it has fewer words. Documents without words
    (null, empty or blank text) have an empty set and link with nothing. Equal sets always
    link. A null id is never the smallest; repeated rows are documents of their own with
    equal sets. An empty table gives an empty result.
    """
    inputs = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    expected = estimated_bytes(inputs) / BYTES_PER_TOKEN
    parts = max(1, math.ceil(expected / PART_TOKENS))
    shared = _shared(inputs.mapInArrow(_from_texts(parts, size), _PACKED))
    members = settle(shared.filter("part < 0").select("a", "b", "c", "d").mapInArrow(_members, "id long, class long, n long"))
    # A block's rows are what its own documents share: no more than a task packed.
    sets = shared.groupBy("block").applyInArrow(_gather, _SETS)
    classes = settle(sets.select(F.col("one").alias("id"), "n", "tokens").dropDuplicates(["id"]))
    again = _shared(classes.mapInArrow(_from_sets(parts), _PACKED))
    sets = settle(again.groupBy("block").applyInArrow(_gather, _SETS).select("id", "n", "tokens", "counts"))
    linked = linked_classes(sets)
    firsts = members.groupBy("class").agg(F.min("id").alias("first"))
    labelled = firsts.join(linked.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = labelled.join(lowest, "component").select("class", "component_id")
    joined = members.join(of_class, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component, that of the smallest id, with the columns as they were.

    Documents without words stay, and so do rows without an id, which can't be told apart;
    rows that repeat the id that stays, stay with it (exact duplicates go before this).
    """
    found = settle(near_duplicates(docs, id_col, text_col))
    kept = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("kept")).distinct()
    ident = F.col(quoted(id_col)).cast("long")
    rows = docs.select(F.struct(*[F.col(quoted(name)) for name in docs.columns]).alias("row"), ident.alias("ident"))
    with_id = rows.join(kept, F.col("ident") == F.col("kept"), "left_semi").select(
        *[F.col("row")[name].alias(name) for name in docs.columns]
    )
    without = docs.filter(ident.isNull())
    return with_id.unionByName(without)
