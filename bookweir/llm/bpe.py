"""Byte-level BPE: pre-tokens found by scans over codepoint classes, cached pair merging, decoding.

The pattern that splits the text,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

needs no more memory than which kind of pre-token is under way. With the lookahead put into
the symbols (is this the last of a stretch of white space? does a contraction follow this
apostrophe?), every character is a function from state to state. These functions form a
small monoid under composition, so the states of a whole batch come from an associative
scan: composition inside blocks for all blocks side by side, then over the blocks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import partial
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweir.llm import spans
from bookweir.llm.work import begin, map_texts, once, quoted

# Symbols: letter, number, other, apostrophe of a contraction of two or three characters, white
# space with more of it (or the end) to follow, last space, last other white space, end of text.
LETTER, NUMBER, OTHER, SHORT, LONG, MORE, SPACE, BLANK, END = range(9)
# States: nothing open; inside letters, numbers, others; a space that joins what follows; white
# space; one and two more characters of a contraction.
NOTHING, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
_BLOCK = 256
# Pre-tokens whose merges a worker remembers.
CACHE = 200_000
# Widths in which new pre-tokens are merged side by side; longer ones go one by one, by a heap.
SIDE_BY_SIDE = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64)
_NONE = 1 << 40


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at this character."""
    if symbol == LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return NOTHING, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHERS, JOINING):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, SHORT: ONE_MORE, LONG: TWO_MORE}[symbol], True
    if symbol == MORE:
        return IN_BLANKS, state != IN_BLANKS
    return (JOINING if symbol == SPACE else NOTHING), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's function, table of compositions, functions, and starts by state and symbol."""
    steps = [[_step(state, symbol) for state in range(8)] for symbol in range(9)]
    functions = list(dict.fromkeys(tuple(s for s, _ in row) for row in steps))
    numbers = {f: i for i, f in enumerate(functions)}
    symbols = np.array([numbers[tuple(s for s, _ in row)] for row in steps])
    grown = 0
    while grown < len(functions):  # close under composition
        for one, two in [(a, b) for a in functions for b in functions[grown:]] + [
            (b, a) for a in functions for b in functions[grown:]
        ]:
            both = tuple(two[s] for s in one)
            if both not in numbers:
                numbers[both] = len(numbers)
        grown, functions = len(functions), list(numbers)
    compose = np.array([[numbers[tuple(b[s] for s in a)] for b in functions] for a in functions])
    starts = np.array([[row[state][1] for row in steps] for state in range(8)])
    return symbols.astype(np.int32), compose.astype(np.int32), np.array(functions, np.int32), starts


def _classes() -> np.ndarray:
    """Class of every codepoint: letter, number, other or white space (as MORE).

    Which codepoints are letters or numbers changes from one version of Unicode to the next,
    so the tokenizer library is asked once: with a class for a pattern it keeps just that class.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, OTHER, np.uint8)
    for symbol, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (MORE, r"\s")):
        of_class = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        kept = of_class.decode_bytes(of_class.encode_ordinary(every)).decode()
        table[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = symbol
    return table


def _states(symbols: np.ndarray) -> np.ndarray:
    """State before each character, by a scan of function compositions."""
    of_symbol, compose, functions, _ = once("bpe monoid", _monoid)
    n, m = len(symbols), len(compose)
    blocks = max(1, -(-n // _BLOCK))
    each = np.full(blocks * _BLOCK, of_symbol[END], np.int32)
    each[:n] = of_symbol[symbols]
    each = np.ascontiguousarray(each.reshape(blocks, _BLOCK).T)
    flat = compose.ravel()
    for j in range(1, _BLOCK):
        each[j] = flat[each[j - 1] * m + each[j]]
    total = each[-1].copy()
    width = 1
    while width < blocks:
        total[width:] = flat[total[:-width] * m + total[width:]]
        width *= 2
    enter = np.concatenate(([NOTHING], functions[total[:-1], NOTHING]))
    after = functions[each, enter[None, :]].T.reshape(-1)[:n]
    return np.concatenate(([NOTHING], after[:-1]))


def pre_tokens(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The joined bytes, the offset at which each pre-token starts (and the end), and pre-tokens before each text."""
    table = once("bpe classes", _classes)
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # One more character, of class END, after each text.
    ends = np.cumsum(lengths) + np.arange(len(texts))
    inside = np.ones(len(codes) + len(texts), bool)
    inside[ends] = False
    symbols = np.full(len(inside), END, np.uint8)
    symbols[inside] = table[codes]
    chars = np.zeros(len(inside) + 3, np.uint32)
    chars[: len(inside)][inside] = codes
    blank = symbols == MORE
    solid = np.concatenate((~blank[1:] & (symbols[1:] != END), [False]))
    last = np.flatnonzero(blank & solid)
    symbols[last] = np.where(chars[last] == 32, SPACE, BLANK)
    quotes = np.flatnonzero(chars[:-3] == 39)
    one, two = chars[quotes + 1], chars[quotes + 2]
    symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pair = one.astype(np.uint64) << np.uint64(32) | two
    long = [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]
    symbols[quotes[np.isin(pair, np.array(long, np.uint64))]] = LONG
    starts = once("bpe monoid", _monoid)[3]
    marks = starts[_states(symbols), symbols] & inside
    places = np.flatnonzero(marks[inside])
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.concatenate(([0], np.cumsum(width)))
    first = np.searchsorted(places, np.concatenate(([0], np.cumsum(lengths))))
    return joined.encode(), np.append(at[places], at[-1]), first


def load_ranks(path: str) -> dict[bytes, int]:
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


class Merger:
    """Pair merging by rank, with the merges of pre-tokens remembered.

    New pre-tokens of a batch are merged side by side, one pair of each a round. What is
    remembered is kept in two generations: when the younger is full it becomes the older,
    and what is used again moves back.
    """

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.young: dict[bytes, list[int]] = {}
        self.old: dict[bytes, list[int]] = {}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # Every way to put a token together from two: left << 32 | right, and the token.
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)

    def all_ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each of some distinct pre-tokens."""
        found: list = [None] * len(pieces)
        fresh: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            ids = self.young.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    if piece in self.ranks:
                        ids = [self.ranks[piece]]
                    elif len(piece) > SIDE_BY_SIDE[-1]:
                        ids = self._merge(piece)
                    else:
                        fresh.setdefault(next(n for n in SIDE_BY_SIDE if len(piece) <= n), []).append(k)
                        continue
                self._remember(piece, ids)
            found[k] = ids
        for width, places in fresh.items():
            for lo in range(0, len(places), 1 << 15):
                some = places[lo : lo + (1 << 15)]
                for k, ids in zip(some, self._merge_all([pieces[k] for k in some], width)):
                    found[k] = ids
                    self._remember(pieces[k], ids)
        return found

    def _remember(self, piece: bytes, ids: list[int]) -> None:
        if len(piece) <= 256:
            if len(self.young) >= CACHE // 2:
                self.old, self.young = self.young, {}
            self.young[piece] = ids

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two make, _NONE where they make none or one isn't there."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((right >= 0) & (self.pairs[at] == keys), self.merged[at], _NONE)

    def _merge_all(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Merge pieces of at most `width` bytes: in each the pair of lowest rank, the leftmost of equals, a round."""
        if not len(self.pairs):
            return [self._merge(piece) for piece in pieces]
        parts = np.full((len(pieces), width + 1), -1, np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.arange(width + 1) < sizes[:, None]
        parts[inside] = self.bytes[data]
        ranks = self._rank_of(parts[:, :-1], parts[:, 1:])
        # A column behind the last pair, so that every row can be moved up by one.
        ranks = np.concatenate((ranks, np.full((len(pieces), 1), _NONE)), axis=1)
        places, out = np.arange(len(pieces)), [None] * len(pieces)
        columns = np.arange(width + 1)
        while len(places):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(places))
            lowest = ranks[rows, at]
            done = lowest == _NONE
            if done.any():
                ended = parts[done]
                for k, ids, n in zip(places[done].tolist(), ended.tolist(), (ended >= 0).sum(1).tolist()):
                    out[k] = ids[:n]
                going = ~done
                parts, ranks, places, at, lowest = parts[going], ranks[going], places[going], at[going], lowest[going]
                rows = np.arange(len(places))
                if not len(places):
                    break
            parts[rows, at] = lowest
            source = columns + (columns > at[:, None])
            parts = np.take_along_axis(parts, np.minimum(source, width), axis=1)
            parts[:, width] = -1
            source = columns + (columns >= at[:, None])
            ranks = np.take_along_axis(ranks, np.minimum(source, width), axis=1)
            ranks[:, width] = _NONE
            ranks[rows, at] = self._rank_of(parts[rows, at], parts[rows, np.minimum(at + 1, width)])
            left = np.flatnonzero(at)
            ranks[left, at[left] - 1] = self._rank_of(parts[left, at[left] - 1], parts[left, at[left]])
        return out

    def _merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left; a heap finds it in log time."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        start = [*range(-1, n - 1)]  # of the part before
        heap = []

        def offer(left: int) -> None:
            right = end[left]
            if right < n:
                rank = ranks.get(piece[left : end[right]])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, right, end[right]))

        for k in range(n - 1):
            offer(k)
        gone = [False] * n
        while heap:
            _, left, right, stop = heapq.heappop(heap)
            if gone[left] or gone[right] or end[left] != right or end[right] != stop:
                continue
            gone[right] = True
            end[left] = stop
            if stop < n:
                start[stop] = left
            offer(left)
            if start[left] >= 0:
                offer(start[left])
        return [ranks[piece[k : end[k]]] for k in range(n) if not gone[k]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def _pieces(texts: pa.Array, merger: Merger) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each distinct pre-token, the number of every pre-token, their offsets, and those before each text."""
    buffer, at, first = pre_tokens([t or "" for t in texts.to_pylist()])
    data = np.frombuffer(buffer, np.uint8)
    which, number = spans.distinct(spans.span_hashes(data, at[:-1], at[1:]))
    ids = merger.all_ids([buffer[a:b] for a, b in zip(at[which].tolist(), at[which + 1].tolist())])
    return ids, number, at, first


def _merger(path: str) -> Merger:
    return once(f"bpe {path}", partial(Merger, path))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all items of stretches that start at `starts`, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row (struct `row`) and `out`: n_tokens, the ids of its text, the byte offset of each token,
    and decoded_sha256, the digest of what the ids decode to.

    `path` is the rank file. Null text is empty and has no tokens; repeated rows get the
    same ids; a long text is handled like any other; an empty table gives an empty result.
    """

    def work(texts: pa.Array) -> list:
        merger = _merger(path)
        ids, number, at, first = _pieces(texts, merger)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        widths = np.fromiter((len(merger.tokens[i]) for i in flat.tolist()), np.int64, len(flat))
        before = np.cumsum(widths) - widths
        begins = np.cumsum(sizes) - sizes
        own = sizes[number]
        places = _ragged(begins[number], own)
        # Bytes before a token: those before its pre-token, less those before the text, and those inside.
        inside = before[places] - np.repeat(before[begins[number]], own) if len(places) else places
        of_text = np.repeat(at[first[:-1]], np.diff(first))
        starts = np.repeat(at[:-1] - of_text, own) + inside
        ends = np.concatenate(([0], np.cumsum(own)))[first]
        tokens = flat[places]
        back = [merger.decode(x) for x in ids]
        decoded_hash = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            decoded_hash.append(hashlib.sha256(b"".join([back[k] for k in number[lo:hi].tolist()])).hexdigest())
        return [
            pa.array(np.diff(ends)),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens)),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(starts)),
            pa.array(decoded_hash, pa.string()),
        ]

    result = "n_tokens long, ids array<int>, starts array<long>, decoded_sha256 string"
    return map_texts(docs, text_col, result, work, keep, limit=1 << 20, kept="bpe")


def decoded(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column `bytes` in place of the ids, or of one of that name; null ids give null."""
    others = [name for name in docs.columns if name not in (ids_col, "bytes")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(quoted(n)) for n in others]).alias("row")
    inputs = docs.select(row, F.col(quoted(ids_col)).alias("ids"))
    schema = T.StructType([inputs.schema["row"], T.StructField("bytes", T.BinaryType())])

    def run(batches):
        begin("bpe")
        merger = _merger(path)
        for batch in batches:
            texts = [None if ids is None else merger.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["row", "bytes"])

    return inputs.mapInArrow(run, schema).select(*[F.col("row")[n].alias(n) for n in others], "bytes")


def encoding_digests(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row (struct `row`) and `out`: n_tokens, ids_sha256 and decoded_sha256 of its text.

    Encodes, decodes the ids and gives digests of both, without moving the ids. Nulls and
    empty texts have no tokens and the digest of nothing.
    """

    def work(texts: pa.Array) -> list:
        merger = _merger(path)
        ids, number, _, first = _pieces(pc.fill_null(texts, ""), merger)
        said = [" ".join(map(str, x)).encode() for x in ids]
        back = [merger.decode(x) for x in ids]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        before = np.concatenate(([0], np.cumsum(sizes[number]))) if len(number) else np.zeros(1, np.int64)
        counts = before[first[1:]] - before[first[:-1]]
        said_hash, back_hash = [], []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            chosen = number[lo:hi].tolist()
            said_hash.append(hashlib.sha256(b" ".join([said[k] for k in chosen])).hexdigest())
            back_hash.append(hashlib.sha256(b"".join([back[k] for k in chosen])).hexdigest())
        return [pa.array(counts), pa.array(said_hash), pa.array(back_hash)]

    result = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, text_col, result, work, keep, limit=1 << 20, kept="bpe")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256."""
    found = encoding_digests(docs, path, text_col, keep=[id_col])
    return found.select(F.col("row")[id_col].alias(id_col), "out.*")
