"""Token counts of documents of any length, by overlapping chunks spliced where both agree.

A text of more than a chunk is encoded by the tokenizer in chunks that overlap, with the place of
each token. Near its edges a chunk may have cut a word, a normal form or a special string, so
its tokens there may be wrong. Inside an overlap the two chunks are compared token by token. A
place is a stable boundary if both have the same token there, both start a pre-token with it,
no normal form joins its first character to what is before, and it is farther from the left chunk's end
than any special string is long. Pre-tokens are matches found one after the other, and a match depends
on nothing before its start: from such a place on the right chunk's tokens are those of the
whole text, up to it the left chunk's are. Where an overlap has no such place, it is widened
until it has, up to the whole of both chunks, which then become one.

Shorter texts have nothing to splice. They are encoded whole; for tokenizer files whose words between
white space are independent, which is checked by the file's own steps, word by word with the
counts of words remembered.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweir.llm import spans
from bookweir.llm.word_bpe import Lazy, Model, firm, unsafe_characters
from bookweir.llm.work import map_texts, once, utf8

#: Characters of a chunk and of the first try at an overlap.
CHUNK = 8192
OVERLAP = 256
# Words whose counts a worker remembers.
CACHE = 300_000
# Marks at the end of a word that begin a pre-token of their own after an ASCII letter or digit.
_TAIL = re.compile(rb"(.*[A-Za-z0-9])([.,;:!?#$%&*]+)", re.DOTALL)


class Counter:
    """Tokens of words without white space, as the tokenizer gives them, remembered."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.tokenizer = self.model.tokenizer
        self.by_word = self.model.by_word
        self.cache: dict[bytes, int] = {}

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Word by word. A word is looked up in two parts where its end is a pre-token of its own."""
        parts = []
        for word in words:
            if b"<" in word:  # may hold a special string, which is taken by its letters' case
                parts.append((word, b""))
                continue
            found = _TAIL.fullmatch(word)
            core, tail = found.groups() if found else (word, b"")
            parts.append((core.lower(), tail))  # bytes: only ASCII letters change, as the tokenizer lowers them
        fresh = list({p for pair in parts for p in pair if p and p not in self.cache})
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = list({p for pair in parts for p in pair if p})
        for lo in range(0, len(fresh), 10_000):
            some = fresh[lo : lo + 10_000]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.cache.update(zip(some, map(len, encoded)))
        cache = self.cache
        cache[b""] = 0
        return np.fromiter((cache[a] + cache[b] for a, b in parts), np.int64, len(parts))


def _counter(path: str) -> Counter:
    return once(f"counter {path}", partial(Counter, path))


def encode_chunks(data: np.ndarray, offsets: np.ndarray, counter: Counter) -> tuple[np.ndarray, ...]:
    """Starts, ends, chunk and token count of every word of a batch of chunks."""
    starts, ends, chunk = spans.word_spans(data, offsets)
    which, number = spans.distinct(spans.span_hashes(data, starts, ends))
    buffer = data.tobytes()
    words = [buffer[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())]
    counts = counter.counts(words)
    return starts, ends, chunk, counts[number] if len(number) else np.zeros(0, np.int64)


def _common(text: str, left: Lazy, right: Lazy, back: int, limit: int, unsafe: frozenset) -> tuple[int, int] | None:
    """Numbers of the token at a stable boundary in the left and the right chunk, the last one before `limit`."""
    at = {}
    for k in range(left.n - 1, -1, -1):
        start = left.span(k)[0]
        if start <= back:
            break
        if start < limit:
            at[start] = k
    found = None
    for j in range(1, right.n):
        start, end = right.span(j)
        if start >= limit:
            break
        k = at.get(start)
        if k is None or left.span(k) != (start, end) or left.id(k) != right.id(j):
            continue
        if firm(text, left, k, unsafe) and firm(text, right, j, unsafe) and left.starts_word(k) and right.starts_word(j):
            found = k, j
    return found


def count_long(text: str, model: Model, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text by overlapping chunks, spliced at stable common boundaries."""
    unsafe = once("word bpe unsafe", unsafe_characters)

    def encode(lo: int, hi: int) -> Lazy:
        return Lazy(model.encodings([text[lo:hi]])[0], lo)

    lo, hi = 0, min(chunk, len(text))
    left, total, first, done = encode(lo, hi), 0, 0, 0
    while hi < len(text):
        width = overlap
        while True:
            back = max(lo, hi - width)
            next_hi = min(len(text), max(back + chunk, hi + width))
            right = encode(back, next_hi)
            found = _common(text, left, right, max(back, done), hi - model.margin, unsafe)
            if found or back == lo:
                break
            width *= 2
        if found:  # what is before the boundary is settled
            total += found[0] - first
            left, first, lo, hi = right, found[1], back, next_hi
            done = left.span(first)[0]
            continue
        # The overlap is the whole left chunk and has no stable place: both chunks become one.
        hi = min(len(text), max(next_hi, 2 * hi - lo))
        left = encode(lo, hi)
        first = next((k for k in range(left.n) if done and left.span(k)[0] >= done), 0)
    return total + left.n - first


def token_counts(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Each row (struct `row`) and `out`: n_bytes and n_tokens of its text.

    Null text is empty: no bytes, no tokens; repeated rows get the same counts; a text
    longer than a chunk is spliced, whatever its words are; an empty table gives an empty result.
    """

    def work(texts: pa.Array) -> list:
        counter = _counter(path)
        said = [t or "" for t in texts.to_pylist()]
        lengths = np.fromiter(map(len, said), np.int64, len(said))
        n_tokens = np.zeros(len(texts), np.int64)
        for k in np.flatnonzero(lengths > chunk).tolist():
            n_tokens[k] = count_long(said[k], counter.model, chunk, overlap)
        short = np.flatnonzero(lengths <= chunk)
        data, offsets = utf8(pa.array([said[k] for k in short.tolist()], pa.string()))
        if counter.by_word:
            _, _, of, counts = encode_chunks(data, offsets, counter)
            n_tokens[short] = np.bincount(of, counts, minlength=len(short)).astype(np.int64)
        else:
            encoded = counter.tokenizer.encode_batch_fast([said[k] for k in short.tolist()], add_special_tokens=False)
            n_tokens[short] = list(map(len, encoded))
        n_bytes = np.fromiter((len(t.encode()) for t in said), np.int64, len(said))
        return [pa.array(n_bytes), pa.array(n_tokens)]

    return map_texts(docs, text_col, "n_bytes long, n_tokens long", work, keep, limit=1 << 20, kept=("counter", "word bpe unsafe"))


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens and over_limit."""
    found = token_counts(docs, path, text_col, keep=[id_col])
    ident = F.col("row")[id_col].alias(id_col)
    return found.select(ident, "out.*", (F.col("out.n_tokens") > limit).alias("over_limit"))
