"""Words, lines and other spans of a batch of texts as numpy arrays over the joined bytes."""

from __future__ import annotations

import numpy as np

# Bytes hashed at a time, so that the tables of powers stay small; a longer span is hashed alone.
_STEP = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; distinct values stay distinct."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and which text each is in. A word is a run of bytes that aren't white space."""
    return runs(~_SPACE[data], offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty stretches between line breaks."""
    return runs(data != 10, offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of marked bytes that don't cross from one text into the next."""
    fence = np.zeros(len(inside) + 1, bool)
    fence[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | fence[:-1]))
    ends = np.flatnonzero(inside & (~after | fence[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, all at once: differences of running sums."""
    out = np.zeros(len(starts), np.uint64)
    up, down = _powers(min(_STEP, len(data)))
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + _STEP, side="right")))
        size = int(ends[hi - 1]) - base
        if size >= len(up):
            up, down = _powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_LETTERS[data[base : base + size]] * up[:size], out=sums[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        lo = hi
    return mix(out)


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of `size` consecutive words within one text, and their hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total = total * _BASE + hashes[k : k + n]
    places = np.flatnonzero(text[:n] == text[size - 1 :])
    return places, mix(total[places])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one item of each key, and for every item the number of its key."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the marks of each text's bytes."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
