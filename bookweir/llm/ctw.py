"""Context-tree weighting of bytes, each decomposed into its eight binary decisions.

Every node of a decision tree over the bits of the next byte has a context tree of its own
over the preceding bytes. A context node keeps how often the decision went either way there;
its Krichevsky-Trofimov estimate and the product of its children's weighted probabilities are
mixed half and half, at every depth. With the counts fixed after training, the chance of a
decision is a mixture over all depths whose weights follow from the block probabilities,
so the chance of a byte after a context depends on nothing but the last bytes.

All of this is done on arrays of "grams": a context of `depth` bytes, the latest first, and
the byte that follows, packed into one integer, so that sorting puts every context node's
grams side by side at each depth.
"""

from __future__ import annotations

import math

import numpy as np

#: Bytes of context (at most 6, for a gram to fit an integer with room for the end).
DEPTH = 5
#: What stands before a text and ends it; no byte of UTF-8.
EDGE = 255
#: Depth at which the trees are parted among tasks: above it, a context has one byte or none.
PARTED = 2


def grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """One gram for each byte of each text and for its end, and the text of each."""
    lengths = np.diff(offsets)
    n = len(lengths)
    # Each text is led by `depth` edges and closed by one.
    total = len(data) + n * (depth + 1)
    shift = np.repeat(np.arange(n) * (depth + 1) + depth, lengths)
    sequence = np.full(total, EDGE, np.uint8)
    sequence[np.arange(len(data)) + shift] = data
    scored = np.ones(total, bool)
    first = offsets[:-1] + np.arange(n) * (depth + 1)
    for k in range(depth):
        scored[first + k] = False
    keys = sequence.astype(np.uint64)
    for back in range(1, depth + 1):
        moved = sequence[: total - back].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
        keys[back:] |= moved
    return keys[scored], np.repeat(np.arange(n), lengths + 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[fresh], np.add.reduceat(counts, fresh) if len(keys) else counts


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series after moving ten up."""
    low = sum(np.log(x + k) for k in range(10))
    y = x + 10
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many decisions either way."""
    half = math.lgamma(0.5)
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - 2 * half - lgamma(zeros + ones + 1.0)


class Level:
    """The grams of one depth and, for each bit of the byte, the nodes they are in."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        byte = (keys & np.uint64(255)).astype(np.int64)
        self.nodes, self.first, self.zeros, self.ones, self.bits = [], [], [], [], []
        for k in range(8):
            prefix = keys >> np.uint64(8 - k)
            fresh = np.concatenate(([True], prefix[1:] != prefix[:-1]))
            node = np.cumsum(fresh) - 1
            bit = byte >> (7 - k) & 1
            ones = np.bincount(node, counts * bit)
            self.nodes.append(node)
            self.first.append(np.flatnonzero(fresh))
            self.ones.append(ones)
            self.zeros.append(np.bincount(node, counts) - ones)
            self.bits.append(bit)
        self.estimate = [block_probability(z, o) for z, o in zip(self.zeros, self.ones)]
        self.weighted = self.estimate  # of leaves; replaced above them
        self.share = None

    def chance(self, k: int) -> np.ndarray:
        """Estimated probability of each gram's k-th bit in its node."""
        node, bit = self.nodes[k], self.bits[k]
        zeros, ones = self.zeros[k][node], self.ones[k][node]
        return (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)

    def mix(self, below: list[np.ndarray]) -> None:
        """Weigh the nodes' own estimates against `below`, the sums of their children's weighted probabilities."""
        self.weighted = [np.logaddexp(e, b) - math.log(2) for e, b in zip(self.estimate, below)]
        self.share = [np.exp(e - math.log(2) - w) for e, w in zip(self.estimate, self.weighted)]


def drop_oldest(keys: np.ndarray, depth: int) -> np.ndarray:
    """Grams of `depth` context bytes without the oldest of them."""
    return keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255) if depth else keys


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels `depth` down to `top`, mixed from below, and for each the place of every gram of the deepest level."""
    found, places = [Level(keys, counts)], [np.arange(len(keys))]
    for d in range(depth - 1, top - 1, -1):
        child = found[-1]
        shorter = drop_oldest(child.keys, d + 1)
        order = np.argsort(shorter, kind="stable")
        ordered = shorter[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        up = np.empty(len(shorter), np.int64)
        up[order] = np.cumsum(fresh) - 1
        level = Level(ordered[fresh], np.bincount(up, counts).astype(float))
        counts = np.bincount(up, counts)
        below = []
        for k in range(8):
            parent = level.nodes[k][up[child.first[k]]]
            below.append(np.bincount(parent, child.weighted[k], minlength=len(level.first[k])))
        level.mix(below)
        found.append(level)
        places.append(up[places[-1]])
    return found, places


def mixed_chances(found: list[Level], places: list[np.ndarray]) -> np.ndarray:
    """For each gram of the deepest level and each bit, its chance as mixed up to the highest level given."""
    out = np.empty((8, len(found[0].keys)))
    for k in range(8):
        chance = found[0].chance(k)
        for level, place in zip(found[1:], places[1:]):
            node = level.nodes[k][place]
            share = level.share[k][node]
            chance = share * level.chance(k)[place] + (1 - share) * chance
        out[k] = chance
    return out


def top_levels(keys: np.ndarray, counts: np.ndarray, nodes: np.ndarray, sums: np.ndarray) -> list[Level]:
    """Levels 1 and 0 from the grams of one context byte (all of them) and the sums of weighted probabilities below.

    `nodes` are numbered as by `numbers`; at most 256 contexts of 255 nodes.
    """
    one = Level(keys, counts)
    order = np.argsort(nodes)
    nodes, sums = nodes[order], sums[order]
    below = []
    for k in range(8):
        own = numbers(one.keys[one.first[k]], k)
        below.append(sums[np.searchsorted(nodes, own)])
    one.mix(below)
    keys, up = np.unique(drop_oldest(one.keys, 1), return_inverse=True)
    zero = Level(keys, np.bincount(up, counts))
    below = [
        np.bincount(zero.nodes[k][up[one.first[k]]], one.weighted[k], minlength=len(zero.first[k])) for k in range(8)
    ]
    zero.mix(below)
    return [one, zero]


def numbers(keys: np.ndarray, k: int) -> np.ndarray:
    """A number for the node of the k-th bit of each gram of one context byte: context, then place in the tree of bits."""
    prefix = (keys & np.uint64(255)) >> np.uint64(8 - k)
    return ((keys >> np.uint64(8)) * np.uint64(256) + np.uint64(1 << k) + prefix).astype(np.int64)
