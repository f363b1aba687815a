"""Plain, slow forms of the corpus operators to compare with."""

from __future__ import annotations

import collections
import math
import re


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def shingle_set(text: str | None) -> frozenset:
    w = lowered(text).split()
    if len(w) >= 5:
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def near_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """Size of the shingle set and smallest id reachable, by comparing all that share a shingle."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    up = {i: i for i in sets}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in holders[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality_figures(text: str | None) -> dict:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
    }


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_spans(text: str | None) -> list[str]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip"
                and all(int(x) <= 255 for x in m[0].split("."))
                or kind == "card"
                and 16 <= len(digits) <= 19
                and luhn(digits)
                or kind == "phone"
                and 8 <= len(digits) <= 15
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


class ContextTree:
    """Context-tree weighting with one dictionary per node, straight from the recursion."""

    def __init__(self, texts: list[bytes], depth: int):
        self.depth = depth
        self.counts = collections.defaultdict(lambda: [0, 0])
        self.children = collections.defaultdict(set)
        for text in texts:
            for context, bits in self.steps(text):
                for k in range(8):
                    for d in range(depth + 1):
                        self.counts[(context[:d], bits[:k])][int(bits[k])] += 1
                        if d < depth:
                            self.children[(context[:d], bits[:k])].add(context[d])
        self.weighted = {}

    def steps(self, text: bytes):
        whole = bytes([255]) * self.depth + text + bytes([255])
        for at in range(self.depth, len(whole)):
            yield whole[at - self.depth : at][::-1], format(whole[at], "08b")

    def block(self, node) -> float:
        a, b = self.counts[node] if node in self.counts else (0, 0)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weight(self, node) -> float:
        """log of the weighted probability of a node."""
        if node not in self.weighted:
            context, bits = node
            own = self.block(node)
            if len(context) < self.depth:
                below = sum(self.weight((context + bytes([c]), bits)) for c in self.children[node])
                top = max(own, below)
                own = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))
            self.weighted[node] = own
        return self.weighted[node]

    def chance(self, context: bytes, bits: str, bit: str) -> float:
        value = None
        for d in range(self.depth, -1, -1):
            node = (context[:d], bits)
            a, b = self.counts[node] if node in self.counts else (0, 0)
            own = ((b if bit == "1" else a) + 0.5) / (a + b + 1)
            if d == self.depth:
                value = own
            else:
                share = 0.5 * math.exp(self.block(node) - self.weight(node))
                value = share * own + (1 - share) * value
        return value

    def score(self, text: bytes) -> float:
        return sum(
            math.log10(self.chance(context, bits[:k], bits[k])) for context, bits in self.steps(text) for k in range(8)
        )


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Share out by weight again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out
