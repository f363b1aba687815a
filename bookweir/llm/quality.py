"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookweir.llm import spans
from bookweir.llm.work import map_texts, quoted, utf8

#: The sample on which costs and rejections are estimated: at most so many texts of at most
#: so many bytes each. It decides the order of the rules only, never a verdict.
SAMPLE_TEXTS = 400
SAMPLE_BYTES = 1 << 16
FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"!?", np.uint8)] = True


class Texts:
    """The joined bytes of a batch and what the rules share."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = utf8(texts)
        self.n = len(texts)
        self.starts, self.ends, self.text = spans.word_spans(self.data, self.offsets)
        self.n_words = np.bincount(self.text, minlength=self.n)


def figures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base figures of each text of a batch."""
    t = Texts(texts)
    in_word = ~spans._SPACE[t.data]
    word_chars = spans.per_text(in_word & ((t.data & 0xC0) != 0x80), t.offsets)
    n_symbols = spans.per_text(_SYMBOL[t.data], t.offsets)
    # Lines that equal an earlier one: those of a text less its distinct ones.
    starts, ends, text = spans.line_spans(t.data, t.offsets)
    words_before = np.concatenate(([0], np.cumsum(in_word)))
    worded = words_before[ends] > words_before[starts]
    starts, ends, text = starts[worded], ends[worded], text[worded]
    keys = spans.span_hashes(t.data, starts, ends) ^ spans.mix(text.astype(np.uint64) + np.uint64(1))
    first, _ = spans.distinct(keys)
    n_lines = np.bincount(text, minlength=t.n)
    n_dup_lines = n_lines - np.bincount(text[first], minlength=t.n)
    # Words that some repeated window of three covers.
    hashes = spans.span_hashes(t.data, t.starts, t.ends)
    places, keys = spans.windows(hashes, t.text, 3)
    _, number = spans.distinct(keys ^ spans.mix(t.text[places].astype(np.uint64) + np.uint64(1)))
    again = places[np.bincount(number, minlength=1)[number] > 1] if len(places) else places
    covered = np.zeros(len(t.starts) + 2, bool)
    for k in range(3):
        covered[again + k] = True
    n_repeat_words = np.bincount(t.text[covered[: len(t.starts)]], minlength=t.n)
    failed = (t.n_words < 50) | (100 * n_repeat_words > 50 * t.n_words)
    return {
        "n_words": t.n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "base_failed": failed,
        "_lines": n_lines,
    }


@dataclass(frozen=True)
class Rule:
    """`rejects` gets the texts still in the race and their base figures, and marks those it rejects."""

    name: str
    rejects: Callable[[pa.Array, dict[str, np.ndarray]], np.ndarray]


def _symbols(texts: pa.Array, base: dict) -> np.ndarray:
    return base["n_symbols"] > 0.3 * base["n_words"]


def _word_length(texts: pa.Array, base: dict) -> np.ndarray:
    return (base["word_chars"] < 2 * base["n_words"]) | (base["word_chars"] > 15 * base["n_words"])


def _dup_lines(texts: pa.Array, base: dict) -> np.ndarray:
    return (base["n_dup_lines"] >= 3) & (base["n_dup_lines"] > 0.3 * base["_lines"])


def _shouting(texts: pa.Array, base: dict) -> np.ndarray:
    data, offsets = utf8(texts)
    return spans.per_text(_UPPER[data], offsets) > 0.4 * spans.per_text(_LETTER[data], offsets)


def _exclaiming(texts: pa.Array, base: dict) -> np.ndarray:
    data, offsets = utf8(texts)
    return spans.per_text(_MARK[data], offsets) > 0.3 * base["n_words"]


def _few_letters(texts: pa.Array, base: dict) -> np.ndarray:
    data, offsets = utf8(texts)
    return spans.per_text(_LETTER[data], offsets) < 0.5 * spans.per_text(~spans._SPACE[data], offsets)


def _few_kinds(texts: pa.Array, base: dict) -> np.ndarray:
    """Few distinct words for the length: less than twice the square root."""
    t = Texts(texts)
    hashes = spans.span_hashes(t.data, t.starts, t.ends) ^ spans.mix(t.text.astype(np.uint64) + np.uint64(1))
    first, _ = spans.distinct(hashes)
    return np.bincount(t.text[first], minlength=t.n) < 2 * np.sqrt(t.n_words)


RULES = [
    Rule("symbols", _symbols),
    Rule("word_length", _word_length),
    Rule("dup_lines", _dup_lines),
    Rule("shouting", _shouting),
    Rule("exclaiming", _exclaiming),
    Rule("few_letters", _few_letters),
    Rule("few_kinds", _few_kinds),
]


def cascade(texts: pa.Array, base: dict[str, np.ndarray], rules: list[Rule]) -> np.ndarray:
    """Which texts pass the base rule and all others; a rule sees only what the earlier ones let through."""
    alive = np.flatnonzero(~base["base_failed"])
    for rule in rules:
        if not len(alive):
            break
        left = texts.take(pa.array(alive)) if len(alive) < len(texts) else texts
        alive = alive[~rule.rejects(left, {k: v[alive] for k, v in base.items()})]
    kept = np.zeros(len(texts), bool)
    kept[alive] = True
    return kept


def ordered_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> list[Rule]:
    """The rules by rejections per second on the sample, best first."""
    rules = list(RULES if rules is None else rules)
    text = F.col(quoted(text_col))
    rows = docs.select(text.alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).limit(SAMPLE_TEXTS).collect()
    sample = pa.array([r["text"] for r in rows], pa.string())
    base = figures(sample)
    left = np.flatnonzero(~base["base_failed"])
    if not len(left):
        return rules
    sample, base = sample.take(pa.array(left)), {k: v[left] for k, v in base.items()}

    def worth(rule: Rule) -> float:
        began = time.perf_counter()
        rejected = int(np.count_nonzero(rule.rejects(sample, base)))
        return (rejected + 0.5) / (time.perf_counter() - began + 1e-6)

    return sorted(rules, key=worth, reverse=True)


def judged(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Each row (struct `row` of the columns in `keep`, all by default) and `out`: the base figures and `kept`.

    A text fails the base with fewer than 50 words or when repeated windows of three words
    cover over half of it; the other rules run as a cascade, in the order that a sample
    shows to reject most for its cost. The order can't change a verdict.

    Null and empty texts have no words and fail; repeated rows are judged alike; an empty
    table gives an empty result.
    """
    order = ordered_rules(docs, text_col, rules)

    def work(texts: pa.Array) -> list:
        texts = pc.fill_null(texts, "")
        base = figures(texts)
        kept = cascade(texts, base, order)
        return [*[pa.array(v) for k, v in base.items() if k[0] != "_"], pa.array(kept)]

    return map_texts(docs, text_col, f"{FIGURES}, kept boolean", work, keep, limit=1 << 20)


def good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns as they were."""
    return judged(docs, text_col).filter("out.kept").select("row.*")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the base figures, base_failed and kept."""
    return judged(docs, text_col, keep=[id_col]).select(F.col("row")[id_col].alias(id_col), "out.*")
