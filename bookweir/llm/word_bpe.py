"""BPE encoding and decoding by tree concatenation.

A long text is cut in halves, the halves in halves, down to leaves that the tokenizer library
encodes as texts of their own, side by side. Going up the tree, two neighbours are joined: a
window of text around the cut is encoded anew, wider and wider, until it agrees with both
sides: its first token is one that the left side has at that place, and further right it
has a token that the right side has at that place. The joined text then has the left
side's tokens up to the first place, the window's between, and the right side's from the other on.

Agreement is proof, where it is taken at a place of one of two kinds:

- Both start a pre-token there. The pre-tokens are matches found one after the other, and a
  match depends on nothing before its start. So from there on both sides see the same text
  in the same state. The character there must be one that no normal form joins to what is
  before it, and the place so far from a cut that no special string reaches over it.
- Both are inside a run of letters (or of other marks) that is one pre-token for both, which
  ends at the same place for both. Pair merging of a run gives the one sequence of
  tokens in which every two neighbours, encoded alone, stay as they are. Neighbours on the left
  are neighbours in one valid encoding, those on the right in another, and the token on
  which they agree belongs to both, so the joined sequence has the property throughout.

The normal form must be one that works from left to right and, as the table of safe characters
has it, NFC or none; pre-tokens must be matches of a pattern without look-behind whose
letters, numbers and other marks form runs. That holds for lower-cased word BPE files.

Where the file's own steps show that words between white space are independent, a leaf is encoded word
by word. The library encodes the words not met before; ids of words are remembered. Places of tokens are asked
of the library for the words next to a cut only.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweir.llm.work import begin, bounds, once, quoted

#: Characters of a leaf; texts up to this long are encoded as they are.
LEAF = 4096
#: Characters of a part: longer texts are encoded by several tasks, part by part.
PART = 1 << 15
#: Tokens at either edge of a part whose places go with it.
EDGE = 64
#: Characters of the first window on either side of a cut.
WINDOW = 48
# Bytes of texts that a worker encodes at a time.
_BATCH = 1 << 20
# Words whose ids a worker remembers, and the longest one.
WORDS = 1_000_000
_LONGEST = 64
# Words that the library is given in one text.
_JOINED = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Marks at the end of a word that begin a pre-token of their own after an ASCII letter or digit.
_MARKS = b".,;:!?#$%&*"
_ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


# The steps of a file under which words between ASCII white space are independent, only
# ASCII letters of an ASCII word change, and marks at its end are a pre-token of their own.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BY_WORD = [
    {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]


class Model:
    """The tokenizer, and what its tokens are when decoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        special = [str(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: How far a place must be from a cut for no special string to reach from one to the other.
        self.margin = max([4, *map(len, special)]) + 1
        steps = json.loads(self.tokenizer.to_str())
        #: Whether a word's tokens depend on nothing beyond the white space around it.
        self.by_word = [steps["normalizer"], steps["pre_tokenizer"]] == BY_WORD and steps["model"]["type"] == "BPE" and all(
            "<" in t.content and not (_WORD.sub("", t.content) or t.lstrip or t.rstrip or t.single_word or t.normalized)
            for t in self.tokenizer.get_added_tokens_decoder().values()
        )
        # The last token of a pre-token is one of these.
        suffix = steps["model"].get("end_of_word_suffix")
        self._last = np.array([bool(suffix) and t.endswith(suffix) for t in self.tokens], bool)
        self._words: dict[bytes, bytes] = {}
        self._places: dict[str, tuple] = {}

    def word_ids(self, texts: list[str]) -> list[list[bytes]]:
        """Per text the ids of each word between ASCII white space, as 32-bit integers."""
        said = [t.encode().split() for t in texts]
        found = [list(map(self._words.get, words)) for words in said]
        fresh = {w for words, ids in zip(said, found) for w, i in zip(words, ids) if i is None}
        encoded = self._encoded(fresh)
        for words, ids in zip(said, found):
            for k in [k for k, i in enumerate(ids) if i is None]:
                ids[k] = encoded[words[k]]
        if len(self._words) > WORDS:
            self._words.clear()
        self._words.update((w, ids) for w, ids in encoded.items() if len(w) <= _LONGEST)
        return found

    def _encoded(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words. Those of ASCII are encoded in small letters, and marks at the end for themselves."""
        known, out, open_words, new = self._words, {}, [], set()
        for word in words:
            core, tail = word, b""
            if b"<" not in word:  # else it may hold a special string
                bare = word.rstrip(_MARKS)
                if bare is not word and bare and bare[-1] in _ALNUM:
                    core, tail = bare, word[len(bare) :]
                if core.isascii():  # small letters of other words may join with marks that capitals don't join
                    core = core.lower()
            first, second = known.get(core), known.get(tail) if tail else b""
            if first is not None and second is not None:
                out[word] = first + second
                continue
            open_words.append((word, core, tail))
            if first is None:
                new.add(core)
            if second is None:
                new.add(tail)
        found = self._fresh(new)
        for word, core, tail in open_words:
            ids = found[core] if core in found else known[core]
            out[word] = ids + (found[tail] if tail in found else known[tail]) if tail else ids
        out.update(found)
        return out

    def _fresh(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words as the library gives them, those of letters many at a time."""
        found = {}
        # A word has one pre-token at least; a text of letters and blanks that has as many as words has one for each.
        letters = [w for w in words if w.decode().isalpha()]
        others = [w for w in words if not w.decode().isalpha()]
        for lo in range(0, len(letters), 64 * _JOINED):
            some = [letters[k : k + _JOINED] for k in range(lo, min(lo + 64 * _JOINED, len(letters)), _JOINED)]
            for own, encoded in zip(some, self._fast([b" ".join(x).decode() for x in some])):
                ids = np.array(encoded.ids, "<u4")
                ends = 4 * (np.flatnonzero(self._last[ids]) + 1)
                if len(ends) != len(own) or ends[-1] != 4 * len(ids):
                    others += own
                    continue
                data, start = ids.tobytes(), 0
                for word, end in zip(own, ends.tolist()):
                    found[word] = data[start:end]
                    start = end
        for lo in range(0, len(others), 10_000):
            some = others[lo : lo + 10_000]
            found.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self._fast([w.decode() for w in some])))
        return found

    def places(self, word: str) -> tuple[list[tuple[int, int]], list[bool]]:
        """Spans of the tokens of a word, and whether each starts a pre-token."""
        if word in self._places:
            return self._places[word]
        tokens = Lazy(self.encodings([word])[0], 0)
        found = [tokens.span(k) for k in range(tokens.n)], [tokens.starts_word(k) for k in range(tokens.n)]
        if len(word) <= _LONGEST:
            if len(self._places) >= WORDS // 20:
                self._places.clear()
            self._places[word] = found
        return found

    def _fast(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.by_word:
            return [np.frombuffer(b"".join(words), "<u4").astype(np.int64) for words in self.word_ids(texts)]
        return [np.array(e.ids, np.int64) for e in self._fast(texts)]

    def encodings(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def leaves(self, texts: list[str], bases: list[int]) -> list:
        """The tokens of each text, which stands at its base in a longer one."""
        if self.by_word:
            return [Worded(self, t, words, base) for t, words, base in zip(texts, self.word_ids(texts), bases)]
        return [Lazy(e, base) for e, base in zip(self.encodings(texts), bases)]

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes ids, special tokens included; without a decoder that joins tokens by blanks."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


def _model(path: str) -> Model:
    return once(f"word bpe {path}", partial(Model, path))


def unsafe_characters() -> frozenset:
    """Characters that a normal form may join to, or move before, what is in front of them."""
    found = set()
    for code in range(0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c or (code > 0x7F and unicodedata.category(c) == "Cn"):
            found.add(c)
        elif parts and not parts.startswith("<") and " " in parts:
            found.add(chr(int(parts.split()[1], 16)))
    found.update(chr(code) for code in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])
    return frozenset(found)


class Lazy:
    """A library encoding of text[base:], asked token by token."""

    def __init__(self, encoding, base: int):
        self.encoding, self.base, self.n, self._ids = encoding, base, len(encoding), None

    def span(self, k: int) -> tuple[int, int]:
        start, end = self.encoding.token_to_chars(k)
        return start + self.base, end + self.base

    def starts_word(self, k: int) -> bool:
        return not k or self.encoding.token_to_word(k) != self.encoding.token_to_word(k - 1)

    def ids(self) -> np.ndarray:
        if self._ids is None:
            self._ids = np.array(self.encoding.ids, np.int64)
        return self._ids

    def id(self, k: int) -> int:
        return int(self.ids()[k])


class Worded:
    """Tokens of text[base:] word by word: ids at once, places for the words that are asked for."""

    def __init__(self, model: Model, text: str, words: list[bytes], base: int):
        self._model, self._text, self.base = model, text, base
        self._ids = np.frombuffer(b"".join(words), "<u4").astype(np.int64)
        self.n = len(self._ids)
        self._first = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) // 4, out=self._first[1:])
        self._near: dict[bool, list[tuple[int, str]]] = {False: [], True: []}
        self._asked: dict[int, tuple] = {}

    def _word(self, w: int) -> tuple[int, str]:
        """Start of a word and the word, read from the nearer end of the text as far as asked."""
        of, text = len(self._first) - 1, self._text
        from_end = 2 * w >= of
        need, size = of - w if from_end else w + 1, 256
        near = self._near[from_end]
        while len(near) < need:
            lo, hi = (max(0, len(text) - size), len(text)) if from_end else (0, min(size, len(text)))
            near = [(m.start(), m[0]) for m in _WORD.finditer(text, lo, hi)]
            if from_end and lo:  # what touches the place where the reading began or stopped may go on there
                near = near[1:] if near and near[0][0] == lo else near
            elif not from_end and hi < len(text):
                near = near[:-1] if near and near[-1][0] + len(near[-1][1]) == hi else near
            size *= 4
        self._near[from_end] = near
        return near[-need] if from_end else near[w]

    def _at(self, k: int) -> tuple[int, int, bool]:
        w = int(np.searchsorted(self._first, k, side="right")) - 1
        if w not in self._asked:
            start, word = self._word(w)
            self._asked[w] = start + self.base, *self._model.places(word)
        at, spans, firsts = self._asked[w]
        j = k - int(self._first[w])
        return spans[j][0] + at, spans[j][1] + at, firsts[j]

    def span(self, k: int) -> tuple[int, int]:
        return self._at(k)[:2]

    def starts_word(self, k: int) -> bool:
        return self._at(k)[2]

    def ids(self) -> np.ndarray:
        return self._ids

    def id(self, k: int) -> int:
        return int(self._ids[k])


class Listed:
    """Tokens of a part that another task encoded: all ids, and the spans of those near its edges.

    A window that asks for more has the part encoded here again.
    """

    def __init__(self, ids: np.ndarray, edges: tuple, base: int, again):
        self._ids, self._edges, self.base, self.n, self._again = ids, edges, base, len(ids), again

    def _at(self, k: int) -> tuple[int, int, bool]:
        starts, ends, words = self._edges
        if len(starts) < self.n and EDGE <= k < self.n - EDGE:
            starts, ends, words = self._edges = self._again()
        j = k if len(starts) == self.n or k < EDGE else k - self.n
        return int(starts[j]) + self.base, int(ends[j]) + self.base, bool(words[j])

    def span(self, k: int) -> tuple[int, int]:
        return self._at(k)[:2]

    def starts_word(self, k: int) -> bool:
        return not k or self._at(k)[2]

    def ids(self) -> np.ndarray:
        return self._ids

    def id(self, k: int) -> int:
        return int(self._ids[k])


class Rope:
    """The tokens of text[lo:hi]: stretches (tokens, first, end) of encodings, one after the other."""

    def __init__(self, lo: int, hi: int, stretches: list[tuple]):
        self.lo, self.hi, self.stretches = lo, hi, [s for s in stretches if s[1] < s[2]]

    def from_right(self):
        """Places (stretch, token) from the last token to the first."""
        for s in range(len(self.stretches) - 1, -1, -1):
            _, first, end = self.stretches[s]
            for k in range(end - 1, first - 1, -1):
                yield s, k

    def from_left(self):
        for s, (_, first, end) in enumerate(self.stretches):
            for k in range(first, end):
                yield s, k

    def before(self, place: tuple[int, int]) -> list[tuple]:
        s, k = place
        tokens, first, _ = self.stretches[s]
        return [*self.stretches[:s], (tokens, first, k)]

    def since(self, place: tuple[int, int]) -> list[tuple]:
        s, k = place
        tokens, _, end = self.stretches[s]
        return [(tokens, k, end), *self.stretches[s + 1 :]]

    def ids(self) -> np.ndarray:
        if not self.stretches:
            return np.zeros(0, np.int64)
        return np.concatenate([t.ids()[a:b] for t, a, b in self.stretches])

    def spans(self, edge: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends from the rope's start, and whether a token starts a pre-token, of all tokens or the outer ones."""
        places = [(t, k) for t, a, b in self.stretches for k in range(a, b)]
        if edge is not None and len(places) > 2 * edge:
            places = [*places[:edge], *places[-edge:]]
        spans = np.array([t.span(k) for t, k in places], np.int32).reshape(-1, 2) - self.lo
        return spans[:, 0], spans[:, 1], np.array([t.starts_word(k) for t, k in places], bool)


def firm(text: str, tokens, k: int, unsafe: frozenset, inside: bool = False) -> bool:
    """Whether token k is at a place where agreement is proof: it starts a pre-token, or is `inside` a run of one kind."""
    start, end = tokens.span(k)
    if start == end or text[start] in unsafe:
        return False
    if not k:
        return True
    if tokens.span(k - 1)[1] > start:  # both are bytes of one character
        return False
    if tokens.starts_word(k):
        return True
    return inside and "'" not in text[max(0, start - 2) : start + 1] and text[start - 1] not in unsafe


class _Join:
    """Two neighbours of a text on their way to be one."""

    def __init__(self, text: str, left: Rope, right: Rope, margin: int, unsafe: frozenset):
        self.text, self.left, self.right, self.margin, self.unsafe = text, left, right, margin, unsafe
        self.reach, self.cut = WINDOW, left.hi

    def _firm(self, tokens, k: int, first: int, starts_text: bool) -> bool:
        if k == first and not (starts_text and not k):
            return False
        return firm(self.text, tokens, k, self.unsafe, inside=True)

    def window(self) -> str:
        """The text to encode: from a firm token of the left side to as far beyond the cut."""
        self.start, self.anchor = self.left.lo, None
        for place in self.left.from_right():
            tokens, first, _ = self.left.stretches[place[0]]
            start = tokens.span(place[1])[0]
            if start <= self.cut - max(self.reach, self.margin) and self._firm(tokens, place[1], first, False):
                self.start, self.anchor = start, place
                break
        self.end = min(self.right.hi, self.cut + self.reach + self.margin)
        return self.text[self.start : self.end]

    def agreed(self, encoding) -> Rope | None:
        """The joined rope if the window agrees with both sides, else None: a wider one is needed."""
        window = Lazy(encoding, self.start)
        if self.anchor is not None:
            s, k = self.anchor
            tokens = self.left.stretches[s][0]
            if not window.n or window.span(0) != tokens.span(k) or window.id(0) != tokens.id(k):
                return self._wider()
            before = self.left.before(self.anchor)
        else:
            before = []
        limit = self.right.hi if self.end == self.right.hi else self.end - self.margin
        at = {}
        for place in self.right.from_left():
            tokens, first, _ = self.right.stretches[place[0]]
            start = tokens.span(place[1])[0]
            if start >= limit:
                break
            at.setdefault(start, place)
        for k in range(window.n):
            start, end = window.span(k)
            place = at.get(start) if self.cut <= start < limit else None
            if place is None:
                continue
            s, j = place
            tokens, first, _ = self.right.stretches[s]
            if tokens.span(j) != (start, end) or tokens.id(j) != window.id(k) or not self._firm(tokens, j, first, not s):
                continue
            if not self._firm(window, k, 0, False) or window.starts_word(k) != tokens.starts_word(j):
                continue
            return Rope(self.left.lo, self.right.hi, [*before, (window, 0, k), *self.right.since(place)])
        if self.start == self.left.lo and self.end == self.right.hi:
            return Rope(self.left.lo, self.right.hi, [(window, 0, window.n)])
        return self._wider()

    def _wider(self) -> None:
        self.reach *= 2


def concatenated(model: Model, texts: list[str], forests: list[list[Rope]]) -> list[Rope]:
    """Join the neighbouring ropes of every text, pair by pair, level by level."""
    unsafe = once("word bpe unsafe", unsafe_characters)
    forests = [list(f) for f in forests]
    while any(len(f) > 1 for f in forests):
        open_joins, places = [], []
        for t, forest in enumerate(forests):
            for k in range(0, len(forest) - 1, 2):
                open_joins.append(_Join(texts[t], forest[k], forest[k + 1], model.margin, unsafe))
                places.append((t, k))
        done: dict[tuple[int, int], Rope] = {}
        while open_joins:
            encodings = model.encodings([j.window() for j in open_joins])
            found = [j.agreed(e) for j, e in zip(open_joins, encodings)]
            done.update({p: rope for p, rope in zip(places, found) if rope is not None})
            open_joins, places = (
                [j for j, rope in zip(open_joins, found) if rope is None],
                [p for p, rope in zip(places, found) if rope is None],
            )
        forests = [[done.get((t, k), forest[k]) for k in range(0, len(forest), 2)] for t, forest in enumerate(forests)]
    return [f[0] if f else Rope(0, 0, []) for f in forests]


def _cuts(length: int, most: int) -> list[tuple[int, int]]:
    """Halves of halves of a text until none is longer than `most`."""
    n = 1
    while -(-length // n) > most:
        n *= 2
    edges = [length * k // n for k in range(n + 1)]
    return list(zip(edges, edges[1:]))


def ropes(model: Model, texts: list[str], leaf: int = LEAF) -> list[Rope]:
    """Each text's tokens by tree concatenation; all leaves are encoded in one go."""
    cuts = [_cuts(len(t), leaf) for t in texts]
    leaves = iter(model.leaves([t[a:b] for t, own in zip(texts, cuts) for a, b in own], [a for own in cuts for a, _ in own]))
    forests = []
    for own in cuts:
        forest = []
        for a, b in own:
            tokens = next(leaves)
            forest.append(Rope(a, b, [(tokens, 0, tokens.n)]))
        forests.append(forest)
    return concatenated(model, texts, forests)


def encode(model: Model, texts: list[str], leaf: int = LEAF) -> list[np.ndarray]:
    """Ids of each text: short ones as they are, long ones by tree concatenation."""
    out: list = [None] * len(texts)
    short = [k for k, t in enumerate(texts) if len(t) <= leaf]
    for k, ids in zip(short, model.ids([texts[k] for k in short])):
        out[k] = ids
    long = [k for k, t in enumerate(texts) if len(t) > leaf]
    for k, rope in zip(long, ropes(model, [texts[k] for k in long], leaf)):
        out[k] = rope.ids()
    return out


_PIECE = T.StructType(
    [
        T.StructField("lo", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.ArrayType(T.BooleanType())),
    ]
)


def _of_texts(docs: DataFrame, keep: list[str], text_col: str, path: str, fields: T.StructType, made, leaf: int, part: int) -> DataFrame:
    """Rows `row` and `out`, what `made(model, ids)` makes of the ids of each text.

    Texts of more than `part` characters go through three steps of their own: a task cuts
    them, several encode the parts, and the parts of a text meet to be joined.
    """
    row_type = T.StructType([docs.schema[name] for name in keep])
    result = T.StructType([T.StructField("row", row_type), T.StructField("out", fields)])
    row = F.struct(*[F.col(quoted(name)) for name in keep]).alias("row")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    inputs = docs.select(row, text.alias("text"), (F.length(text) > part).alias("long"))

    def outs(model: Model, found: list[np.ndarray]) -> pa.Array:
        values = list(zip(*[made(model, ids) for ids in found])) or [[] for _ in fields]
        arrays = [pa.array(list(v), _ARROW[f.dataType.simpleString()]) for v, f in zip(values, fields)]
        return pa.StructArray.from_arrays(arrays, names=[f.name for f in fields])

    def whole(batches):
        begin("word bpe")
        model = _model(path)
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for lo, hi in bounds(lengths, _BATCH):
                found = encode(model, batch.column(1).slice(lo, hi - lo).to_pylist(), leaf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), outs(model, found)], names=["row", "out"])

    def cut(batches):
        begin("word bpe")
        for batch in batches:
            for k in range(batch.num_rows):
                said = batch.column(2)[k].as_py()
                own = _cuts(len(said), part)
                rows = batch.column(1).slice(k, 1).take(pa.array([0] + [None] * (len(own) - 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[k].as_py()] * len(own), pa.int64()),
                        rows,
                        pa.array([a for a, _ in own], pa.int64()),
                        pa.array([said[a:b] for a, b in own], pa.string()),
                    ],
                    names=["rid", "row", "lo", "text"],
                )

    def encode_parts(batches):
        begin("word bpe")
        model = _model(path)
        for batch in batches:
            for k in range(batch.num_rows):
                said = batch.column(3)[k].as_py()
                rope = ropes(model, [said], leaf)[0]
                starts, ends, words = rope.spans(EDGE)
                columns = [rope.ids().astype(np.int32), starts.astype(np.int32), ends.astype(np.int32), words]
                made_of = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in columns]
                piece = pa.StructArray.from_arrays(
                    [batch.column(2).slice(k, 1), batch.column(3).slice(k, 1), *made_of], names=[f.name for f in _PIECE]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), piece], names=["rid", "row", "piece"]
                )

    def join_parts(group: pa.Table) -> pa.Table:
        model = _model(path)
        pieces = group.column("piece").combine_chunks()
        order = np.argsort(pieces.field("lo").to_numpy(zero_copy_only=False))
        said, forest = [], []
        for k in order.tolist():
            lo, part_text = pieces.field("lo")[k].as_py(), pieces.field("text")[k].as_py()
            arrays = [pieces.field(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ids", "starts", "ends", "words")]
            again = lambda t=part_text: ropes(model, [t], leaf)[0].spans()
            tokens = Listed(arrays[0].astype(np.int64), tuple(arrays[1:]), lo, again)
            forest.append(Rope(lo, lo + len(part_text), [(tokens, 0, tokens.n)]))
            said.append(part_text)
        rope = concatenated(model, ["".join(said)], [forest])[0]
        first = group.column("row").combine_chunks().slice(int(order[0]), 1)
        return pa.Table.from_arrays([first, outs(model, [rope.ids()])], names=["row", "out"])

    short = inputs.filter("NOT long").select("row", "text").mapInArrow(whole, result)
    numbered = inputs.filter("long").select(F.monotonically_increasing_id().alias("rid"), "row", "text")
    cut_type = T.StructType([T.StructField("rid", T.LongType()), T.StructField("row", row_type), T.StructField("lo", T.LongType()), T.StructField("text", T.StringType())])
    part_type = T.StructType([*cut_type.fields[:2], T.StructField("piece", _PIECE)])
    parts = numbered.mapInArrow(cut, cut_type).repartition("rid", "lo").mapInArrow(encode_parts, part_type)
    joined = parts.groupBy("rid").applyInArrow(join_parts, result)
    return short.unionByName(joined)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """Each row (struct `row`) and `out`: n_tokens and the ids of its text.

    `path` is a tokenizer file of the tokenizers library. Null text is empty and has no tokens;
    special strings inside a text are the tokens that the library takes them for; repeated
    rows get the same ids; a text that is one run without any blank is joined like
    any other; an empty table gives an empty result.
    """
    fields = T._parse_datatype_string("n_tokens long, ids array<int>")
    keep = docs.columns if keep is None else keep
    return _of_texts(docs, keep, text_col, path, fields, lambda model, ids: (len(ids), ids.tolist()), leaf, part)


def decoded(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Each row (struct `row`) and `out`: the `text` that its ids decode to; null ids give null."""
    row_type = T.StructType(docs.schema.fields)
    result = T.StructType([T.StructField("row", row_type), T.StructField("out", T._parse_datatype_string("text string"))])

    def run(batches):
        begin("word bpe")
        model = _model(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = pa.array([None if x is None else model.decode(np.array(x, np.int64)) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays([texts], names=["text"])], names=["row", "out"])

    row = F.struct(*[F.col(quoted(name)) for name in docs.columns]).alias("row")
    return docs.select(row, F.col(quoted(ids_col)).alias("ids")).mapInArrow(run, result)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, part: int = PART) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256."""
    fields = T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string")

    def made(model: Model, ids: np.ndarray) -> tuple:
        said = hashlib.sha256(model.decode(ids).encode()).hexdigest()
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), said

    found = _of_texts(docs, [id_col], text_col, path, fields, made, leaf, part)
    return found.select(F.col("row")[id_col].alias(id_col), "out.*")
