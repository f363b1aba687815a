"""Tree concatenation against the tokenizer library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bookweir.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def model():
    return word_bpe.Model(PATH)


def _texts(seed: int, n: int, size: int) -> list[str]:
    """Runs of letters without blanks, contractions, marks, combining characters and special strings."""
    rng = random.Random(seed)
    bits = [
        "a", "e", "tion", "the", "ing", "x", "Q", "zz", "don't", "we'LL", "'s", "'", "''", "'re'", "!?", "...", "!'", "#$%", "é", "é",
        "́̂", "̧́", "日本語", "漢", "한", "각", "Ж", "ПрИвЕт", "İ", "ß", "1", "2024", "½", " ", "\n", "\t ", " ",
        "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "<|ENDOFTEXT|>", "😀", "👩‍👧", "क्षि", "ো", "ﬁ", "\u0000",
    ]
    texts = []
    for _ in range(n):
        some = rng.sample(bits, rng.randrange(1, 6)) if rng.random() < 0.7 else bits
        texts.append("".join(rng.choice(some) for _ in range(rng.randrange(size))))
    return texts


@pytest.mark.parametrize(("leaf", "window"), [(3, 1), (7, 2), (16, 4), (50, 48)])
def test_ids_equal_the_librarys(model, library, monkeypatch, leaf, window):
    monkeypatch.setattr(word_bpe, "WINDOW", window)
    texts = [*_texts(leaf, 400, 120), "", "a" * 999, "ab" * 500, "日" * 700, "'" * 300, "́" * 200, "don't" * 200, "<|endoftext|>" * 40]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = word_bpe.encode(model, texts, leaf)
    for text, a, b in zip(texts, want, got):
        assert a == b.tolist(), repr(text)


def test_long_runs_are_joined_by_small_windows(model, library, monkeypatch):
    """A run of letters without a blank isn't encoded as a whole again."""
    rng = random.Random(3)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    encoded, plain = [], model.encodings
    monkeypatch.setattr(model, "encodings", lambda texts: encoded.extend(map(len, texts)) or plain(texts))
    got = word_bpe.encode(model, [text], 4096)[0]
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(encoded) < 1.1 * len(text)


def test_a_window_widens_until_both_sides_agree(model, library, monkeypatch):
    """Nothing but combining marks around the cut: no place there proves anything."""
    monkeypatch.setattr(word_bpe, "WINDOW", 2)
    text = "plain words before it " + "e" + "̧́" * 150 + " and plain words after it"
    assert word_bpe.encode(model, [text], 40)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_met_before_are_not_encoded_again(library, monkeypatch):
    """A leaf is encoded word by word; the library gets new words, and the places of those next to a cut."""
    model = word_bpe.Model(PATH)
    assert model.by_word
    given, fast, places = [], model._fast, model.encodings
    monkeypatch.setattr(model, "_fast", lambda texts: given.extend(texts) or fast(texts))
    monkeypatch.setattr(model, "encodings", lambda texts: given.extend(texts) or places(texts))
    words = ["Letter", "letter,", "J\u030cx", "j\u030cx", "\u01f0x", "we'LL!", "a\u00a0b", "\u00a0", "\u0130st", "\u00c9t\u00e9.", "x<|endoftext|>Y", "<|ENDOFTEXT|>", "3\u00bd", "\u03a3\u03a3.", "#a#"]
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, k=n)) + "\t\n" for n in (1, 50, 3000)]
    for _ in range(2):
        got = word_bpe.encode(model, texts, 4096)
        assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sum(map(len, given)) < 0.1 * sum(map(len, texts))


@pytest.mark.parametrize("kept", [1, 7, 1000])
def test_a_full_cache_of_words_changes_nothing(library, monkeypatch, kept):
    monkeypatch.setattr(word_bpe, "WORDS", kept)
    model, texts = word_bpe.Model(PATH), [*_texts(8, 60, 200), "x" * 500, "long " * 99 + "y" * 99]
    for lo in range(0, len(texts), 10):
        some = texts[lo : lo + 10]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in word_bpe.encode(model, some, 40)] == want


def _expected(library, text):
    found = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(found, skip_special_tokens=False)
    return len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def _frame(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "out", "ids", "rid", "lo", "piece", "long", "n_tokens"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame.repartition(4)


@pytest.mark.parametrize("edge", [1, 4, 256])
def test_digests_over_several_tasks(spark, library, monkeypatch, edge):
    monkeypatch.setattr(word_bpe, "EDGE", edge)  # with few, parts are encoded again where they are joined
    texts = [None, "", *_texts(11, 60, 300), "x" * 5000, "日本" * 3000, *_texts(12, 3, 5000)]
    rows = [*enumerate(texts), (None, "null id"), (3, texts[3]), (3, texts[3])]
    got = word_bpe.digests(_frame(spark, rows), PATH, leaf=64, part=200).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *_expected(library, t))) for i, t in rows)


def test_round_trip_of_ids_and_empty_tables(spark, library):
    rows = list(enumerate(["Hello there", None, "it's <|endoftext|> 12", "y" * 900]))
    found = word_bpe.encoded(_frame(spark, rows), PATH, leaf=32, part=128).select("row.doc_id", "out.ids")
    back = word_bpe.decoded(found.withColumn("text", F.lit("own text")), PATH).select("row.doc_id", "out.text").collect()
    want = {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows}
    assert dict(map(tuple, back)) == want
    assert word_bpe.digests(_frame(spark, rows).limit(0), PATH).collect() == []
    assert word_bpe.decoded(found.selectExpr("doc_id", "cast(null AS array<int>) AS ids"), PATH).select("out.text").distinct().collect()[0][0] is None
