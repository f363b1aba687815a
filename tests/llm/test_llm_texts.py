"""Tokenizers, language ID, PII, main text and LM scores against libraries and plain loops."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from bookweir.llm import bpe, ctw, langid, lm, main_text, pii, spans, token_counts
from bookweir.llm.work import utf8
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "'s", "'re", "'", "'ll", "'t", " ", "  ", "\n", "\t", "a", "Bc", "é", "1", "23", "½", "!", "##", "　", "́", "漢字",
    "​", "\x1c", "\x85", "'v", "'S", "😀", " ", ".", "\r\n", "the cat", "x,y", "don't", "İ", "ẞ", "Å",
]
SPECIAL = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<"]


def _texts(seed: int, n: int, extra=()) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices([*PIECES, *extra], k=rng.randint(0, 40))) for _ in range(n)]


def _frame(spark, rows, schema="doc_id long, text string"):
    frame = spark.createDataFrame(rows, schema)
    for name in ("row", "out", "ids", "key", "score", "email", "one", "found", "bytes"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_ids_are_the_library_s_and_decode_back(spark, encoding):
    texts = _texts(1, 1500) + ["a" * 3000, "ab " * 20_000, "!?" * 700]
    rows = [*enumerate(texts), (9000, None), (9001, ""), (5, texts[5])]
    by_id = dict(rows)
    got = bpe.encoded(_frame(spark, rows), RANKS, keep=["doc_id"]).select("row.doc_id", "out.*").collect()
    assert len(got) == len(rows)
    for r in got:
        text = by_id[r.doc_id] or ""
        want = encoding.encode_ordinary(text)
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        widths = [len(encoding.decode_single_token_bytes(i)) for i in want]
        assert list(r.starts) == np.cumsum([0, *widths])[:-1].tolist()
    frame = spark.createDataFrame([(r.doc_id, list(r.ids)) for r in got], "doc_id long, ids array<int>")
    assert all(bytes(r.bytes) == (by_id[r.doc_id] or "").encode() for r in bpe.decoded(frame, RANKS).collect())


def test_bpe_digests(spark, encoding):
    rows = [*enumerate(_texts(2, 200)), (900, None)]
    for r in bpe.digests(_frame(spark, rows), RANKS).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_classes_of_all_codepoints(encoding):
    merger = bpe.Merger(RANKS)
    texts = ["a" + chr(c) + "1 " + chr(c) + "'s" for c in range(0, 0x11000) if not 0xD800 <= c < 0xE000]
    ids, number, _, first = bpe._pieces(pa.array(texts), merger)
    got = [[i for k in number[a:b].tolist() for i in ids[k]] for a, b in zip(first[:-1], first[1:])]
    assert got == [encoding.encode_ordinary(t) for t in texts]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(WORD_BPE)


def test_token_counts(spark, counter):
    texts = _texts(3, 800, SPECIAL) + ["word " * 30_000, "x" * 150_000, "é" * 70_000 + " a b " * 20_000]
    rows = [*enumerate(texts), (9000, None), (9001, ""), (5, texts[5])]
    want = [len(x) for x in counter.tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    by_id = {i: (len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, want)}
    got = token_counts.counts(_frame(spark, rows), WORD_BPE).collect()
    assert len(got) == len(rows)
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == by_id[r.doc_id] for r in got)


@pytest.mark.parametrize("chunk, overlap", [(40, 3), (64, 8), (300, 16)])
def test_spliced_chunks_give_the_count_of_the_whole(counter, chunk, overlap):
    texts = _texts(4, 150, SPECIAL) + ["a" * 500, "a " * 300, "ab " * 5 + "c" * 400 + " d" * 40]
    for text, one in zip(texts, counter.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert token_counts.count_long(text, counter.model, chunk, overlap) == len(one), text


def test_an_overlap_widens_where_the_chunks_do_not_agree(counter, monkeypatch):
    """The overlap lies in one long word: no place there is stable until it reaches past it."""
    text = "some words first " * 20 + "etaoin" * 60 + " and some after it" * 30
    encoded, encodings = [], counter.model.encodings
    monkeypatch.setattr(counter.model, "encodings", lambda texts: encoded.extend(texts) or encodings(texts))
    want = len(counter.tokenizer.encode(text, add_special_tokens=False))
    assert token_counts.count_long(text, counter.model, 400, 8) == want
    overlaps = [len(b) for a, b in zip(encoded, encoded[1:])]
    assert len(encoded) > -(-len(text) // 392) and max(overlaps) >= 400  # more chunks than without widening


def test_another_tokenizer_file_is_counted_by_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = _texts(6, 60, SPECIAL) + ["x" * 9000, "many words in a row " * 900]
    from tokenizers import Tokenizer

    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert not token_counts.Counter(path).by_word
    got = {r.doc_id: r.n_tokens for r in token_counts.counts(_frame(spark, list(enumerate(texts))), path).collect()}
    assert [got[i] for i in range(len(texts) - 2)] == want[:-2]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_of_odd_rows(spark):
    rows = [(k, t, l) for k, (t, l) in enumerate([("the cat sat", "en"), ("le chat assis", "fr"), ("x", None), (None, "en"), ("123 !", "en"), ("", "fr")] * 6)]
    got = langid.languages(_frame(spark, rows, "doc_id long, text string, lang string")).collect()
    by_id = {k: t for k, t, _ in rows}
    for r in got:
        assert r.lang_pred == "und" if not any(map(str.isalpha, by_id[r.doc_id] or "")) else r.lang_pred in ("en", "fr")
    none = _frame(spark, [(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.languages(none).collect()] == [("und", 0.0)]


def test_bayes_by_hand(spark):
    """Posterior from counts of the same n-grams, summed in plain Python."""
    rows = [(k, t, l) for k, (t, l) in enumerate([("aab", "x"), ("abb ab", "y"), ("ba", "x"), ("bb", "y")])]
    names, matrix = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sums = {n: np.zeros(langid.BUCKETS) for n in ("x", "y")}
    for _, text, lang in rows:
        for row in langid.ngrams(pa.array([text]))[0]:
            np.add.at(sums[lang], row, 1)
    for k, name in enumerate(names):
        want = np.log((sums[name] + langid.SMOOTHING) / (sums[name] + langid.SMOOTHING).sum())
        assert np.allclose(matrix[:-1, k], want)


def test_base_spans(spark):
    rng = random.Random(6)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", "_", "1", "12", "255", "256", "1.2.3.4", "+", "+1 (", "4111 1111 1111 1111", "411111111111111", " ", "😀é", "\n", "(", "%"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for k in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "1.2.3.4 " * 2000), (5003, "a@" * 20_000), (5004, "1" * 50_000), (5005, "+1" + "." * 50_000), (7, rows[7][1])]
    texts = dict(rows)
    got = pii.span_digests(_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute.pii_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in brute.PATTERNS]


def test_terms_that_give_an_entity_away(spark):
    said = [(k, f"filler{k} {'abcd'[k % 4]} {k}. Please ask Zorvath at zed@corp.example.com about{k} ok") for k in range(8)]
    plain = [(100 + k, f"plain text {k}, please ask about things at home") for k in range(60)]
    copies = [(200 + k, "Only Quellin here: quell@corp.example.com") for k in range(9)]
    got = {r.doc_id: r for r in pii.span_digests(_frame(spark, said + plain + copies)).collect()}
    for k, text in said:
        terms = [s for s in got[k].spans.split(",") if s.startswith("term:")]
        assert terms == [f"term:{text.index('Zorvath')}:{text.index('Zorvath') + 7}"]
    assert all(got[k].spans == "" for k, _ in plain)
    assert not any("term" in got[k].spans for k, _ in copies)  # copies of one surrounding are no evidence
    clean = {r.doc_id: r.text for r in pii.sanitised(_frame(spark, said + plain)).collect()}
    assert clean[0] == "filler0 a 0. Please ask  at <EMAIL> about0 ok" and clean[100] == plain[0][1]


def _terms(spark, rows) -> dict[int, list[str]]:
    texts, got = dict(rows), pii.span_digests(_frame(spark, rows)).collect()
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s.startswith("term:")] for r in got}
    return {k: [texts[k][int(a) : int(b)] for _, a, b in found] for k, found in spans.items()}


def test_terms_need_no_number_of_surroundings(spark):
    signed = [(k, f"letter{k} number{k}\nOlbrin olb@corp.example.com") for k in range(9)]  # one line in different texts
    twice = [(20 + k, f"first{k} Merrow mer@corp.example.com last{k}") for k in range(2)]
    shared = [(30 + k, f"some{k} Dunstan dun@corp.example.com") for k in range(3)] + [(40 + k, f"Dunstan went{k}") for k in range(30)]
    got = _terms(spark, signed + twice + shared + [(100 + k, f"plain text {k}") for k in range(60)])
    assert all(("Olbrin" in got[k]) == (k < 9) for k in got)
    assert [got[k] for k in (20, 21)] == [["Merrow"]] * 2
    assert all("Dunstan" not in found for found in got.values())  # mostly elsewhere


def test_terms_stand_anywhere_in_the_text(spark):
    far = "came. Later on, " + "and after much plain text " * 10
    forms = ["Zorvath <@>", "Zorvath (@)", "@, Zorvath", "Zorvath:@", "Zorvath\nMail:@", f"Zorvath {far}\n@", f"@ {far} Zorvath"]
    rows = [(k, f"own{k} " + form.replace("@", "zed@corp.com")) for k, form in enumerate(forms)]
    rows += [(20 + k, f"own{k + 20} 李明\nand Li on 10.9.8.7") for k in range(3)]
    rows += [(30 + k, f"own{k + 30} Quill quill@corp.org") for k in range(3)]
    rows += [(100 + k, f"Mail {far} {k}") for k in range(60)]
    got = _terms(spark, rows)
    assert all(got[k] == ["Zorvath"] for k in range(len(forms)))
    assert all(got[20 + k] == ["李明", "Li"] and got[30 + k] == ["Quill"] for k in range(3))  # no part of an address
    assert all(got[100 + k] == [] for k in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitised(_frame(spark, rows)).collect()}
    assert clean[0] == "own0  <<EMAIL>>" and clean[20] == "own20 \nand  on <IP>" and clean[30] == "own30  <EMAIL>"


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>"</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice">We use cookies on this site, as all others do, to know who you are.</div>
<header class="site-header"><h1>The site</h1></header><div class="ad">Buy this now, it is cheap and good and yours for ever.</div>
<article><h1>Of cats &amp; dogs</h1><p><b>One  paragraph<br>of   text &lt;here&gt; <a href=x>and a link</a>.<p>Short.</p><p>&eacute;t&eacute;&nbsp;fin &#8217;</p>
<div class="related"><ul><li><a href=1>Other story</a><li><a href=2>Another</a></ul></div></article>
<section id="comments"><article class="comment"><p>I read this with much joy and have a lot to say about it, which I do here.</p></article></section>
<form><label>Mail</label><input><button>Send</button></form><aside><p>Some words at the side that are long enough to be taken for text by their number.</p></aside>
<footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<script>x"), (1, "u", PAGE), (6, "u", "<div>" * 20_000 + "</p>" * 20_000 + "<!--" * 9_000)]
    frame = _frame(spark, rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text.main_texts(frame).collect()}
    assert got[1].text == "Of cats & dogs\nOne paragraph of text <here> and a link.\nShort.\nété fin ’"
    assert got[1].n_chars == len(got[1].text)
    assert all((got[k].text, got[k].n_chars) == ("", 0) for k in (2, 3, 5))
    assert main_text.main_texts(frame).count() == len(rows)


def _article(page):
    """Lines of the article of a test page, by plain patterns."""
    inside = page[page.index("<article>") : page.index("</article>")]
    lines = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br" in line else "", line)).split()) for line in re.split("</?(?:p|h1|article)>", inside)]
    return [line for line in lines if line]


def test_pages_made_from_documents(spark):
    """The text of a page is its article, line by line."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = main_text.extract(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.out.text == "\n".join(_article(r.row.html)) and r.out.n_chars == len(r.out.text)


def test_pages_without_known_elements(spark):
    """With all telling elements, classes and ids taken out, words and links of the neighbours decide."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    bare = [re.sub(r' (class|id)="[^"]*"', "", re.sub(r"<(/?)(nav|footer|article)>", r"<\1div>", page)) for page in pages]
    kept = wanted = others = 0
    for r in main_text.extract(_frame(spark, list(enumerate(bare)), "page_id long, html string")).collect():
        expected, found = Counter(_article(pages[r.row.page_id])), Counter(r.out.text.split("\n") if r.out.text else [])
        kept, wanted, others = kept + (expected & found).total(), wanted + expected.total(), others + (found - expected).total()
    assert kept >= 0.97 * wanted and others <= 0.01 * wanted


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="content with-sidebar"><p>@</p></div>', "@"),
        ('<div class="no-comments"><p>@</p></div>', "@"),
        ('<div id="isHidden"><p>@</p></div><div class="sidebar-left"><p>@</p></div>', "@"),
        ('<article><p>@</p><p><a href="x">all of it one link</a></p><p>@</p></article>', "@\nall of it one link\n@"),
        ('<nav><a href="a">A</a></nav><article><p><a href="x">a link first</a></p><p>@</p></article>', "a link first\n@"),
        ('<article><p>@</p><ul><li><a href="1">One</a><li><a href="2">Two</a></ul></article>', "@"),
        ('<p>@</p><div class="reader-comments"><p>@</p></div><div class="site-footer"><p>@</p></div>', "@"),
        ('<div role="main"><p>Hi.</p></div><div class="COOKIE-notice x"><p>@</p></div>', "Hi."),
    ],
)
def test_names_are_whole_names(spark, page, text):
    long = "one paragraph with words enough " * 16
    frame = _frame(spark, [(1, page.replace("@", long))], "page_id long, html string")
    assert main_text.extract(frame).collect()[0].out.text == text.replace("@", long.strip())


def test_context_trees_by_recursion():
    train, other = [b"abracadabra", b"abra abra", b""], [b"abrac", b"zebra", b""]
    depth = 3
    tree = brute.ContextTree(train, depth)

    def grams(texts):
        data, offsets = utf8(pa.array([t.decode() for t in texts]))
        return ctw.grams(data, offsets, depth)

    keys, _ = grams(train)
    more, of = grams(other)
    all_keys, counts = ctw.summed(np.concatenate([keys, more]), np.concatenate([np.ones(len(keys)), np.zeros(len(more))]))
    found, places = ctw.levels(all_keys, counts, depth, 0)
    logs = np.log10(ctw.mixed_chances(found, places)).sum(axis=0)
    got = np.bincount(of, logs[np.searchsorted(all_keys, more)], minlength=len(other))
    assert np.allclose(got, [tree.score(t) for t in other], rtol=1e-9)


def test_text_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_BYTES", 3_000)
    monkeypatch.setattr(lm, "BLOCK_ENTRIES", 50)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lm, "HELD_GRAMS", 100)
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(["The", "cat", "été", "sat", "on\n", f"n{k}"], k=rng.randint(0, 9)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "the cat"), (5, rows[5][1])]
    is_held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    train = [brute.lowered(t) for i, t in rows if not is_held[i]]
    tree = brute.ContextTree(train, 2)
    counts, total = {}, 0
    for t in train:
        for w in [*t.split(), b""]:
            counts[w] = counts.get(w, 0) + 1
            total += 1
    got = lm.text_scores(_frame(spark, rows).repartition(3), depth=2).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        tokens = [*brute.lowered(texts[r.doc_id]).split(), b""]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (is_held[r.doc_id], len(tokens), total)
        assert r.n_known == sum(w in counts for w in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, tree.score(brute.lowered(texts[r.doc_id])), rel_tol=1e-6)


def test_scores_without_training_rows(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = lm.text_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 2, 0, 0)
    assert r.base_score == 0 and math.isclose(r.score, 24 * math.log10(0.5), rel_tol=1e-6)


def test_hashes_tell_spans_apart():
    data = np.frombuffer(b"ab ba aab b a  ab", np.uint8)
    starts, ends, _ = spans.word_spans(data, np.array([0, len(data)]))
    hashes = spans.span_hashes(data, starts, ends)
    words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert len(set(hashes.tolist())) == len(set(words)) and hashes[0] == hashes[-1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, page_id long, url string, html string")
    assert bpe.digests(empty, RANKS).collect() == []
    assert token_counts.counts(empty, WORD_BPE).collect() == []
    assert langid.languages(empty).collect() == []
    assert pii.span_digests(empty).collect() == []
    assert main_text.main_texts(empty).collect() == []
    assert lm.text_scores(empty).collect() == []
