"""The pipeline's stages, each on what the one before left, against plain loops."""

import collections

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from bookweir.llm import bpe, quality
from bookweir.llm.work import settle
from tests.llm import brute

OPERATORS = 10


@pytest.fixture(scope="module")
def left(spark, folder):
    """Rows after each stage, the documents first."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(settle(stage(spark, found[-1], folder)))
    return [df.collect() for df in found]


def test_every_operator_has_its_query():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, OPERATORS + 1)) and "pipeline" in names


def test_all_but_the_last_return_documents(left):
    assert all(rows[0].__fields__ == left[0][0].__fields__ for rows in left[:-1])


def test_rules_drop_what_fails_the_base(left):
    good = {r.doc_id for r in left[1]}
    assert all(not brute.quality_figures(r.text)["base_failed"] for r in left[1])
    dropped = [r for r in left[0] if r.doc_id not in good]
    assert 0 < len(dropped) < len(left[0]) and len(good) == len(left[1])


def test_one_of_equal_texts_stays(left):
    groups = collections.defaultdict(list)
    for r in left[1]:
        groups[brute.lowered(r.text)].append(r.doc_id)
    assert sorted(r.doc_id for r in left[2]) == sorted(max(ids) for ids in groups.values())


def test_one_of_near_copies_stays(left):
    found = brute.near_components({r.doc_id: r.text for r in left[2]})
    assert sorted(r.doc_id for r in left[3]) == sorted({c for _, c in found.values()})


def test_mix_is_near_its_targets(left):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in left[3]:
        sizes[r.source] += len(brute.words(r.text))
    for r in left[4]:
        taken[r.source] += len(brute.words(r.text))
    largest = max(len(brute.words(r.text)) for r in left[3])
    assert all(abs(taken[s] - t) <= largest for s, t in brute.targets(sizes).items())
    assert max(collections.Counter(r.doc_id for r in left[4]).values()) <= 2


def test_ids_are_the_library_s(left):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in left[0]}
    assert len(left[5]) == len(left[4])
    assert all(list(r.ids) == own.encode_ordinary(texts[r.doc_id]) for r in left[5])


def test_run_gives_the_same_rows(spark, folder, left):
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(
        (r.doc_id, r.n_tokens) for r in left[5]
    )


def test_rules_run_in_an_order_from_the_sample(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r.name for r in quality.ordered_rules(docs)} == {r.name for r in quality.RULES}
