import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelgrove.llm import tokenise

pytestmark = pytest.mark.skipif(not os.path.exists(tokenise.VOCABULARY), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def peer():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenise.PATTERN, mergeable_ranks=tokenise.encoder().ranks, special_tokens={})


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_same_ids_as_a_public_encoder(text):
    import tiktoken

    encoder = tokenise.encoder()
    peer = tiktoken.Encoding("own", pat_str=tokenise.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    assert encoder.encode(text) == peer.encode_ordinary(text)


def test_every_vocabulary_entry_merges_to_itself():
    encoder = tokenise.encoder()
    for key, rank in random.Random(1).sample(sorted(encoder.ranks.items()), 3000):
        assert encoder.merge(key) == (rank,)


@given(st.sets(st.binary(max_size=12), min_size=1, max_size=300), st.binary(max_size=12))
@settings(max_examples=60, deadline=None)
def test_perfect_hash_is_minimal_and_exact(keys, other):
    keys = sorted(keys)
    h = tokenise.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(len(keys)))
    assert sorted(h.ids) == list(range(len(keys)))
    if other not in keys:
        assert h.get(other) == -1


def test_nulls_empties_repeats_and_clashing_columns(spark, peer):
    long = "ab" * 60_000 + " é連結軸" * 50
    texts = [None, "", " ", "a b", "a b", "<|endoftext|>", "�\x00x", long]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, ids string")
    got = {r.doc_id: r.ids for r in tokenise.token_ids(df).collect()}
    assert got == {i: peer.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in tokenise.token_counts(df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_round_trip(spark, peer):
    texts = ["Schön, 図5に示すように — 3.7 cm\n\n  x", "\ttabs \r\n and  blanks  "]
    for t in texts:
        assert peer.decode(tokenise.encoder().encode(t)) == t


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokenise.token_ids(df).collect() == [] and tokenise.token_counts(df).collect() == []
