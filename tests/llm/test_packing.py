from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelgrove.llm import packing


def filled(intervals, used, capacity):
    load, seen = Counter(), Counter()
    for length, first, last, container, each in intervals:
        for i in range(last - first):
            load[container + i // each] += length
        assert first == seen[length]
        seen[length] = last
    assert not load or max(load.values()) <= capacity
    assert len(load) == used and set(load) == set(range(used))
    return load, seen


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=30), st.integers(64, 90), st.integers(1, 100))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_item_within_capacity(histogram, capacity, bins):
    intervals, used = packing.plan(histogram, capacity, min(bins, 24) if bins < 90 else bins)
    _, seen = filled(sorted(intervals), used, capacity)
    assert seen == Counter(histogram)


def test_little_space_is_left():
    rng = np.random.default_rng(3)
    sizes, counts = np.unique(np.clip(rng.lognormal(6.7, 0.7, 100_000).astype(int), 1, 8192), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    _, used = packing.plan(histogram)
    assert used <= 1.01 * -(-int((sizes * counts).sum()) // 8192)
    full, rest = packing.filled(histogram)
    assert sum(g[0] for g in full) > sum(g[0] for g in rest)  # patterns do most of it
    assert used <= 1.001 * packing.plan(histogram, rounds=0)[1]  # as good as best fit, which is near the bound here


def test_nnls_solves_and_stays_non_negative():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 30)), np.maximum(0, rng.normal(size=30))
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_plan_refuses_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.plan({0: 1}, 8)
    assert packing.plan({}) == ([], 0)


def test_pack_rows(spark):
    # a hot length, equal keys, nulls, zeros, items over the capacity, an extra column named as a result column
    sizes = [(i, 7) for i in range(400)] + [(500, 3), (500, 3), (501, None), (502, 0), (503, 100), (504, 101), (505, 250), (None, 9)]
    df = spark.createDataFrame([(k, n, 1) for k, n in sizes], "doc_id bigint, n_tokens bigint, container_id int")
    rows = packing.pack(df, capacity=100, blocks=3).collect()
    load = Counter()
    for r in rows:
        load[r.container_id] += r.n_tokens
    assert max(load.values()) <= 100
    assert sum(load.values()) == sum(n or 0 for _, n in sizes)
    assert len(load) <= 1.1 * -(-sum(load.values()) // 100)
    pieces = Counter(r.doc_id for r in rows)
    assert pieces[504] == 2 and pieces[505] == 3 and pieces[503] == 1 and pieces[501] == pieces[502] == 0 and pieces[500] == 2 and pieces[None] == 1
    assert sorted(r.n_tokens for r in rows if r.doc_id == 505) == [50, 100, 100]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(df).collect() == []
    report = packing.fill_report(packing.pack(df)).collect()[0]
    assert report["items"] == report.containers == 0 and report.unused_share is None
