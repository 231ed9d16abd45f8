import itertools
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelgrove.llm import sampling


@given(st.lists(st.floats(0, 1), max_size=60), st.integers(0, 2**32 - 1))
@settings(max_examples=200, deadline=None)
def test_flight_keeps_the_sum_and_decides_all_but_one(p, seed):
    p = np.array(p)
    p[p < 1e-6] = 0
    p[p > 1 - 1e-6] = 1
    out = sampling.flight(p, np.random.default_rng(seed).random(len(p)))
    assert abs(out.sum() - p.sum()) < 1e-6
    assert ((out > 0) & (out < 1)).sum() <= 1
    assert (out[p == 0] == 0).all() and (out[p == 1] == 1).all()


def test_flight_draws_everyone_at_their_probability():
    rng, p = np.random.default_rng(1), np.array([0.2, 0.7, 0.5, 0.9, 0.7])
    hits = sum(sampling.flight(p, rng.random(5)) for _ in range(4000)) / 4000
    assert np.allclose(hits, p, atol=0.04)


RECORDS = "rec_id bigint, batch_id int, outcome string, drawn int"
TARGETS = "batch_id int, outcome string, target_pct int, n_wanted int, min_rows int"


def test_draw(spark):
    rows = [(i, 1, "Other" if i % 3 else " head", 0) for i in range(3000)] + [(i, 1, "Other", 0) for i in range(0, 3000, 100) if i % 3]
    rows += [(5000 + i, 2, "Neck\t", 0) for i in range(5)] + [(6000, 2, None, 0), (6001, None, "Head", 0), (6002, 3, "Head", 0), (None, 2, "Neck", 0)]
    targets = [(1, "Other", 37, 150, 0), (1, "Other", 37, 150, 0), (1, "Head", 20, 150, 40), (2, "Neck", 50, 20, 0), (2, "Head", 10, 20, 0), (4, "Other", 1, 100, 0), (None, "Head", 1, 1, 1), (1, None, 9, 9, 9), (1, "Neck", None, 5, 0)]
    sample, report = sampling.draw(spark.createDataFrame(rows, RECORDS).repartition(5), spark.createDataFrame(targets, TARGETS), seed=3)
    got = sample.collect()
    assert len({r.rec_id for r in got}) == len(got)
    n = Counter((r.batch_id, r.outcome) for r in got)
    assert n[1, "Head"] == 40 and n[1, "Other"] in (55, 56) and n[2, "Neck"] == 5 and len(n) == 3
    said = {(r.batch_id, r.outcome): (r.available, r.drawn, r.short) for r in report.collect()}
    assert said[2, "Neck"] == (5, 5, True) and said[2, "Head"] == (0, 0, True) and said[4, "Other"] == (0, 0, True)
    assert said[1, "Head"] == (1000, 40, False)
    assert all(abs(r.residual) < 1 for r in report.collect())
    assert {k for k, v in said.items() if v[2]} == {(2, "Neck"), (2, "Head"), (4, "Other")}


def test_empty(spark):
    sample, report = sampling.draw(spark.createDataFrame([], RECORDS), spark.createDataFrame([(1, "Head", 10, 100, 0)], TARGETS))
    assert sample.collect() == [] and report.collect()[0].short
    sample, report = sampling.draw(spark.createDataFrame([(1, 1, "Head", 0)], RECORDS), spark.createDataFrame([], TARGETS))
    assert sample.collect() == [] and report.collect() == []


def test_a_batch_draws_what_it_wants_in_all(spark):
    outcomes = ("Other", "Head", "Neck", "Sternum")
    have = {1: (900, 200, 200, 0), 2: (900, 60, 5, 0), 3: (900, 500, 500, 0), 4: (30, 30, 30, 30), 5: (20, 10, 0, 0), 6: (500, 500, 0, 0)}
    rows = [(b * 10000 + k * 1000 + i, b, o, 0) for b, n in have.items() for k, o in enumerate(outcomes) for i in range(n[k])]
    targets = [
        (1, "Other", 80, 200, 0), (1, "Head", 10, 200, 60), (1, "Neck", 10, 200, 40),  # minima above the shares: Other gives 60
        (2, "Other", 50, 200, 0), (2, "Head", 30, 200, 0), (2, "Neck", 20, 200, 0),  # Neck has 5 of 40: the others take 35
        (3, "Other", 40, 100, 0), (3, "Head", 30, 100, 0),  # 30 % left to Neck
        (4, "Other", 50, 40, 30), (4, "Head", 50, 40, 30),  # minima exceed n_wanted
        (5, "Other", 50, 100, 0), (5, "Head", 50, 100, 0),  # not enough records
        (6, "Other", 40, 100, 0), (6, "Head", 40, 100, 0), (6, "Sternum", 20, 100, 0),  # none of Sternum: the others take its share
    ]
    records, targets = spark.createDataFrame(rows, RECORDS).repartition(5), spark.createDataFrame(targets, TARGETS)
    sample, report = sampling.draw(records, targets, seed=3)
    n = Counter((r.batch_id, r.outcome) for r in sample.collect())
    assert Counter(b for b, _ in n.elements()) == {1: 200, 2: 200, 3: 100, 4: 60, 5: 30, 6: 100}
    assert n == {(1, "Other"): 100, (1, "Head"): 60, (1, "Neck"): 40, (2, "Other"): 135, (2, "Head"): 60, (2, "Neck"): 5, (3, "Other"): 40, (3, "Head"): 30, (3, "Neck"): 30, (4, "Other"): 30, (4, "Head"): 30, (5, "Other"): 20, (5, "Head"): 10, (6, "Other"): 50, (6, "Head"): 50}
    said = {(r.batch_id, r.outcome): r for r in sampling.balance(sample, targets).collect()}
    assert {k: r.drawn for k, r in said.items() if r.drawn} == n and said[1, "Other"].drawn_pct == 50.0 and said[1, "Other"].target_pct == 80.0
    assert said[3, "Neck"].target_pct is None and (said[4, "Head"].n_wanted, said[4, "Head"].batch_drawn) == (40, 60)
    assert {(r.batch_id, r.outcome) for r in report.where("short").collect()} == {(2, "Neck"), (5, "Other"), (5, "Head"), (6, "Sternum")}
    assert {r.residual for r in report.collect() if r.batch_id == 1} == {-60.0, 0.0}


def test_a_rest_from_rounding_draws_nothing_from_outcomes_without_target(spark):
    outcomes = ("Other", "LeftShoulder", "RightShoulder", "Head", "Sternum", "Neck")
    goals = ((32, 0), (26, 10), (24, 5), (8, 30), (6, 10))  # 4 % are left open, but the minima take them
    rows = [(k * 1000 + i, 1, o, 0) for k, o in enumerate(outcomes) for i in range(100)]
    targets = spark.createDataFrame([(1, o, p, 100, low) for o, (p, low) in zip(outcomes, goals, strict=False)], TARGETS)
    pct, low = (np.array(x, float) for x in zip(*goals, (0, 0), strict=True))
    for at in itertools.permutations(range(6)):  # sums depend on the order of the cells
        size = sampling.cell_sizes(pct[list(at)], low[list(at)], np.full(6, 100.0), 100.0, np.array(at) < 5)
        assert size[at.index(5)] == 0 and abs(size.sum() - 100) < 1e-9
    sample, report = sampling.draw(spark.createDataFrame(rows, RECORDS), targets)
    n = Counter(r.outcome for r in sample.collect())
    assert sum(n.values()) == 100 and n["Neck"] == 0 and n["Head"] == 30 and report.where("short").count() == 0


def test_the_sample_is_the_same_however_records_are_stored(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK_ROWS", 60)  # several blocks per cell
    records = spark.createDataFrame([(i * 7, i % 2, ("Head", "Neck", "Other")[i % 3], 0) for i in range(1500)], RECORDS)
    targets = spark.createDataFrame([(b, o, p, 77, 0) for b in (0, 1) for o, p in (("Head", 31), ("Neck", 42), ("Other", 27))], TARGETS)
    drawn = [sorted(map(tuple, sampling.draw(df, targets)[0].collect())) for df in (records.coalesce(1), records.repartition(7), records.orderBy("outcome", "rec_id").union(records))]
    assert drawn[0] == drawn[1] == drawn[2] and Counter(r[0] for r in drawn[0]) == {0: 77, 1: 77}
    assert [r.met for r in sampling.totals(records, targets).collect()] == [True, True]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 60), st.integers(0, 200)), min_size=1, max_size=6), st.integers(0, 400))
@settings(max_examples=200, deadline=None)
def test_cells_fill_up_to_the_goal(cells, goal):
    weight, low, high = (np.array(c, float) for c in zip(*cells, strict=True))
    s, least = sampling.fill(weight, low, high, goal), np.minimum(low, high)
    most = np.where(weight > 0, high, least).sum()
    assert (s >= least - 1e-9).all() and (s <= high + 1e-9).all()
    assert abs(s.sum() - min(max(goal, least.sum()), max(most, least.sum()))) < 1e-6
