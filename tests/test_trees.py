import random
from collections import Counter

import numpy as np
import pytest

from pixelgrove.operators import forest, stats
from pixelgrove.plans import core_queries, train
from pixelgrove.schema import Settings

FEATURES = ["f0", "f1", "f2"]


def rows(n=200, seed=0, top=12):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = [rng.randrange(top) for _ in FEATURES]
        label = "abc"[(x[0] > 5) + (x[1] > 8)] if rng.random() < 0.9 else rng.choice("abc")
        out.append((*x, label))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "f0 int, f1 int, f2 int, label string")


def gini(labels):
    n = len(labels)
    return 1 - sum(c * c for c in Counter(labels).values()) / (n * n) if n else 0


def candidates(data, op):
    n, whole = len(data), gini([r[-1] for r in data])
    for f in range(len(FEATURES)):
        for v in sorted({r[f] for r in data}):
            a = [r[-1] for r in data if (r[f] <= v if op == "le" else r[f] < v)]
            b = [r[-1] for r in data if not (r[f] <= v if op == "le" else r[f] < v)]
            if a and b:
                yield f, v, len(a), len(b), whole - len(a) / n * gini(a) - len(b) / n * gini(b)


def slow_tree(data, s, depth=0):
    """Plain recursion, one record at a time."""
    labels = [r[-1] for r in data]
    best = None
    if len(data) > s.min_node and gini(labels) > s.min_impurity and depth < s.max_depth:
        for c in candidates(data, s.op):
            q = int(c[4] * 1e6 + 1e-7)
            if c[4] > 1e-12 and (best is None or q > best[0] or (q == best[0] and s.tie == "last")):
                best = (q, c[0], c[1])
    if best is None:
        return tuple((k, round(v / len(labels), 9)) for k, v in sorted(Counter(labels).items()))
    _, f, v = best
    yes = lambda r: r[f] <= v if s.op == "le" else r[f] < v
    return f, v, slow_tree([r for r in data if yes(r)], s, depth + 1), slow_tree([r for r in data if not yes(r)], s, depth + 1)


def shaped(nodes, k=1):
    r = {x["node_id"]: x for x in nodes}[k]
    if r["kind"] == "R":
        return tuple((x["outcome"], round(x["probability"], 9)) for x in r["results"])
    return r["feature"], r["ref_val"], shaped(nodes, r["true_id"]), shaped(nodes, r["false_id"])


@pytest.mark.parametrize("op", ["le", "lt"])
def test_gains_equal_those_of_trying_every_record(spark, op):
    data = rows(120)
    got = {(r.feature, r.value): (r.n_true, r.n_false, round(r.gain, 9)) for r in stats.candidate_gains(stats.candidate_counts(frame(spark, data), FEATURES, "abc"), 3, op=op).collect()}
    assert got == {(f, v): (a, b, round(g, 9)) for f, v, a, b, g in candidates(data, op)}
    assert all(g[2] >= 0 for g in got.values())


@pytest.mark.parametrize("s, local", [(Settings(min_node=10), 10**6), (Settings(op="lt", min_node=20, tie="first"), 60), (Settings(min_node=5, max_depth=3), 0)])
def test_tree_equals_recursion(spark, s, local):
    data = rows(150, 3)
    nodes = train.grow(frame(spark, data), FEATURES, settings=s, cut_every=2, local_rows=local)
    assert shaped(nodes) == slow_tree(data, s)
    assert [r["node_id"] for r in nodes] == list(range(1, len(nodes) + 1))


def test_contradictory_records_end(spark):
    for local in (0, 10):
        nodes = train.grow(frame(spark, [(1, 1, 1, "a"), (1, 1, 1, "b")]), FEATURES, local_rows=local)
        assert shaped(nodes) == (("a", 0.5), ("b", 0.5))


def test_nothing_to_learn_from(spark):
    for data in ([], [(1, 2, 3, None)]):
        nodes = train.grow(frame(spark, data), FEATURES)
        assert len(nodes) == 1 and nodes[0]["results"] == []
    assert shaped(train.grow(frame(spark, [(None, None, None, "a"), (1, None, 2, "b")]), FEATURES, settings=Settings(min_node=1))) in ((("a", 0.5), ("b", 0.5)),)


def test_evaluation_as_case_and_as_arrays(spark, monkeypatch):
    data = rows(100, 5)
    df = frame(spark, [*data, (None, None, None, "a")])
    nodes = train.grow(frame(spark, data), FEATURES, settings=Settings(min_node=3))
    case = [r.leaf_id for r in forest.evaluate(df, nodes, FEATURES).collect()]
    monkeypatch.setattr(forest, "CASE_NODES", 1)
    assert [r.leaf_id for r in forest.evaluate(df, nodes, FEATURES).collect()] == case
    by = {r["node_id"]: r for r in nodes}
    for record, leaf in zip(data, case, strict=False):
        k = 1
        while by[k]["kind"] == "D":
            k = by[k]["true_id"] if record[by[k]["feature"]] <= by[k]["ref_val"] else by[k]["false_id"]
        assert k == leaf


def test_votes_and_accuracies(spark):
    leaf = lambda *r: [{"tree_id": "t", "node_id": 1, "kind": "R", "ref_val": None, "feature": None, "true_id": None, "false_id": None, "results": [{"outcome": o, "probability": p} for o, p in r]}]
    df = frame(spark, [(1, 1, 1, "a"), (1, 1, 1, "b")])
    assert {r.vote for r in forest.vote(df, [leaf(("b", 0.5), ("a", 0.5)), leaf(("c", 0.5))], FEATURES).collect()} == {"a"}
    assert {r.vote for r in forest.vote(df, [leaf()], FEATURES).collect()} == {""}
    with_results = forest.with_results(df, leaf(("a", 0.4), ("b", 0.6)), FEATURES)
    assert forest.accuracy_lenient(with_results).collect()[0].accuracy == 1.0 and forest.accuracy_first(with_results).collect()[0].accuracy == 0.5


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, None), (3, "d")], "g int, label string")
    assert {r.g: round(r.impurity, 6) for r in stats.gini(df, by=("g",)).collect()} == {1: 0.444444, 2: 0.5, 3: 0.0}
    assert {r.g: r.is_pure for r in stats.purity(df, by=("g",)).collect()} == {1: False, 2: False, 3: True}
    empty = stats.gini(df.limit(0)).collect()[0]
    assert empty.n == 0 and empty.impurity is None
    results = {r.g: [(x.outcome, x.probability) for x in r.results] for r in stats.leaf_distribution(df, by=("g",)).collect()}
    assert results[2] == [("c", 1.0)] and abs(sum(p for _, p in results[1]) - 1) < 1e-12


def test_structure(spark):
    nodes = train.grow(frame(spark, rows(100, 8)), FEATURES, settings=Settings(min_node=10))
    df = train.nodes_table(spark, nodes)
    paths = {r.node_id: r.path for r in forest.node_depths(df).collect()}
    assert [k for k, _ in sorted(paths.items(), key=lambda x: x[1])] == [r["node_id"] for r in nodes]
    assert forest.tree_depth(df).collect()[0].depth == 1 + max(map(len, paths.values()))
    assert forest.unlinked(df).count() == 0 and forest.unlinked(df.where("node_id < 3")).count() >= 1
    with pytest.raises(ValueError):
        forest.preorder([nodes[0] | {"kind": "D", "true_id": 1, "false_id": 1}])


def test_registered_tree_grows_until_nothing_is_left_to_split(spark, tmp_path):
    records = [(i, 0, 0, "s", "train", "Head" if i % 2 else "Neck", 0, *([i] + [0] * 25)) for i in range(60)]
    cells = ", ".join(f"f{i} int" for i in range(26))
    spark.createDataFrame(records, f"rec_id bigint, image int, batch_id int, sensor_id string, data_split string, outcome string, label int, {cells}").write.parquet(f"{tmp_path}/records.parquet")
    nodes = {r.node_id: r for r in core_queries.train_tree(spark, str(tmp_path)).collect()}
    assert {tuple(x.probability for x in r.results) for r in nodes.values() if r.kind == "R"} == {(1.0,)}
    depth = lambda k: 1 + max(depth(nodes[k].true_id), depth(nodes[k].false_id)) if nodes[k].kind == "D" else 0
    assert len(nodes) == 119 and depth(1) > 8


@pytest.mark.parametrize("op, tie", [("le", "last"), ("lt", "first")])
def test_both_searches_of_a_node_agree(op, tie, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(-5, 12, (300, 4)).astype(float), rng.integers(0, 3, 300)
    x[rng.random(x.shape) < 0.15] = np.nan
    s = Settings(op=op, tie=tie)
    at_once = train.subtree(x, y, 3, 0, s)
    monkeypatch.setattr(train, "AT_ONCE", 0)
    again = train.subtree(x, y, 3, 0, s)
    assert len(at_once[0]) > 100 and all(np.array_equal(a, b) for a, b in zip(at_once, again, strict=True))


@pytest.mark.parametrize("local", [0, 25, 10**6])
def test_options_of_the_trainer(spark, local):
    data = rows(120, 7)
    nodes = train.grow(frame(spark, data), FEATURES, settings=Settings(min_impurity=0.0, min_node=1, least_gain="quantised"), local_rows=local)
    assert shaped(nodes) == slow_tree(data, Settings(min_impurity=0.0))  # gains under a millionth don't occur here
    few = train.grow(frame(spark, data), FEATURES, settings=Settings(least_gain="quantised", quantum=1.0), local_rows=local)
    assert len(few) == 1  # no gain reaches 1
    named = frame(spark, [(x, 0, 0, "Head" if i % 2 else "LeftShoulder" if i % 3 else "Neck") for i, x in enumerate([1] * 12)])
    results = lambda s: [r["outcome"] for r in train.grow(named, FEATURES, settings=s, local_rows=local)[0]["results"]]
    assert results(Settings()) == ["Head", "LeftShoulder", "Neck"] and results(Settings(leaf_order="code")) == ["LeftShoulder", "Head", "Neck"]
    with pytest.raises(ValueError):
        Settings(leaf_order="size")


def test_training_from_ordered_columns(spark):
    data = rows(90, 9)
    wide = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "rec_id bigint, f0 int, f1 int, f2 int, label string")
    again = train.from_ordered(stats.long_cells(wide, FEATURES, ("rec_id",)), wide.select("rec_id", "label"), 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wide.collect()))
    assert train.grow(again, FEATURES, settings=Settings(min_node=9)) == train.grow(wide, FEATURES, settings=Settings(min_node=9), local_rows=10)
