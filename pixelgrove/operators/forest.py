"""Trees as tables and as column expressions: linking, depth, evaluation, voting, accuracy.

A tree becomes one nested CASE that yields the leaf's number and stays inside whole-stage codegen; no shuffle, no join per level. Trees of more
than ``CASE_NODES`` nodes would exceed the size of a generated method and are walked by an Arrow function over arrays instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalar import split_predicate
from ..plans.tables import materialise

CASE_NODES = 1500


def unlinked(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, child_id`` of children that no node of the tree has."""
    children = nodes.where("kind = 'D'").select("tree_id", "node_id", F.explode(F.array("true_id", "false_id")).alias("child_id"))
    known = nodes.select("tree_id", F.col("node_id").alias("child_id"))
    return children.join(known, ["tree_id", "child_id"], "left_anti").select("tree_id", "node_id", "child_id")


def node_depths(nodes: DataFrame, max_depth: int = 200) -> DataFrame:
    """``tree_id, node_id, depth, path``: the root (that no node refers to) has depth 1; sorting by path is preorder.

    One join per level over the node table, which is small (one row per node).
    """
    kids = nodes.where("kind = 'D'").select("tree_id", F.posexplode(F.array("true_id", "false_id")).alias("branch", "node_id"), F.col("node_id").alias("parent_id"))
    level = nodes.join(kids, ["tree_id", "node_id"], "left_anti").select("tree_id", "node_id", F.lit(1).alias("depth"), F.lit("").alias("path"))
    level = materialise(level)
    out = level
    for _ in range(max_depth):
        level = kids.join(level.withColumnRenamed("node_id", "parent_id"), ["tree_id", "parent_id"]).select("tree_id", "node_id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.col("branch").cast("string")).alias("path"))
        level = materialise(level)
        if level.limit(1).count() == 0:
            return out
        out = out.unionByName(level)
    raise ValueError("a cycle, or a tree deeper than max_depth")


def tree_depth(nodes: DataFrame) -> DataFrame:
    return node_depths(nodes).groupBy("tree_id").agg(F.max("depth").alias("depth"))


def preorder(rows: Sequence[Row | dict]) -> list[dict]:
    """Nodes of one tree renumbered 1.. in preorder, true branch first."""
    rows = [r.asDict(recursive=True) if isinstance(r, Row) else dict(r) for r in rows]
    by_id = {r["node_id"]: r for r in rows}
    roots = set(by_id) - {r[k] for r in rows if r["kind"] == "D" for k in ("true_id", "false_id")}
    if len(roots) != 1:
        raise ValueError(f"a tree has one root, not {len(roots)}")
    order, stack = [], [roots.pop()]
    while stack:
        r = by_id[stack.pop()]
        order.append(r)
        if r["kind"] == "D":
            stack += [r["false_id"], r["true_id"]]
    number = {r["node_id"]: i for i, r in enumerate(order, 1)}
    return [r | {"node_id": number[r["node_id"]], "true_id": number.get(r["true_id"]), "false_id": number.get(r["false_id"])} for r in order]


def leaf_expression(rows: Sequence[Row | dict], features: Sequence[str], op: str = "le") -> Column:
    """The leaf number a record falls into, as a column. Children before parents, so that depth is no recursion."""
    ordered = preorder(rows)
    original = _numbers(rows)
    if len(ordered) > CASE_NODES:
        return _walker(ordered, original, features, op)
    done: dict[int, Column] = {}
    for r in reversed(ordered):
        k = r["node_id"]
        if r["kind"] == "R":
            done[k] = F.lit(original[k])
        else:
            done[k] = F.when(split_predicate(features[r["feature"]], F.lit(r["ref_val"]), op), done[r["true_id"]]).otherwise(done[r["false_id"]])
    return done[1]


def _numbers(rows) -> dict[int, int]:
    """Preorder number to the given node number."""
    rows = [r.asDict() if isinstance(r, Row) else dict(r) for r in rows]
    tagged = preorder([r | {"results": r["node_id"]} for r in rows])
    return {r["node_id"]: r["results"] for r in tagged}


def _walker(ordered: list[dict], original: dict[int, int], features: Sequence[str], op: str) -> Column:
    n = len(ordered) + 1
    feature, value, yes, no = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in ordered:
        if r["kind"] == "D":
            k = r["node_id"]
            feature[k], value[k], yes[k], no[k] = r["feature"], r["ref_val"], r["true_id"], r["false_id"]
    back = np.array([original.get(i, 0) for i in range(n)])

    @F.pandas_udf("int")
    def walk(cells: pd.Series) -> pd.Series:
        x = np.stack(cells.to_numpy()).astype(float) if len(cells) else np.zeros((0, 1))
        at = np.ones(len(x), np.int64)
        while (open_ := feature[at] >= 0).any():
            v = x[np.arange(len(x))[open_], feature[at[open_]]]
            test = v <= value[at[open_]] if op == "le" else v < value[at[open_]]
            at[open_] = np.where(test, yes[at[open_]], no[at[open_]])
        return pd.Series(back[at]).astype("int32")

    return walk(F.array(*[F.col(f).cast("double") for f in features]))


def evaluate(records: DataFrame, rows: Sequence[Row | dict], features: Sequence[str], op: str = "le", leaf: str = "leaf_id") -> DataFrame:
    return records.withColumn(leaf, leaf_expression(rows, features, op))


def with_results(records: DataFrame, rows: Sequence[Row | dict], features: Sequence[str], op: str = "le") -> DataFrame:
    """Records with ``leaf_id`` and the leaf's ``results``; the leaf table (one row per leaf) is broadcast."""
    spark = records.sparkSession
    leaves = [(r["node_id"], [(x["outcome"], x["probability"]) for x in r["results"]]) for r in rows if r["kind"] == "R"]
    table = spark.createDataFrame(leaves, "leaf_id int, results array<struct<outcome:string,probability:double>>")
    return evaluate(records, rows, features, op).join(F.broadcast(table), "leaf_id", "left")


def vote(records: DataFrame, trees: Sequence[Sequence[Row | dict]], features: Sequence[str], op: str = "le", out: str = "vote") -> DataFrame:
    """Records with the outcome of greatest summed leaf probability; the first by name among equals, "" without any.

    Per row and without a shuffle: each tree's leaf number indexes an array of class probabilities.
    """
    names = sorted({x["outcome"] for t in trees for r in t if r["kind"] == "R" for x in r["results"]})
    if not names:
        return records.withColumn(out, F.lit(""))
    leaves = []
    for i, t in enumerate(trees):
        records = evaluate(records, t, features, op, f"_leaf{i}")
        shares = {r["node_id"]: {x["outcome"]: x["probability"] for x in r["results"]} for r in t if r["kind"] == "R"}
        table = records.sparkSession.createDataFrame([(k, [float(v.get(n, 0.0)) for n in names]) for k, v in shares.items()], f"_leaf{i} int, _p{i} array<double>")
        records = records.join(F.broadcast(table), f"_leaf{i}", "left")
        leaves.append(f"_p{i}")
    total = [sum((F.coalesce(F.col(p)[j], F.lit(0.0)) for p in leaves[1:]), F.coalesce(F.col(leaves[0])[j], F.lit(0.0))) for j in range(len(names))]
    best = F.array_max(F.array(*[F.struct(t.alias("p"), F.lit(-j).alias("o"), F.lit(n).alias("name")) for j, (t, n) in enumerate(zip(total, names, strict=True))]))
    return records.withColumn(out, best["name"]).drop(*leaves, *[f"_leaf{i}" for i in range(len(trees))])


def accuracy_lenient(evaluated: DataFrame, label: str = "label") -> DataFrame:
    """Share of records whose label is among the leaf's outcomes."""
    return evaluated.agg(F.count("*").alias("n"), F.avg(F.exists("results", lambda r: r["outcome"] == F.col(label)).cast("int")).alias("accuracy"))


def accuracy_first(evaluated: DataFrame, label: str = "label") -> DataFrame:
    """Share of records whose label is the leaf's first outcome."""
    return evaluated.agg(F.count("*").alias("n"), F.avg((F.get("results", F.lit(0))["outcome"] == F.col(label)).cast("int")).alias("accuracy"))


def accuracy_vote(voted: DataFrame, label: str = "label", out: str = "vote") -> DataFrame:
    return voted.agg(F.count("*").alias("n"), F.avg((F.col(out) == F.col(label)).cast("int")).alias("accuracy"))


def confusion(voted: DataFrame, label: str = "label", out: str = "vote") -> DataFrame:
    return voted.groupBy(label, out).agg(F.count("*").alias("n"))


def check_record(records: DataFrame, rec_id: int, trees: Sequence[Sequence[Row | dict]], features: Sequence[str], key: str = "rec_id", label: str = "label") -> DataFrame:
    """``key, label, vote, correct`` of one record."""
    voted = vote(records.where(F.col(key) == rec_id), trees, features)
    return voted.select(key, label, "vote", (F.col("vote") == F.col(label)).alias("correct"))
