"""Level-wise growth of Gini trees.

A record carries its cells as an array and the number of its node. Per level there is one job over the records: the cells of all nodes to be
split are counted by (node, feature, value, class), prefix sums over the distinct values give the gain of all splits of all these nodes at
once, and the best split per node comes to the driver (one row per node of that level), with the class counts of its true branch. Those of the false branch are
the rest, so that no record is read for totals but at the root. The splits of a level form a table (node, feature, value, children) that
is joined by node number, broadcast if it is small, to move records on: integers, no CASE over all nodes. Every ``cut_every`` levels the records of open
nodes are written to the shared folder.

A node of at most ``local_rows`` records is put off: when no larger one is left, all such nodes are finished in one job, each with its whole subtree
by one task (``subtree``), which follows the same rules. Subtrees stay a table; the driver only learns how many nodes each has, to number them in preorder.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import split_predicate
from ..operators import stats
from ..schema import CATEGORIES, NODES, Settings
from .tables import BROADCAST_ROWS, materialise


def partition_rows(records: DataFrame, feature: str, value: int, op: str = "le", node: int = 1) -> DataFrame:
    """Records with ``node_id``: 2 n on the true branch, 2 n + 1 on the false one."""
    return records.withColumn("node_id", F.when(split_predicate(feature, F.lit(value), op), 2 * node).otherwise(2 * node + 1).cast("bigint"))


def root_stats(records: DataFrame, label: str = "label") -> DataFrame:
    return stats.class_histogram(records, label)


#: Records (26 cells of 8 bytes) of a node that one task takes.
LOCAL_ROWS = 50_000
#: Up to this many records, all features of a node are searched at once; larger ones feature by feature, which takes less memory.
AT_ONCE = 2_000


def _impurity(counts: np.ndarray) -> float:
    n = int(counts.sum())
    return 1 - float((counts.astype(float) ** 2).sum()) / (n * n) if n else 0.0


def _small_split(x: np.ndarray, y: np.ndarray, classes: int, s: Settings) -> tuple[int, int] | None:
    """As ``_local_split``, all features in one pass over sorted columns; missing cells sort last."""
    order = np.argsort(x, axis=0)
    v = np.take_along_axis(x, order, 0)
    upto = ((y[order][:, :, None] == np.arange(classes)) & ~np.isnan(v)[:, :, None]).cumsum(0)
    nl, total = upto.sum(2), upto[-1]
    known = total.sum(1)
    at, f = np.nonzero((v[:-1] != v[1:]) & (nl[:-1] > 0) & (nl[:-1] < known))
    if not len(at):
        return None
    left, whole, nl, n = upto[at, f].astype(float), total[f].astype(float), nl[at, f], known[f]
    gain = ((left**2).sum(1) / nl + ((whole - left) ** 2).sum(1) / (n - nl) - (whole**2).sum(1) / n) / n
    q = np.where(gain > 0, np.floor(gain * s.quantum), -1)
    if q.max() < (s.least_gain == "quantised"):
        return None
    values = v[at if s.op == "le" else at + 1, f]
    pick = max if s.tie == "last" else min
    return pick((int(f[i]), int(values[i])) for i in np.flatnonzero(q == q.max()))


def _local_split(x: np.ndarray, y: np.ndarray, classes: int, s: Settings) -> tuple[int, int] | None:
    """The best split of one node's records (missing cells are NaN) by the rules of ``stats``."""
    if len(y) <= AT_ONCE:
        return _small_split(x, y, classes, s)
    best, sign = None, 1 if s.tie == "last" else -1
    for f in range(x.shape[1]):
        known = ~np.isnan(x[:, f])
        values, at = np.unique(x[known, f], return_inverse=True)
        if len(values) < 2:
            continue
        counts = np.bincount(at * classes + y[known], minlength=len(values) * classes).reshape(len(values), classes)
        left = counts.cumsum(0) if s.op == "le" else counts.cumsum(0) - counts
        total = counts.sum(0)
        nl, n = left.sum(1), int(total.sum())
        ok = (nl > 0) & (nl < n)
        left, nl, values = left[ok].astype(float), nl[ok], values[ok]
        gain = ((left**2).sum(1) / nl + ((total - left) ** 2).sum(1) / (n - nl) - (total.astype(float) ** 2).sum() / n) / n
        enough = gain > 0 if s.least_gain == "positive" else np.floor(gain * s.quantum) > 0
        gain, values = gain[enough], values[enough]
        if not len(gain):
            continue
        q = np.floor(gain * s.quantum)
        top = np.flatnonzero(q == q.max())
        v = values[top[-1] if s.tie == "last" else top[0]]
        candidate = (q.max(), sign * f, sign * int(v))
        if best is None or candidate > best:
            best = candidate
    return None if best is None else (sign * best[1], sign * best[2])


def subtree(x: np.ndarray, y: np.ndarray, classes: int, depth: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The tree below (and with) a node at ``depth`` (the root's is 0), grown from its records, in preorder: nodes ``(feature or -1, value, true child, false child)``
    numbered from 0, class counts of all nodes."""
    nodes, counted, todo = [], [], [(np.arange(len(y)), depth, -1, 0)]
    while todo:
        rows, level, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        counts = np.bincount(y[rows], minlength=classes)
        split = None
        if len(rows) > s.min_node and _impurity(counts) > s.min_impurity and level < s.max_depth:
            split = _local_split(x[rows], y[rows], classes, s)
        counted.append(counts)
        nodes.append([-1, 0, -1, -1] if split is None else [*split, -1, -1])
        if split is None:
            continue
        with np.errstate(invalid="ignore"):
            yes = x[rows, split[0]] <= split[1] if s.op == "le" else x[rows, split[0]] < split[1]
        todo += [(rows[~yes], level + 1, me, 1), (rows[yes], level + 1, me, 0)]
    return np.array(nodes), np.array(counted)


_GROWN = "node bigint, k int, feature int, value int, yes int, no int, counts array<bigint>"


def _finished(records: DataFrame, depths: dict[int, int], classes: int, settings: Settings) -> DataFrame:
    """``_GROWN``: the subtrees of all records' nodes, one task per node, numbered in preorder from 0."""
    shared = records.sparkSession.sparkContext.broadcast(depths)  # one entry per node put off

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node = int(pdf["node"].iloc[0])
        x = np.stack(pdf["cells"].to_numpy()).astype(float)
        nodes, counts = subtree(x, pdf["y"].to_numpy(np.int64), classes, shared.value[node], settings)
        return pd.DataFrame({"node": node, "k": np.arange(len(nodes)), "feature": nodes[:, 0], "value": nodes[:, 1], "yes": nodes[:, 2], "no": nodes[:, 3], "counts": list(counts)})

    return records.select("node", "y", F.transform("cells", lambda c: c.cast("double")).alias("cells")).groupBy("node").applyInPandas(run, _GROWN)


def _moved(records: DataFrame, splits: list[tuple[int, int, int, int, int]], op: str) -> DataFrame:
    """Records of the given nodes in their children; all others are dropped."""
    table = records.sparkSession.createDataFrame(splits, "node bigint, _f int, _v int, _yes bigint, _no bigint")
    if len(splits) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    cell = F.element_at("cells", F.col("_f") + 1)
    return records.join(table, "node").select(F.when(split_predicate(cell, F.col("_v"), op), F.col("_yes")).otherwise(F.col("_no")).alias("node"), "y", "cells")


def _counted(records: DataFrame, classes: int) -> DataFrame:
    """``node, feature, value, n0..``: class counts at each distinct value."""
    long = records.select("node", "y", F.posexplode("cells").alias("feature", "value")).where("value is not null")
    return long.groupBy("node", "feature", "value").agg(*[F.count_if(F.col("y") == i).alias(f"n{i}") for i in range(classes)])


def train(records: DataFrame, features: Sequence[str], label: str = "label", settings: Settings = Settings(), tree_id: str = "tree", cut_every: int = 4, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """The ``nodes`` of a tree, numbered in preorder. Records without label take no part; missing cells take the false branch.

    A node becomes a leaf if its impurity is at most ``min_impurity``, it has at most ``min_node`` records, no split gains enough,
    or ``max_depth`` is reached. No record at all: one leaf without results. ``local_rows=0`` grows every node level by level.
    """
    spark = records.sparkSession
    cells = F.array(*[F.col(f).cast("int") for f in features]).alias("cells")
    named = records.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), cells)
    histogram = {r[0]: r[1] for r in named.groupBy("_label").agg(F.count("*")).collect()}  # one row per class
    labels = sorted(histogram)
    code = F.array_position(F.array(*map(F.lit, labels)), F.col("_label")).cast("int") - 1 if labels else F.lit(0)
    # classes are coded and cells gathered once, and not in every level's scan
    base = materialise(named.select(F.lit(1).cast("bigint").alias("node"), code.cast("int").alias("y"), "cells"))
    # the upper tree: node -> (feature, value, true child, false child); counts of every node; nodes put off
    splits: dict[int, tuple[int, int, int, int]] = {}
    counts: dict[int, np.ndarray] = {1: np.array([histogram[k] for k in labels], np.int64)}
    depths: dict[int, int] = {}
    open_, level, last = [1] if labels else [], 0, 1
    gained = "gain > 0" if settings.least_gain == "positive" else f"floor(gain * {settings.quantum}) > 0"
    here = base
    put_off: list[DataFrame] = []
    while open_:
        small = [k for k in open_ if 0 < counts[k].sum() <= local_rows and not _closed(counts[k], level, settings)]
        depths |= dict.fromkeys(small, level)
        later = set(small)
        wanted = [k for k in open_ if k not in later and not _closed(counts[k], level, settings)]
        if small:
            put_off.append(_of_nodes(here, small))
        if not wanted:
            break
        best = stats.best_split(stats.candidate_gains(_counted(_of_nodes(here, wanted) if len(wanted) < len(open_) else here, len(labels)), len(labels), ("node",), settings.op, True).where(gained), ("node",), settings)
        moves = []
        for r in best.select("node", "feature", "value", "true_counts").collect():  # one row per node of the level
            yes, no, last = last + 1, last + 2, last + 2
            splits[r[0]] = (r[1], r[2], yes, no)
            counts[yes] = np.array(r[3], np.int64)
            counts[no] = counts[r[0]] - counts[yes]
            moves.append((r[0], r[1], r[2], yes, no))
        open_, level = [k for m in moves for k in m[3:]], level + 1
        if not open_:
            break
        here = _moved(here, moves, settings.op)
        if level % cut_every == 0:
            here = materialise(here)
    order = _preorder_leaves(splits)
    sizes: dict[int, int] = {}
    below = None
    if put_off:
        rows = put_off[0]
        for df in put_off[1:]:
            rows = rows.unionByName(df)
        below = materialise(_finished(rows, depths, len(labels), settings))
        sizes = {r[0]: r[1] for r in below.groupBy("node").agg(F.count("*")).collect()}  # one row per node put off
    number, n = {}, 0
    for k in order:
        number[k] = n + 1
        n += sizes.get(k, 1)
    upper = []
    for k in order:
        if k in splits:
            f, v, yes, no = splits[k]
            upper.append((tree_id, number[k], "D", v, f, number[yes], number[no], None))
        elif k not in sizes:
            upper.append((tree_id, number[k], "R", None, None, None, None, _shares(labels, counts[k], settings) if labels else []))
    out = spark.createDataFrame(upper, NODES)
    if below is None:
        return out
    at = spark.createDataFrame([(k, number[k]) for k in sizes], "node bigint, _at int")
    named = [labels.index(x) for x in _ordered(labels, settings)]
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c)
    shares = F.filter(F.array(*[F.struct(F.lit(labels[i]).alias("outcome"), (F.col("counts")[i] / total).alias("probability")) for i in named]), lambda r: r["probability"] > 0)
    inner = F.col("feature") >= 0
    placed = below.join(F.broadcast(at) if len(sizes) <= BROADCAST_ROWS else at, "node")
    when = lambda c: F.when(inner, c)
    return out.unionByName(placed.select(
        F.lit(tree_id).alias("tree_id"), (F.col("_at") + F.col("k")).alias("node_id"), F.when(inner, "D").otherwise("R").alias("kind"), when(F.col("value")).alias("ref_val"), when(F.col("feature")).alias("feature"),
        when(F.col("_at") + F.col("yes")).alias("true_id"), when(F.col("_at") + F.col("no")).alias("false_id"), F.when(~inner, shares).alias("results"),
    ))


def _closed(counts: np.ndarray, level: int, s: Settings) -> bool:
    return counts.sum() <= s.min_node or _impurity(counts) <= s.min_impurity or level >= s.max_depth


def _of_nodes(records: DataFrame, nodes: list[int]) -> DataFrame:
    if nodes == [1]:
        return records
    table = records.sparkSession.createDataFrame([(k,) for k in nodes], "node bigint")
    return records.join(F.broadcast(table) if len(nodes) <= BROADCAST_ROWS else table, "node", "left_semi")


def _preorder_leaves(splits: dict[int, tuple[int, int, int, int]]) -> list[int]:
    out, todo = [], [1]
    while todo:
        k = todo.pop()
        out.append(k)
        if k in splits:
            todo += [splits[k][3], splits[k][2]]
    return out


def _ordered(labels: list[str], s: Settings) -> list[str]:
    if s.leaf_order == "name":
        return sorted(labels)
    return sorted(labels, key=lambda x: (CATEGORIES.index(x) if x in CATEGORIES else len(CATEGORIES), x))


def _shares(labels: list[str], counts: np.ndarray, s: Settings) -> list[tuple[str, float]]:
    n = int(counts.sum())
    return [(x, int(counts[labels.index(x)]) / n) for x in _ordered(labels, s) if counts[labels.index(x)]]


def grow(records: DataFrame, features: Sequence[str], label: str = "label", settings: Settings = Settings(), tree_id: str = "tree", **options) -> list[dict]:
    """As ``train``, on the driver, in preorder: what ``forest`` evaluates. For trees that fit there."""
    rows = train(records, features, label, settings, tree_id, **options).collect()
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda r: r["node_id"])


def from_ordered(ordered: DataFrame, labels: DataFrame, n: int, key: str = "rec_id") -> DataFrame:
    """``key, f0.., label`` for ``train`` from an ordered dataset ``(feature, key, value)`` and a label map ``(key, label)``: one shuffle by the key. Records without label are left out."""
    cells = [F.max(F.when(F.col("feature") == i, F.col("value"))).alias(f"f{i}") for i in range(n)]
    return ordered.groupBy(key).agg(*cells).join(labels.select(key, "label"), key)


def nodes_table(spark, rows: Sequence[dict]) -> DataFrame:
    values = [(r["tree_id"], r["node_id"], r["kind"], r["ref_val"], r["feature"], r["true_id"], r["false_id"], None if r["results"] is None else [(x["outcome"], x["probability"]) for x in r["results"]]) for r in rows]
    return spark.createDataFrame(values, NODES)
