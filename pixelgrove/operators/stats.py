"""Histograms, impurity and split search: group, prefix-sum, arg-max instead of testing every record against every candidate.

The only thing shuffled is ``(node, feature, value) -> counts per class``, combined before the shuffle; its size depends on the number of
distinct values, not of records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Settings


def class_histogram(records: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return records.groupBy(*by, label).agg(F.count("*").alias("n"))


def gini(records: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``by, n, impurity``: 1 - sum of squared class shares, in integers until the last division. Empty input without ``by``: n 0, impurity null."""
    h = class_histogram(records, label, by)
    n = F.coalesce(F.sum("n"), F.lit(0))
    return h.groupBy(*by).agg(n.alias("n"), (F.lit(1.0) - F.try_divide(F.sum(F.col("n") * F.col("n")), n * n)).alias("impurity"))


def purity(records: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``by, is_pure``: all labels equal (null counts as a label of its own)."""
    null, some = F.max(F.col(label).isNull()), F.max(F.col(label).isNotNull())
    return records.groupBy(*by).agg((F.coalesce(F.min(label) == F.max(label), F.lit(True)) & ~(null & some)).alias("is_pure"))


def long_cells(records: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep, feature, value``: one row per present cell."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("int").alias("value")) for i, f in enumerate(features)])
    return records.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.feature", "_c.value").where("value is not null")


def unique_values(records: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by, feature, value``: distinct values."""
    return long_cells(records, features, by).distinct()


def unique_lists(records: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by, feature, vals, num_vals``: sorted distinct values as a list. Meant for features of bounded range."""
    return unique_values(records, features, by).groupBy(*by, "feature").agg(F.array_sort(F.collect_list("value")).alias("vals"), F.count("*").alias("num_vals"))


def candidate_counts(records: DataFrame, features: Sequence[str], labels: Sequence, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``by, feature, value, n0.., `` counts per class at each distinct value; ``labels`` lists the classes."""
    counts = [F.count_if(F.col(label) == v).alias(f"n{i}") for i, v in enumerate(labels)]
    return long_cells(records, features, (*by, label)).groupBy(*by, "feature", "value").agg(*counts)


def candidate_gains(counts: DataFrame, classes: int, by: Sequence[str] = (), op: str = "le", with_counts: bool = False) -> DataFrame:
    """``by, feature, value, n_true, n_false, gain`` of every split that leaves no side empty; with ``true_counts``, those of the classes on the true branch, on demand.

    gain = (sum l^2 / nl + sum r^2 / nr - sum t^2 / n) / n, which equals the decrease of the Gini impurity.
    """
    w = Window.partitionBy(*by, "feature").orderBy("value")
    upto = w.rowsBetween(Window.unboundedPreceding, 0 if op == "le" else -1)
    whole = Window.partitionBy(*by, "feature")
    left = [F.coalesce(F.sum(f"n{i}").over(upto), F.lit(0)) for i in range(classes)]
    all_ = [F.sum(f"n{i}").over(whole) for i in range(classes)]
    summed = counts.select(*by, "feature", "value", *[x.alias(f"l{i}") for i, x in enumerate(left)], *[x.alias(f"t{i}") for i, x in enumerate(all_)])
    total = lambda p: sum((F.col(f"{p}{i}") for i in range(1, classes)), F.col(f"{p}0"))
    square = lambda c: c.cast("double") * c.cast("double")
    squares = lambda f: sum((square(f(i)) for i in range(1, classes)), square(f(0)))
    nl, n = total("l"), total("t")
    summed = summed.withColumns({"n_true": nl, "n_all": n}).where("n_true > 0 and n_true < n_all")
    nr = F.col("n_all") - F.col("n_true")
    gain = (squares(lambda i: F.col(f"l{i}")) / F.col("n_true") + squares(lambda i: F.col(f"t{i}") - F.col(f"l{i}")) / nr - squares(lambda i: F.col(f"t{i}")) / F.col("n_all")) / F.col("n_all")
    kept = [F.array(*[F.col(f"l{i}") for i in range(classes)]).alias("true_counts")] if with_counts else []
    return summed.select(*by, "feature", "value", "n_true", nr.alias("n_false"), gain.alias("gain"), *kept)


def _rank(settings: Settings) -> Column:
    sign = 1 if settings.tie == "last" else -1
    return F.struct(F.floor(F.col("gain") * settings.quantum), (F.col("feature") * sign).alias("f"), (F.col("value") * sign).alias("v"))


def best_split(gains: DataFrame, by: Sequence[str] = (), settings: Settings = Settings()) -> DataFrame:
    """The split of greatest quantised gain per ``by``; among equals the last (or first) by (feature, value)."""
    rest = [c for c in gains.columns if c not in by]
    picked = gains.groupBy(*by).agg(F.max_by(F.struct(*rest), _rank(settings)).alias("s"))
    return picked.where("s is not null").select(*by, "s.*")


def best_split_per_feature(gains: DataFrame, by: Sequence[str] = (), settings: Settings = Settings()) -> DataFrame:
    """As ``best_split`` for each feature, then to be compared across features by ``best_split`` again."""
    picked = gains.groupBy(*by, "feature").agg(F.max_by(F.struct("value", "n_true", "n_false", "gain"), _rank(settings)).alias("s"))
    return picked.select(*by, "feature", "s.*")


def leaf_distribution(records: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``by, results``: (outcome, probability) of the classes present, names ascending."""
    h = class_histogram(records.where(F.col(label).isNotNull()), label, by)
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    shares = h.select(*by, F.struct(F.col(label).cast("string").alias("outcome"), (F.col("n") / total).alias("probability")).alias("r"))
    return shares.groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("results"))


def depth_histogram(values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, value, n, running, level``: counts of the non-zero values, running counts and 256 * (1 - share so far) cut to int."""
    h = values.where(F.col(value) != 0).groupBy(*by, value).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*(by or [F.lit(0)]))
    running = F.sum("n").over(part.orderBy(value))
    return h.select(*by, value, "n", running.alias("running"), F.floor(256 * (1 - running / F.sum("n").over(part))).cast("int").alias("level"))


def value_range(values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Least and greatest non-zero value, and the mean over all."""
    seen = F.when(F.col(value) != 0, F.col(value))
    return values.groupBy(*by).agg(F.min(seen).alias("low"), F.max(seen).alias("high"), F.avg(value).alias("mean"))
