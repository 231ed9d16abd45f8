"""How often every distinct value occurs and in how many records, with marks for the too rare and the too common.

Method: every record emits its values; counts are combined by hash before the shuffle, so what is shuffled is bounded by
(distinct values x tasks) and no value, however common, makes a large group. Repeated deliveries of a record count once.

Defined results: a null or -1 cell is no value; a null list has no values and isn't counted among the lists; an empty list is
counted and has none. Rows without id are no records. Frequency bounds are
``in_records < rare_below`` and ``in_records > common_share * all records``; a value on a bound is neither. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import feature_names, materialise, one_per_key, present

RARE_BELOW = 3
COMMON_SHARE_CELLS = 0.05
COMMON_SHARE_LISTS = 0.90


def _marked(counts: DataFrame, total, rare_below: int, common_share: float) -> DataFrame:
    rare, common = F.col("in_records") < rare_below, F.col("in_records") > F.lit(common_share) * total
    return counts.withColumn("mark", F.when(rare, "rare").when(common, "common").otherwise("useful"))


def cell_frequencies(records: DataFrame, key: str = "rec_id", features: list[str] | None = None, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE_CELLS) -> DataFrame:
    """``src='feature', feature, val, occurrences, in_records, mark`` for every value of every feature column.

    A record holds one cell per feature, so both counts are equal here. The total of records is carried along as one more
    counted pair instead of a second pass over the table.
    """
    features = features or feature_names()
    rows = one_per_key(records.select(key, *[present(c).cast("int").alias(c) for c in features]), key)
    pairs = F.array(
        F.struct(F.lit(-1).alias("feature"), F.lit(0).alias("val")),
        *[F.struct(F.lit(i).alias("feature"), F.col(c).alias("val")) for i, c in enumerate(features)],
    )
    cells = rows.select(F.explode(pairs).alias("p")).select("p.feature", "p.val").where("val is not null")
    counts = materialise(cells.groupBy("feature", "val").agg(F.count("*").alias("n")))  # written, so that records are read and exploded once
    total = F.lit(sum(r.n for r in counts.where("feature = -1").select("n").collect()))  # one row, none without records
    counts = counts.where("feature >= 0").select(F.lit("feature").alias("src"), "feature", "val", F.col("n").alias("occurrences"), F.col("n").alias("in_records"))
    return _marked(counts, total, rare_below, common_share)


def list_frequencies(lists: DataFrame, key: str = "uv_id", feature: str = "feature", vals: str = "vals", rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE_LISTS) -> DataFrame:
    """``src='vals', feature, val, occurrences, in_records, mark`` for every value of the lists of every feature.

    ``occurrences`` counts repeats within a list, ``in_records`` lists. A list is first reduced to (value, repeats) pairs in the
    task that reads it. The number of lists per feature travels as a pair with a null value.
    """
    once = one_per_key(lists.where(F.col(vals).isNotNull()).select(key, feature, vals), key)
    # values sorted, then the end of each run of equal ones: repeats without a nested scan
    run = F.expr(f"array_sort(filter(`{vals}`, x -> x is not null))")
    rows = once.select(F.col(feature).cast("int").alias("feature"), run.alias("v")).select("feature", "v", F.array_distinct("v").alias("d"))
    one_each = F.size("v") == F.size("d")
    unequal = rows.where(~one_each).select("feature", F.explode("v").alias("val")).groupBy("feature", "val").agg(F.count("*").alias("occurrences"), F.lit(0).cast("bigint").alias("in_records"))
    values = F.concat(F.array(F.lit(None).cast("int")), F.col("d").cast("array<int>"))
    exploded = rows.select("feature", one_each.alias("e"), F.explode(values).alias("val"))
    counted = exploded.groupBy("feature", "val").agg(F.sum(F.when(F.col("e"), 1).otherwise(0)).alias("occurrences"), F.count("*").alias("in_records"))
    counts = materialise(counted.unionByName(unequal.withColumn("val", F.col("val").cast("int"))).groupBy("feature", "val").agg(F.sum("occurrences").alias("occurrences"), F.sum("in_records").alias("in_records")))
    totals = counts.where("val is null").select("feature", F.col("in_records").alias("_total"))
    counts = counts.where("val is not null").select(F.lit("vals").alias("src"), "feature", "val", "occurrences", "in_records")
    joined = counts.join(totals, counts["feature"].eqNullSafe(totals["feature"])).drop(totals["feature"])
    return _marked(joined, F.col("_total"), rare_below, common_share).drop("_total")


def value_frequencies(records: DataFrame, lists: DataFrame) -> DataFrame:
    """Both sources together."""
    return cell_frequencies(records).unionByName(list_frequencies(lists))


def not_useful(records: DataFrame, lists: DataFrame) -> DataFrame:
    """``src, feature, val`` of the pairs marked rare or common."""
    return value_frequencies(records, lists).where("mark <> 'useful'").select("src", "feature", "val")
