"""Text files of the pipeline: datasets, ordered datasets and label maps, trees, strains, knowledge. Readers and writers.

Nothing is inferred and nothing collected: lines are cut by built-in expressions in the scan. A malformed line raises when it is read
(``FAILFAST``) or becomes null cells (``PERMISSIVE``); to load files of mixed quality use ``rejects``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import hash_share, knowledge_text, node_text, padded, record_text
from ..plans.tables import broadcast_if_small, materialise
from ..schema import BACKGROUND, N_FEATURES, STRAINS

ID_WIDTH, VALUE_WIDTH = 12, 4


def read_dataset(spark: SparkSession, path: str, n: int = N_FEATURES, with_ids: bool = False, mode: str = "FAILFAST", missing: int = BACKGROUND) -> DataFrame:
    """``[rec_id,] f0.., label`` from whitespace-separated lines; either line end, blank lines skipped, the sentinel (also as -1) as null.

    A line with too few fields is an error; further fields are ignored.
    """
    fields = F.split(F.btrim("value", F.lit(" \t\r\n")), r"\s+")
    lines = spark.read.text(path).where(F.btrim("value", F.lit(" \t\r\n")) != "").select(fields.alias("_f"))
    first, size = int(with_ids), n + 1 + int(with_ids)
    if mode == "FAILFAST":
        lines = lines.withColumn("_f", F.when(F.size("_f") >= size, F.col("_f")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.array_join("_f", " "))).cast("array<string>")))
    # all cells are cast at once, so that a line is cut and checked once and not once per column
    values = F.transform(F.slice("_f", first + 1, n), lambda x: x.try_cast("int"))
    lines = lines.withColumn("_v", values)
    if mode == "FAILFAST":
        lines = lines.withColumn("_v", F.when(F.exists("_v", lambda v: v.isNull()), F.raise_error(F.concat(F.lit("not a number: "), F.array_join("_f", " "))).cast("array<int>")).otherwise(F.col("_v")))
    cell = lambda i: F.get("_v", F.lit(i))
    columns = [F.when((cell(i) != missing) & (cell(i) != -1), cell(i)).alias(f"f{i}") for i in range(n)]
    ids = [F.get("_f", F.lit(0)).try_cast("bigint").alias("rec_id")] if with_ids else []
    return lines.select(*ids, *columns, F.get("_f", F.lit(first + n)).alias("label"))


def bounded(records: DataFrame, most: int | None, key: str, proportion: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(training, test)``: at most ``most`` records, split by a hash of their key, the same at every run."""
    rows = records if most is None else records.limit(most)
    share = hash_share(key, seed=seed)
    return rows.where(share < proportion), rows.where(share >= proportion)


def read_ordered(spark: SparkSession, path: str, n: int = N_FEATURES) -> DataFrame:
    """``feature, position, rec_id, value`` from fixed-width lines of ``n`` (id, value) pairs, each feature sorted by value down the file."""
    width = ID_WIDTH + VALUE_WIDTH
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        i.alias("feature"),
        F.substring("value", i * width + 1, F.lit(ID_WIDTH)).try_cast("bigint").alias("rec_id"),
        F.substring("value", i * width + ID_WIDTH + 1, F.lit(VALUE_WIDTH)).try_cast("int").alias("value"),
    )))
    return spark.read.text(path).where(F.length("value") >= n * width).select(pairs.alias("p")).select("p.*")


def ordered_text(records: DataFrame, features: Sequence[str], key: str = "rec_id") -> DataFrame:
    """``value``: the lines of an ordered dataset, each feature's (id, value) pairs in order of value. Missing cells go last as the sentinel.

    Cells are sorted once, range-partitioned by (feature, value, id) over all tasks; a cell's place within its feature is its place in its partition
    plus the feature's cells in the partitions before, a table of a row per partition and feature.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.coalesce(F.col(f).cast("int"), F.lit(9999)).alias("v")) for i, f in enumerate(features)])
    long = records.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    within = F.monotonically_increasing_id()
    ranged = long.repartitionByRange("feature", "v", key).sortWithinPartitions("feature", "v", key)
    placed = materialise(ranged.select("*", F.spark_partition_id().alias("_p"), within.alias("_i")))
    starts = placed.groupBy("_p", "feature").agg(F.min("_i").alias("_from"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("feature").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_p", "feature", (before - F.col("_from")).alias("_add"))
    ranked = placed.join(broadcast_if_small(materialise(starts)), ["_p", "feature"]).withColumn("at", F.col("_i") + F.col("_add"))
    text = F.concat(padded(key, ID_WIDTH), padded("v", VALUE_WIDTH))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature", text.alias("t")))), lambda x: x["t"]), "")
    return ranked.groupBy("at").agg(line.alias("value")).orderBy("at").select("value")


def read_map(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """``rec_id, label`` from lines of a 12-digit id and one digit; an unexpected number of rows is an error."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    rows = lines.select(F.substring("value", 1, ID_WIDTH).cast("bigint").alias("rec_id"), F.btrim(F.substring("value", ID_WIDTH + 1, 3)).cast("int").alias("label"))
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} labels where {expected} were expected")
    return rows


_NODE = r"D\(\d+,-?\d+,\d+,\d+,\d+\)|R\(\d+(?:,C\([^(),]*,[0-9.eE+-]+\))*\)"


def read_trees(spark: SparkSession, *paths: str) -> DataFrame:
    """``nodes`` of tree files, one tree per file, named by it. A token that is no node is an error."""
    files = spark.read.text(list(paths), wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(?:\.[^./]*)?$", 1).alias("tree_id"), "value")
    token = F.explode(F.filter(F.split("value", r"\s+"), lambda t: t != ""))
    tokens = files.select("tree_id", token.alias("t"))
    checked = F.when(F.col("t").rlike(rf"^(?:{_NODE})$"), F.col("t")).otherwise(F.raise_error(F.concat(F.lit("no node: "), F.col("t"))).cast("string"))
    rows = tokens.select("tree_id", checked.alias("t")).withColumn("n", F.regexp_extract_all(F.regexp_extract("t", r"^\w\(([^C]*?)(?:,C|\)$)", 1), F.lit(r"(-?\d+)"), F.lit(1)))
    inner = lambda i: F.when(F.col("t").startswith("D"), F.get("n", F.lit(i)).cast("int"))
    result = F.transform(
        F.regexp_extract_all("t", F.lit(r"C\(([^(),]*,[0-9.eE+-]+)\)"), F.lit(1)),
        lambda x: F.struct(F.substring_index(x, ",", 1).alias("outcome"), F.substring_index(x, ",", -1).cast("double").alias("probability")),
    )
    return rows.select("tree_id", F.get("n", F.lit(0)).cast("int").alias("node_id"), F.substring("t", 1, 1).alias("kind"), inner(1).alias("ref_val"), inner(2).alias("feature"), inner(3).alias("true_id"), inner(4).alias("false_id"), F.when(F.col("t").startswith("R"), result).alias("results"))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, line`` of tree files."""
    return nodes.select("tree_id", "node_id", node_text().alias("line"))


def write_tree(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file with a tree's nodes in order; an existing one is only replaced with ``mode='overwrite'``. A tree is small: one task."""
    tree_lines(nodes).orderBy("node_id").select("line").coalesce(1).write.mode(mode).text(path)


def write_dataset(records: DataFrame, path: str, features: Sequence[str], label: str = "label", rec_id: str | None = None, mode: str = "errorifexists") -> None:
    records.select(record_text(features, label, rec_id).alias("value")).write.mode(mode).text(path)


def read_strains(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, image`` and eight strains; the last ``)`` may be absent. ``line_no`` follows the file's order within a file."""
    digits = F.regexp_extract_all("value", F.lit(r"P\(([0-9]),([0-9]),([0-9]),([0-9])\)"), F.lit(0))
    codes = F.regexp_extract_all(F.array_join(digits, ""), F.lit(r"([0-9])"), F.lit(1))
    lines = spark.read.text(path).where(F.btrim("value", F.lit(" \t\r")) != "").withColumn("line_no", F.monotonically_increasing_id())
    return lines.select("line_no", F.regexp_extract("value", r"^\s*(\d+)", 1).try_cast("int").alias("image"), *[F.get(codes, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(STRAINS)])


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, mm`` and eight strains."""
    mm = F.transform(F.split(F.regexp_extract("value", r"M\(([^()]*)\)", 1), ","), lambda x: x.try_cast("double"))
    codes = F.regexp_extract_all(F.regexp_extract("value", r";S\((.*)$", 1), F.lit(r"([0-9])"), F.lit(1))
    lines = spark.read.text(path).where(F.btrim("value", F.lit(" \t\r")) != "").withColumn("line_no", F.monotonically_increasing_id())
    return lines.select("line_no", mm.alias("mm"), *[F.get(codes, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(STRAINS)])


def write_knowledge(entries: DataFrame, path: str, mm: str = "mm", mode: str = "errorifexists") -> None:
    entries.select(knowledge_text(mm, STRAINS).alias("value")).write.mode(mode).text(path)
