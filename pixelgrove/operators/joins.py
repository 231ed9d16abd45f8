"""The joins of the pipeline, named by what they are for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import file_number
from ..plans.tables import small_enough


def same_name(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Rows of two listings with the same file name, by sort-merge."""
    return left.join(right.hint("merge"), name)


def looked_up(images: DataFrame, strains: DataFrame, key: str = "image") -> DataFrame:
    """Images with their strains (the first line of an image wins); ``found`` says whether there were any."""
    first = first_wins(strains, key, "line_no")
    return images.join(first.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lookup_counts(joined: DataFrame) -> DataFrame:
    """One row: processed and unprocessed."""
    return joined.agg(F.count_if("found").alias("processed"), F.count_if(~F.col("found")).alias("unprocessed"))


def missing(images: DataFrame, strains: DataFrame, key: str = "image") -> DataFrame:
    return images.join(strains.select(key), key, "left_anti")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that of least ``order``; combined before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def record_lookup(cells: DataFrame, labels: DataFrame, key: str = "rec_id", most: int = 500_000) -> DataFrame:
    """Cells of an ordered dataset with their record's label; a label table of at most ``most`` rows is broadcast, else both are shuffled."""
    return cells.join(F.broadcast(labels) if small_enough(labels, most) else labels, key)


def positional(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("image", "row", "col")) -> DataFrame:
    """Two planes by position."""
    return left.join(right, list(keys))


def remapped(rows: DataFrame, mapping: DataFrame, node: str = "node_id") -> DataFrame:
    """Node numbers replaced by ``mapping (old, new)``; rows whose node has a null ``new`` or is unknown are finished and dropped."""
    return rows.join(mapping.where("new is not null"), F.col(node) == F.col("old")).withColumn(node, F.col("new")).drop("old", "new")


def numbered_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Listing with the number each file name begins with; names without one are left out."""
    return files.withColumn("image", file_number(path)).where("image is not null")
