"""The whole way in one plan: frames to training records, frames to strains, records to a forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import forest, grid, posture
from ..schema import COLS, PARTS, ROWS, Settings, features
from . import train
from .tables import materialise


def records_from_frames(frames: DataFrame, rows: int = ROWS, cols: int = COLS, palette: str = "synthetic", skip: tuple[int, int] | None = (49, 146), segmented: bool = False) -> DataFrame:
    """``image, row, col, f0..f25, label`` of the labelled foreground of frames ``(image, row, col, depth, r, g, b)``.

    Images of the unusable range are left out first, so that they are never segmented. Subject extraction and the 26 features run per image, colours are
    joined by position, pixels of no category dropped. ``segmented``: frames have ``subj`` already.
    """
    used = frames if skip is None else frames.where(scalar.outside_images("image", *skip))
    if segmented:
        subject = used.select("image", "row", "col", "subj", "depth")
    else:
        found = grid.subject(used, rows, cols)
        subject = used.select("image", "row", "col", "depth").join(found, ["image", "row", "col"])
    cells = grid.features26(subject.where(scalar.is_foreground("subj")), rows, cols)
    label = scalar.colour_category("r", "g", "b", palette).alias("label")
    return cells.join(used.select("image", "row", "col", label), ["image", "row", "col"]).where(scalar.is_labelled("label"))


def classified_frames(frames: DataFrame, trees: Sequence[Sequence[dict]], rows: int = ROWS, cols: int = COLS, segmented: bool = False) -> DataFrame:
    """``stream, frame, row, col, depth, category`` of the foreground of frames ``(stream, frame, row, col, depth)``, by the vote of a forest."""
    keyed = frames.withColumn("image", F.xxhash64("stream", "frame"))
    if segmented:
        subject = keyed.select("image", "row", "col", "subj", "depth")
    else:
        subject = keyed.select("image", "row", "col", "depth").join(grid.subject(keyed, rows, cols), ["image", "row", "col"])
    voted = forest.vote(grid.features26(subject.where(scalar.is_foreground("subj")), rows, cols), trees, features(), out="category")
    return voted.select("image", "row", "col", "category").join(keyed.select("image", "row", "col", "stream", "frame", "depth"), ["image", "row", "col"]).drop("image")


def measured_frames(locations: DataFrame, rows: int = ROWS, cols: int = COLS, hfov: float | None = None, vfov: float | None = None) -> DataFrame:
    """``stream, frame, mm``: the 18 measurements of every frame from the locations of its five parts."""
    view = {k: v for k, v in (("hfov", hfov), ("vfov", vfov)) if v is not None}
    at = locations.withColumn("point", scalar.to_world("row", "col", "depth", rows, cols, **view))
    parts = posture.pivot_parts(at, "point", ["stream", "frame"])
    return parts.select("stream", "frame", F.array(*posture.measurements({p: F.col(p) for p in PARTS})).alias("mm"))


def strains_from_frames(frames: DataFrame, trees: Sequence[Sequence[dict]], knowledge: DataFrame, k: int = 5, rows: int = ROWS, cols: int = COLS, segmented: bool = False) -> DataFrame:
    """``stream, frame`` and the eight summed strains of every frame with a subject.

    Frame -> subject -> features -> forest -> tracked parts -> world coordinates -> measurements -> k nearest entries of ``knowledge (entry_id, mm, strains)`` -> totals.
    """
    locations = posture.track(classified_frames(frames, trees, rows, cols, segmented), rows, cols)
    measured = materialise(measured_frames(locations, rows, cols).withColumn("query_id", F.xxhash64("stream", "frame")))
    near = posture.nearest(measured, knowledge, k, "query_id", "mm")
    return posture.strain_totals(near, knowledge).join(measured.select("query_id", "stream", "frame"), "query_id").drop("query_id")


def forest_from_records(records: DataFrame, size: int, cells: Sequence[str] | None = None, settings: Settings = Settings(), key: str = "rec_id") -> list[list[dict]]:
    """``size`` trees, each grown on the records of one share of the keys."""
    share = F.floor(scalar.hash_share(key, seed=17) * size)
    return [train.grow(records.where(share == i), cells or features(), settings=settings, tree_id=f"tree{i}") for i in range(size)]
