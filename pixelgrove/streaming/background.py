"""Background model, motion and adaptive distance: batch windows where a window can say it, state where values are written back."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.grid import morph

RING, SAMPLE = 4, 15
NEAR, FAR, FLOOR, RING_MAX, MARGIN = 5000, 20_000, 10_000, 8, 1000
LEAST_MOTION, MOST_MOTION = 500, 3500


def ring_mean(frames: DataFrame, value: str, by: Sequence[str], order: Sequence[str], length: int = RING, out: str = "model") -> DataFrame:
    """Sum of the last ``length`` values over ``length``: the history before the first frame counts as zeros."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(length - 1), 0)
    return frames.withColumn(out, F.sum(value).over(w) / float(length))


def background_model(pixels: DataFrame, frame: str = "frame", sample: int = SAMPLE, length: int = RING, in_view: str | None = None) -> DataFrame:
    """``row, col, frame, model`` at each sampled frame: mean of the pixel's last ``length`` sampled depths (0 outside the view mask)."""
    depth = F.col("depth") if in_view is None else F.when(F.col(in_view), F.col("depth")).otherwise(0)
    sampled = pixels.where(F.pmod(F.col(frame), F.lit(sample)) == 0).withColumn("_d", depth)
    return ring_mean(sampled, "_d", ["stream", "row", "col"], [frame], length).drop("_d")


def motion_mask(pixels: DataFrame, depth: str = "depth", model: str = "model", out: str = "motion") -> DataFrame:
    """Where the depth differs from the model by more than ``LEAST_MOTION`` and at most ``MOST_MOTION``; to be eroded by ``grid.morph``."""
    moved = F.abs(F.col(depth) - F.col(model))
    return pixels.withColumn(out, ((moved > LEAST_MOTION) & (moved <= MOST_MOTION)).cast("int"))


def motion_area(pixels: DataFrame, depth: str = "depth", model: str = "model", size: int = 5, out: str = "motion") -> DataFrame:
    """``motion_mask`` eroded by a square, frame by frame: single moving pixels are noise. Needs ``stream, frame, row, col``."""
    image = F.concat_ws("/", "stream", "frame")
    moved = motion_mask(pixels, depth, model, "_m").withColumn("image", image)
    return morph(moved, "_m", "erode", size, out=out).drop("_m", "image")


def frame_maxima(pixels: DataFrame, by: Sequence[str] = ("stream", "frame"), mask: str = "motion") -> DataFrame:
    """Greatest depth of the moving area within (NEAR, FAR]; 0 without any."""
    seen = F.when((F.col(mask) != 0) & (F.col("depth") > NEAR) & (F.col("depth") <= FAR), F.col("depth"))
    return pixels.groupBy(*by).agg(F.coalesce(F.max(seen), F.lit(0)).alias("greatest"))


def step_distance(ring: list[float], at: int, value: float, floor: int = FLOOR) -> tuple[list[float], int, int]:
    """The ring with one more maximum, its next position, and the distance: the mean as an int, or the floor, which is then written back."""
    ring = list(ring)
    ring[at] = value
    mean = int(sum(ring) / len(ring))
    if mean < floor:
        mean = floor
        ring[at] = float(floor)
    return ring, (at + 1) % len(ring), mean


def adaptive_distance(maxima: DataFrame, stream: str = "stream", frame: str = "frame", value: str = "greatest", length: int = RING_MAX) -> DataFrame:
    """``stream, frame, distance``: moving mean of the last maxima with a floor that is written back (so no window can say it).

    Streams run in parallel, each sorted through one task with a ring of ``length`` numbers as its only state.
    """

    def run(frames):
        state, stream_ = ([0.0] * length, 0), None
        for pdf in frames:
            out = []
            for s, f, v in zip(pdf["stream"], pdf["frame"], pdf["value"], strict=True):
                if s != stream_:
                    state, stream_ = ([0.0] * length, 0), s
                ring, at, mean = step_distance(*state, float(v))
                state = (ring, at)
                out.append((s, f, mean))
            yield pd.DataFrame(out, columns=["stream", "frame", "distance"])

    rows = maxima.select(F.col(stream).cast("bigint").alias("stream"), F.col(frame).cast("bigint").alias("frame"), F.col(value).cast("double").alias("value"))
    return rows.repartition("stream").sortWithinPartitions("stream", "frame").mapInPandas(run, "stream bigint, frame bigint, distance bigint")


def background_chain(pixels: DataFrame, sample: int = SAMPLE, length: int = RING, size: int = 5) -> DataFrame:
    """``stream, frame, row, col, depth, model, motion, distance, in_view`` of every pixel ``(stream, frame, row, col, depth)``.

    The background model of a frame is that of its stream's last sampled frame; before the first one nothing moves and the model is null. What moves, eroded,
    gives the frame's greatest depth, these the adaptive distance, and that the view mask. One shuffle by pixel, two for the erosion, one by frame.
    """
    depth = F.when(F.pmod(F.col("frame"), F.lit(sample)) == 0, F.col("depth"))
    w = Window.partitionBy("stream", "row", "col").orderBy("frame")
    seen = F.collect_list(depth).over(w.rowsBetween(-(sample * length), 0))
    ring = F.when(F.size(seen) > length, F.slice(seen, -length, length)).otherwise(seen)
    total = F.aggregate(ring, F.lit(0).cast("bigint"), lambda s, x: s + x)
    modelled = pixels.withColumn("model", F.when(F.size(ring) > 0, total / float(length)))  # a ring not yet full counts as padded with zeros
    area = motion_area(modelled, size=size).withColumn("motion", F.coalesce("motion", F.lit(0)))
    distance = adaptive_distance(frame_maxima(area))
    return view_mask(area.join(distance, ["stream", "frame"]))


def view_mask(pixels: DataFrame, distance: str = "distance", least: int = NEAR, out: str = "in_view") -> DataFrame:
    return pixels.withColumn(out, (F.col("depth") > least) & (F.col("depth") <= F.col(distance) + MARGIN))
