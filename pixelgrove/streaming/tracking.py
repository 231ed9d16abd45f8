"""Trackers and distance estimates as stateful streams; the batch twins are ``posture.track`` and ``background.adaptive_distance``.

Frames carry a number. Within a micro-batch they are sorted by it, so the order of files doesn't matter; between micro-batches a frame
older than the last one seen is late and is dropped, as a live tracker has to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.posture import Tracker
from ..schema import LOCATIONS, PARTS
from .background import RING_MAX, step_distance


def track_stream(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """``pixels``: a stream of ``stream bigint, frame bigint, row int, col int, depth int, category string``."""
    state_schema = "frame bigint, status string, rows array<int>, cols array<int>"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, tracker = -1, Tracker()
        if state.exists:
            last, status, r, c = state.get
            tracker = Tracker(status, {p: (int(a), int(b)) for p, a, b in zip(PARTS, r, c, strict=True) if a >= 0})
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        out = []
        for frame, part in pdf[pdf["frame"] > last].sort_values("frame", kind="stable").groupby("frame", sort=True):
            masks = {p: (g["row"].to_numpy(np.int64), g["col"].to_numpy(np.int64)) for p, g in part.groupby("category")}
            depth = {(a, b): d for a, b, d in zip(part["row"], part["col"], part["depth"], strict=True)}
            for p, r, c, a in tracker.step(masks, rows, cols):
                out.append((key[0], frame, p, r, c, int(depth.get((r, c), 0)), a))
            out[-len(PARTS) :] = [(*x[:7], tracker.status) for x in out[-len(PARTS) :]]
            last = int(frame)
        at = [tracker.last.get(p, (-1, -1)) for p in PARTS]
        state.update((last, tracker.status, [int(a) for a, _ in at], [int(b) for _, b in at]))
        if out:
            yield pd.DataFrame(out, columns=["stream", "frame", "part", "row", "col", "depth", "accuracy", "status"])

    return pixels.where(pixels["category"].isin(*PARTS)).groupBy("stream").applyInPandasWithState(run, LOCATIONS, state_schema, "append", GroupStateTimeout.NoTimeout)


def distance_stream(maxima: DataFrame, length: int = RING_MAX) -> DataFrame:
    """``maxima``: a stream of ``stream bigint, frame bigint, greatest double``; out: ``stream, frame, distance``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ring, at = state.get if state.exists else (-1, [0.0] * length, 0)
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pdf, out = pd.concat(parts, ignore_index=True), []
        for frame, value in pdf[pdf["frame"] > last].sort_values("frame")[["frame", "greatest"]].itertuples(index=False):
            ring, at, mean = step_distance(list(ring), int(at), float(value))
            out.append((key[0], int(frame), mean))
            last = int(frame)
        state.update((last, [float(x) for x in ring], int(at)))
        if out:
            yield pd.DataFrame(out, columns=["stream", "frame", "distance"])

    return maxima.groupBy("stream").applyInPandasWithState(run, "stream bigint, frame bigint, distance bigint", "frame bigint, ring array<double>, at int", "append", GroupStateTimeout.NoTimeout)
