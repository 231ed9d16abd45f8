"""From classified pixels to located parts, measurements and strain totals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import distance3
from ..schema import MEASUREMENTS, PARTS, STRAINS

WINDOW, DRIFT, MOST_ROUNDS = 30, 10, 100


def class_masks(pixels: DataFrame, category: str = "category") -> DataFrame:
    """Pixels of the five tracked parts."""
    return pixels.where(F.col(category).isin(*PARTS))


def class_centroids(pixels: DataFrame, by: Sequence[str] = ("image",), category: str = "category") -> DataFrame:
    """``by, category, row, col, n``: mean position of each part, cut to int."""
    mean = lambda c: F.floor(F.sum(c) / F.count("*")).cast("int").alias(c)
    return class_masks(pixels, category).groupBy(*by, category).agg(mean("row"), mean("col"), F.count("*").alias("n"))


# --- mean shift and tracking, one frame at a time ---------------------------------------------------------------------------


def mean_shift(rows: np.ndarray, cols: np.ndarray, start: tuple[int, int], half: int = WINDOW, most: int = MOST_ROUNDS) -> tuple[int, int, bool]:
    """Centre of the pixels within ``half`` of the centre, moved until it stays (at most ``most`` times); and whether there were any pixels."""
    r, c = start
    for _ in range(most):
        near = (np.abs(rows - r) <= half) & (np.abs(cols - c) <= half)
        n = int(near.sum())
        if not n:
            return r, c, False
        nr, nc = int(rows[near].sum()) // n, int(cols[near].sum()) // n
        if (nr, nc) == (r, c):
            break
        r, c = nr, nc
    return r, c, True


class Tracker:
    """State of one stream of frames: where the five parts were, and how sure that is.

    UNTRACKED and INACCURATE streams start from the mean position of each part's pixels, TRACKED ones from the last position. A part has
    accuracy 1, less 0.1 for each axis on which it moved more than ``DRIFT`` pixels, 0 on the border or without pixels.
    """

    def __init__(self, status: str = "UNTRACKED", last: dict[str, tuple[int, int]] | None = None):
        self.status, self.last = status, dict(last or {})

    def step(self, masks: dict[str, tuple[np.ndarray, np.ndarray]], rows: int, cols: int) -> list[tuple[str, int, int, float]]:
        """``part, row, col, accuracy`` of all five parts in one frame given each part's pixels; moves the state on."""
        out, drifted, total = [], False, 0.0
        for part in PARTS:
            r, c = masks.get(part, (np.zeros(0, int), np.zeros(0, int)))
            begin = self.last.get(part) if self.status == "TRACKED" else None
            if begin is None and len(r):
                begin = int(r.sum()) // len(r), int(c.sum()) // len(r)
            y, x, any_ = mean_shift(r, c, begin or (0, 0))
            accuracy = 1.0
            if not any_ or y <= 0 or x <= 0 or y >= rows - 1 or x >= cols - 1:
                accuracy = 0.0
            elif self.status != "UNTRACKED" and part in self.last:
                moved = sum(abs(a - b) > DRIFT for a, b in zip((y, x), self.last[part], strict=True))
                accuracy = max(0.0, 1.0 - 0.1 * moved)
                drifted |= moved > 0
            y, x = min(max(y, 0), rows - 1), min(max(x, 0), cols - 1)
            self.last[part] = (y, x)
            out.append((part, y, x, accuracy))
            total += accuracy
        self.status = "UNTRACKED" if total == 0 else "INACCURATE" if drifted else "TRACKED"
        return out


def track(pixels: DataFrame, rows: int, cols: int, stream: str = "stream", frame: str = "frame", category: str = "category") -> DataFrame:
    """``stream, frame, part, row, col, depth, accuracy, status`` of all frames, per stream in frame order.

    A stream's pixels pass through one task sorted, and only one frame of them is held at a time, so a stream's length is no matter of
    memory; streams run in parallel. Frames without a pixel of any part are unknown here and leave the state as it is.
    """
    import pandas as pd

    def run(frames):
        tracker, stream_, held = None, None, []

        def answer():
            part = pd.concat(held) if len(held) > 1 else held[0]
            masks = {p: (g["row"].to_numpy(np.int64), g["col"].to_numpy(np.int64)) for p, g in part.groupby("category", sort=False)}
            depth = {(a, b): d for a, b, d in zip(part["row"], part["col"], part["depth"], strict=True)}
            key = part.iloc[0]
            found = tracker.step(masks, rows, cols)
            return [(int(key["stream"]), int(key["frame"]), p, r, c, int(depth.get((r, c), 0)), a, tracker.status) for p, r, c, a in found]

        names = ["stream", "frame", "part", "row", "col", "depth", "accuracy", "status"]
        last = None
        for pdf in frames:
            out = []
            for key, part in pdf.groupby(["stream", "frame"], sort=False):
                if key != last and held:
                    out += answer()
                    held = []
                if key[0] != stream_:
                    tracker, stream_ = Tracker(), key[0]
                last = key
                held.append(part)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(answer(), columns=names)

    rows_ = class_masks(pixels, category).select(F.col(stream).cast("bigint").alias("stream"), F.col(frame).cast("bigint").alias("frame"), "row", "col", F.coalesce(F.col("depth"), F.lit(0)).cast("int").alias("depth"), F.col(category).alias("category"))
    ordered = rows_.repartition("stream").sortWithinPartitions("stream", "frame")
    return ordered.mapInPandas(run, "stream bigint, frame bigint, part string, row int, col int, depth int, accuracy double, status string")


def drift_flags(locations: DataFrame, order: str = "frame") -> DataFrame:
    """``drifted``: moved more than ``DRIFT`` pixels on either axis since the part's previous frame."""
    w = Window.partitionBy("stream", "part").orderBy(order)
    moved = lambda c: F.abs(F.col(c) - F.lag(c).over(w)) > DRIFT
    return locations.withColumn("drifted", F.coalesce(moved("row") | moved("col"), F.lit(False)))


def depth_at(locations: DataFrame, pixels: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """Locations with the depth of their pixel, 0 where there is none."""
    at = pixels.select(*by, "row", "col", F.col("depth").alias("_d"))
    return locations.drop("depth").join(at, [*by, "row", "col"], "left").withColumn("depth", F.coalesce("_d", F.lit(0))).drop("_d")


# --- measurements and strains -------------------------------------------------------------------------------------------------


def measurements(points: dict[str, Column]) -> list[Column]:
    """The 18 measurements, named and in order, of structs x, y, z per part."""
    p = {"head": "Head", "neck": "Neck", "sternum": "Sternum", "l_shoulder": "LeftShoulder", "r_shoulder": "RightShoulder"}
    out = []
    for name in MEASUREMENTS:
        kind, rest = name.split("_", 1)
        a = next(k for k in p if rest.startswith(k + "_"))
        b = rest[len(a) + 1 :]
        a, b = points[p[a]], points[p[b]]
        out.append({"dist": lambda: distance3(a, b), "off": lambda: a["x"] - b["x"], "dep": lambda: a["z"] - b["z"]}[kind]().alias(name))
    return out


def pivot_parts(locations: DataFrame, point: str, by: Sequence[str]) -> DataFrame:
    """One row per ``by`` with a column per part holding ``point``."""
    return locations.groupBy(*by).agg(*[F.max_by(point, F.when(F.col("part") == p, F.lit(1))).alias(p) for p in PARTS])


def nearest(queries: DataFrame, knowledge: DataFrame, k: int = 5, key: str = "query_id", vec: str = "vec", entry: str = "entry_id", mm: str = "mm", most_entries: int = 100_000) -> DataFrame:
    """``key, entry, dist, rank`` of the k nearest knowledge entries of every query, ties to the smaller entry.

    The knowledge table is small by nature, and that is checked: up to ``most_entries`` rows it is sent to the tasks, which keep k per query
    without a shuffle; a larger one is refused, since it would need an index. Queries need vectors as long as the entries'.
    """
    import pandas as pd

    entries = knowledge.select(F.col(entry).cast("bigint").alias("e"), mm).orderBy("e").limit(most_entries + 1).toPandas()
    if len(entries) > most_entries:
        raise ValueError(f"more than {most_entries} knowledge entries; use an index over them")
    kinds = ", ".join(f"`{n}` {t}" for n, t in ((key, queries.schema[key].dataType.simpleString()), (entry, "bigint"), ("dist", "double"), ("rank", "int")))
    if entries.empty:
        return queries.sparkSession.createDataFrame([], kinds)
    shared = queries.sparkSession.sparkContext.broadcast((entries["e"].to_numpy(), np.stack(entries[mm].to_numpy()).astype(float)))

    def run(frames):
        ids, table = shared.value
        take = min(k, len(ids))
        for pdf in frames:
            for s in range(0, len(pdf), 512):
                part = pdf.iloc[s : s + 512]
                x = np.stack(part[vec].to_numpy()).astype(float)
                best_d, best = np.full((len(x), 0), 0.0), np.zeros((len(x), 0), np.int64)
                for f in range(0, len(ids), 4096):  # entries come in order of their number, so that a stable sort keeps ties to the smaller
                    entries = table[f : f + 4096]
                    d = np.zeros((len(x), len(entries)))
                    for j in range(table.shape[1]):  # one addend at a time, in order: sums as any engine makes them
                        d += (x[:, j : j + 1] - entries[None, :, j]) ** 2
                    own = np.argsort(d, 1, kind="stable")[:, :take]
                    d, at = np.concatenate([best_d, np.take_along_axis(d, own, 1)], 1), np.concatenate([best, own + f], 1)
                    pick = np.argsort(d, 1, kind="stable")[:, :take]
                    best_d, best = np.take_along_axis(d, pick, 1), np.take_along_axis(at, pick, 1)
                yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), take), entry: ids[best].ravel(), "dist": np.sqrt(best_d).ravel(), "rank": np.tile(np.arange(1, take + 1, dtype=np.int32), len(part))})

    return queries.select(key, vec).mapInPandas(run, kinds)


def strain_totals(neighbours: DataFrame, knowledge: DataFrame, key: str = "query_id", entry: str = "entry_id", columns: Sequence[str] = STRAINS) -> DataFrame:
    """Sums of the eight strains over the neighbours of every query."""
    return neighbours.join(knowledge.select(entry, *columns), entry).groupBy(key).agg(*[F.sum(c).alias(c) for c in columns])
