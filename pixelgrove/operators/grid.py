"""Operators over pixel grids ``(image, row, col, subj, depth)``: prefix sums, boxes, morphology, the 26 neighbourhood features.

What has fixed offsets is a window over (image, row) or (image, col): no join, one shuffle per direction. What depends on a pixel's
depth (features 1 to 10) is looked up by computed coordinates: either by an equi-join on them (``fetched``), or, for all 26 features
at once, in one task per image on dense arrays (``features26``), since an image is small by nature. Background (subj 0) is outside.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import depth_offset
from ..schema import COLS, NORM, ROWS, features

# --- windows -----------------------------------------------------------------------------------------------------------------


def _along(axis: str):
    """Window over one image line: along columns of a row, or along rows of a column."""
    return Window.partitionBy("image", "row").orderBy("col") if axis == "h" else Window.partitionBy("image", "col").orderBy("row")


def _on() -> Column:
    return (F.col("subj") != 0).cast("int")


def horizontal_counts(grid: DataFrame, out: str = "h") -> DataFrame:
    """Foreground pixels from column 0 up to and including each pixel's."""
    return grid.withColumn(out, F.sum(_on()).over(_along("h").rowsBetween(Window.unboundedPreceding, 0)))


def vertical_counts(grid: DataFrame, out: str = "v") -> DataFrame:
    return grid.withColumn(out, F.sum(_on()).over(_along("v").rowsBetween(Window.unboundedPreceding, 0)))


def integral(grid: DataFrame, out: str = "integral", saturated: bool = False) -> DataFrame:
    """Foreground pixels above and left of each pixel, inclusive; ``saturated`` caps every sum at 65535 (see ``integral_image``)."""
    h = horizontal_counts(grid, "_h")
    total = F.sum("_h").over(_along("v").rowsBetween(Window.unboundedPreceding, 0))
    return h.withColumn(out, F.least(total, F.lit(65_535)) if saturated else total).drop("_h")


def integral_image(mask: np.ndarray, top: int = 65_535) -> np.ndarray:
    """2-D integral of a mask in unsigned numbers up to ``top`` that saturate inside the recurrence own + above + left - diagonal, as 16-bit images do: past
    the first cell that is capped, sums fall behind the true ones."""
    on = (mask != 0).astype(np.int64)
    rows, cols = on.shape
    out = np.zeros((rows + 1, cols + 1), np.int64)
    for d in range(rows + cols - 1):  # one diagonal at a time: its cells don't depend on each other
        r = np.arange(max(0, d - cols + 1), min(rows, d + 1))
        c = d - r
        out[r + 1, c + 1] = np.clip(np.minimum(np.minimum(on[r, c] + out[r, c + 1], top) + out[r + 1, c], top) - out[r, c], 0, top)
    return out[1:, 1:]


def saturated_integral(grid: DataFrame, rows: int = ROWS, cols: int = COLS, top: int = 65_535) -> DataFrame:
    """``image, row, col, integral`` of every pixel, saturating inside the recurrence."""

    def kernel(subj):
        r, c = np.indices(subj.shape)
        return {"row": r.ravel(), "col": c.ravel(), "integral": integral_image(subj, top).ravel()}

    return per_image(grid, kernel, "row int, col int, integral bigint", rows, cols, ["subj"])


def box_counts(grid: DataFrame, offset: int, out: str = "box") -> DataFrame:
    """Foreground pixels in the square around each pixel that reaches half of ``offset`` (at most 42) to every side, clipped at the border."""
    half = min(offset, 42) // 2
    row_sums = grid.withColumn("_s", F.sum(_on()).over(_along("h").rangeBetween(-half, half)))
    return row_sums.withColumn(out, F.sum("_s").over(_along("v").rangeBetween(-half, half))).drop("_s")


def balance(grid: DataFrame, axis: str, offset: int, size: int, out: str) -> DataFrame:
    """``size`` + foreground after - foreground up to each pixel, within ``offset``; near the low border the line's first pixel isn't counted."""
    w, at = _along(axis), F.col("col" if axis == "h" else "row")
    after = F.coalesce(F.sum(_on()).over(w.rangeBetween(1, offset)), F.lit(0))
    upto = F.sum(_on()).over(w.rangeBetween(-offset, 0))
    first = F.coalesce(F.max(F.when(at == 0, _on())).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0))
    left = F.when(at <= offset, upto - first).otherwise(upto)
    return grid.withColumn(out, (F.lit(size) + after - left).cast("int"))


def median3(grid: DataFrame, mask: str = "on", out: str = "median") -> DataFrame:
    """Majority of the 3 x 3 neighbourhood of a 0/1 column, borders repeated."""

    def three(c: Column, axis: str) -> Column:
        w = _along(axis)
        return F.coalesce(F.lag(c).over(w), c) + c + F.coalesce(F.lead(c).over(w), c)

    rows = grid.withColumn("_t", three(F.col(mask), "h"))
    return rows.withColumn(out, (three(F.col("_t"), "v") >= 5).cast("int")).drop("_t")


def morph(grid: DataFrame, value: str, how: str = "erode", size: int = 5, shape: str = "rect", out: str | None = None) -> DataFrame:
    """Erosion (least) or dilation (greatest) over a square or a cross; pixels outside the image don't matter."""
    half, f = size // 2, F.min if how == "erode" else F.max
    pick = F.least if how == "erode" else F.greatest
    h = grid.withColumn("_m", f(value).over(_along("h").rangeBetween(-half, half)))
    if shape == "rect":
        return h.withColumn(out or how, f("_m").over(_along("v").rangeBetween(-half, half))).drop("_m")
    return h.withColumn(out or how, pick("_m", f(value).over(_along("v").rangeBetween(-half, half)))).drop("_m")


def row_profile(grid: DataFrame, value: str = "subj", taps: int = 9) -> DataFrame:
    """``image, row, total, smooth``: sums per row, and their mean over ``taps`` neighbouring rows."""
    sums = grid.groupBy("image", "row").agg(F.sum(value).alias("total"))
    w = Window.partitionBy("image").orderBy("row")
    return sums.withColumn("smooth", F.avg("total").over(w.rangeBetween(-(taps // 2), taps // 2)))


def profile_peak(profile: DataFrame, value: str = "smooth") -> DataFrame:
    """The row of greatest value per image, the first among equals."""
    return profile.groupBy("image").agg(F.max_by("row", F.struct(F.col(value), -F.col("row"))).alias("peak_row"))


def profile_gradient(profile: DataFrame, value: str = "total", clear_first: bool = False, taps: int = 1) -> DataFrame:
    """Difference to the row before; 0 in the first row. ``clear_first`` sets the first positive difference (the subject's upper edge) to 0;
    ``taps`` over 1 replaces differences by their mean over that many neighbouring rows."""
    w = Window.partitionBy("image").orderBy("row")
    out = profile.withColumn("gradient", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0)))
    if clear_first:
        first = F.min(F.when(F.col("gradient") > 0, F.col("row"))).over(Window.partitionBy("image"))
        out = out.withColumn("gradient", F.when(F.col("row") == first, F.lit(0)).otherwise(F.col("gradient")))
    return out.withColumn("gradient", F.avg("gradient").over(w.rangeBetween(-(taps // 2), taps // 2))) if taps > 1 else out


def mask_both(a: Column, b: Column) -> Column:
    """Pixels of both masks."""
    return a & b


def mask_either(a: Column, b: Column) -> Column:
    return a | b


def mask_minus(a: Column, b: Column) -> Column:
    """Pixels of the first mask that the second lacks."""
    return a & ~b


def extent(grid: DataFrame, by: Sequence[str], position: str, condition: Column) -> DataFrame:
    """First and last position at which a condition holds; null where it never does."""
    at = F.when(condition, F.col(position))
    return grid.groupBy(*by).agg(F.min(at).alias("first_pos"), F.max(at).alias("last_pos"))


def depth_mask(grid: DataFrame, least: int = 5000, out: str = "masked") -> DataFrame:
    """Depth, or 0 where it is under ``least`` or over the image's mean (zeros included in the mean)."""
    mean = F.avg("depth").over(Window.partitionBy("image"))
    return grid.withColumn(out, F.when((F.col("depth") < least) | (F.col("depth") > mean), 0).otherwise(F.col("depth")))


def normalised(grid: DataFrame, value: str, mask: str, out: str = "norm", top: int = NORM) -> DataFrame:
    """``value`` brought to 0..``top`` over the pixels of the mask of its image, half to even; 0 outside. The nearest pixel becomes 0 too."""
    seen = F.when(F.col(mask) != 0, F.col(value))
    w = Window.partitionBy("image")
    low, high = F.min(seen).over(w), F.max(seen).over(w)
    scaled = F.bround(F.try_divide((F.col(value) - low) * float(top), high - low))
    return grid.withColumn(out, F.when(F.col(mask) != 0, F.least(F.greatest(F.coalesce(scaled, F.lit(0.0)), F.lit(0.0)), F.lit(float(top)))).otherwise(0.0).cast("int"))


def view8(grid: DataFrame, value: str = "depth", out: str = "gray") -> DataFrame:
    """8-bit view of an image: (value - least) / greatest * 255, cut to int."""
    w = Window.partitionBy("image")
    return grid.withColumn(out, F.floor(F.coalesce(F.try_divide((F.col(value) - F.min(value).over(w)) * 255.0, F.max(value).over(w)), F.lit(0.0))).cast("int"))


# --- look-up at computed coordinates ---------------------------------------------------------------------------------------


def fetched(grid: DataFrame, directions: dict[str, tuple[int, int]], offset: int) -> DataFrame:
    """Foreground pixels with one column per direction (row step, column step): subj at the depth-scaled offset there, 0 outside.

    One join whatever the number of directions: requests are stacked, joined by coordinates, and gathered per pixel.
    """
    here = grid.where("subj <> 0").withColumn("_t", depth_offset(offset, "depth"))
    ask = F.explode(F.array(*[F.struct(F.lit(n).alias("d"), (F.col("row") + dr * F.col("_t")).alias("r"), (F.col("col") + dc * F.col("_t")).alias("c")) for n, (dr, dc) in directions.items()]))
    asked = here.select("image", "row", "col", ask.alias("a")).select("image", F.col("row").alias("_row"), F.col("col").alias("_col"), "a.*")
    there = grid.select("image", F.col("row").alias("r"), F.col("col").alias("c"), F.col("subj").alias("_s"))
    got = asked.join(there, ["image", "r", "c"], "left").groupBy("image", "_row", "_col").agg(*[F.coalesce(F.max(F.when(F.col("d") == n, F.col("_s"))), F.lit(0)).alias(n) for n in directions])
    return here.drop("_t").join(got.withColumnRenamed("_row", "row").withColumnRenamed("_col", "col"), ["image", "row", "col"])


def corner_feature(grid: DataFrame, offset: int, out: str = "f") -> DataFrame:
    """Feature 1: half the contrast of the diagonals of a square; 1000 if a corner is background."""
    at = fetched(grid, {"lu": (-1, -1), "ld": (1, -1), "ru": (-1, 1), "rd": (1, 1)}, offset // 2)
    empty = (F.col("lu") == 0) | (F.col("ld") == 0) | (F.col("ru") == 0) | (F.col("rd") == 0)
    return at.withColumn(out, F.when(empty, NORM).otherwise(F.floor(F.abs(F.col("lu") + F.col("rd") - F.col("ld") - F.col("ru")) / 2)).cast("int")).drop("lu", "ld", "ru", "rd")


def one_sided_feature(grid: DataFrame, offset: int, step: tuple[int, int], out: str = "f") -> DataFrame:
    """Features 2 to 4: the image's greatest contrast over a pixel's contrast to the one at ``step``, half to even."""
    at = fetched(grid, {"ref": step}, offset).withColumn("_v", F.greatest(F.abs(F.col("subj") - F.col("ref")), F.lit(1)))
    return at.withColumn(out, F.bround(F.max("_v").over(Window.partitionBy("image")) / F.col("_v")).cast("int")).drop("ref", "_v")


def two_sided_feature(grid: DataFrame, offset: int, first: tuple[int, int], second: tuple[int, int], least: int = 0, out: str = "f") -> DataFrame:
    """Features 5 to 10: contrast of two look-ups."""
    at = fetched(grid, {"r1": first, "r2": second}, offset)
    return at.withColumn(out, F.greatest(F.abs(F.col("r2") - F.col("r1")), F.lit(least)).cast("int")).drop("r1", "r2")


# --- dense kernels, one image per task ---------------------------------------------------------------------------------------

# Direction, offset and kind of features 1 to 10; 11 to 20 are the same at half the offset.
_LEFT, _RIGHT, _UP, _DOWN = (0, -1), (0, 1), (-1, 0), (1, 0)
_LU, _RU, _LD, _RD = (-1, -1), (-1, 1), (1, -1), (1, 1)
PLAN = (
    ("corner", 30), ("side", 20, _UP), ("side", 20, _LEFT), ("side", 20, _RIGHT), ("pair", 40, _LEFT, _RIGHT, 1),
    ("pair", 60, _UP, _DOWN, 0), ("full", 30, _UP, _LEFT, 0), ("full", 30, _UP, _RIGHT, 0), ("diagonal", 50, _LU, _RD, 0), ("diagonal", 50, _LD, _RU, 0),
)


def diagonal_offset(offset: int) -> int:
    return int(math.sqrt(offset * offset // 2)) // 2


def _round_half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).astype(np.int64)


def image_features(subj: np.ndarray, depth: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, col, features (n x 26)`` of the foreground of one dense image."""
    r, c = np.nonzero(subj)
    p = subj[r, c].astype(np.int64)
    d = depth[r, c].astype(float)
    out = np.zeros((len(r), 26), np.int64)

    def ref(step, t):
        y, x = r + step[0] * t, c + step[1] * t
        inside = (y >= 0) & (y < rows) & (x >= 0) & (x < cols)
        return np.where(inside, subj[np.clip(y, 0, rows - 1), np.clip(x, 0, cols - 1)], 0).astype(np.int64)

    def scaled(o):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = o / (d / 10_000)
        return _round_half_up(np.where(np.isfinite(t), t, 1e6))

    for half in (1, 2):
        for k, (kind, offset, *steps) in enumerate(PLAN):
            o = offset // half
            if kind == "corner":
                t = scaled(o // 2)
                lu, ld, ru, rd = (ref(s, t) for s in (_LU, _LD, _RU, _RD))
                v = np.where((lu == 0) | (ld == 0) | (ru == 0) | (rd == 0), NORM, np.abs(lu + rd - ld - ru) // 2)
            elif kind == "side":
                v = np.maximum(np.abs(p - ref(steps[0], scaled(o))), 1)
                v = np.rint(v.max(initial=0) / v).astype(np.int64)
            else:
                t = scaled(o // 2 if kind == "pair" else o if kind == "full" else diagonal_offset(o))
                v = np.maximum(np.abs(ref(steps[1], t) - ref(steps[0], t)), steps[2])
            out[:, k + 10 * (half - 1)] = v
    on = (subj != 0).astype(np.int64)
    h, v = on.cumsum(1), on.cumsum(0)
    for k, o in ((20, cols), (21, 20)):
        out[:, k] = cols + h[r, np.minimum(c + o, cols - 1)] - 2 * h[r, c] + h[r, np.maximum(c - o - 1, 0)]
    for k, o in ((22, rows), (23, 20)):
        out[:, k] = rows + v[np.minimum(r + o, rows - 1), c] - 2 * v[r, c] + v[np.maximum(r - o - 1, 0), c]
    padded = np.zeros((rows + 1, cols + 1), np.int64)
    padded[1:, 1:] = h.cumsum(0)
    for k, o in ((24, 20), (25, 50)):
        o = min(o, 42) // 2
        y0, y1, x0, x1 = np.maximum(r - o, 0), np.minimum(r + o, rows - 1) + 1, np.maximum(c - o, 0), np.minimum(c + o, cols - 1) + 1
        out[:, k] = padded[y1, x1] - padded[y0, x1] - padded[y1, x0] + padded[y0, x0]
    return r, c, out


def _dense(pdf: pd.DataFrame, column: str, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols), np.int64)
    out[pdf["row"].to_numpy(), pdf["col"].to_numpy()] = pdf[column].fillna(0).to_numpy()
    return out


def per_image(grid: DataFrame, kernel, schema: str, rows: int, cols: int, columns: Sequence[str]) -> DataFrame:
    """``kernel(dense arrays of columns...) -> dict of flat arrays`` for every image; image and results are added to the rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = kernel(*[_dense(pdf, c, rows, cols) for c in columns])
        return pd.DataFrame({"image": pdf["image"].iloc[0], **got})

    return grid.select("image", "row", "col", *columns).groupBy("image").applyInPandas(run, "image bigint, " + schema)


def features26(grid: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """``image, row, col, f0..f25`` of every foreground pixel."""

    def kernel(subj, depth):
        r, c, x = image_features(subj, depth, rows, cols)
        return {"row": r, "col": c} | {f: x[:, i] for i, f in enumerate(features())}

    return per_image(grid, kernel, "row int, col int, " + ", ".join(f"{f} int" for f in features()), rows, cols, ["subj", "depth"])


def components(mask: np.ndarray) -> np.ndarray:
    """8-connected components numbered from 1 in raster order of their first pixel; 0 is background.

    Union-find over runs of foreground pixels, so that Python runs per run and not per pixel.
    """
    rows, cols = mask.shape
    edge = np.diff(np.pad((mask != 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r0, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    parent = list(range(len(r0)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(r0, np.arange(rows + 1))
    for r in range(1, rows):
        a, a1, b = first[r - 1], first[r], first[r]
        while a < a1 and b < first[r + 1]:
            if start[a] <= end[b] and start[b] <= end[a]:  # ends are exclusive, so touching corners count
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    roots = [find(i) for i in range(len(r0))]
    number = {x: i for i, x in enumerate(sorted(set(roots)), 1)}
    out = np.zeros((rows, cols), np.int64)
    for i, root in enumerate(roots):
        out[r0[i], start[i] : end[i]] = number[root]
    return out


def connected_components(grid: DataFrame, mask: str = "subj", rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """``image, row, col, component`` of foreground pixels."""

    def kernel(m):
        label = components(m)
        r, c = np.nonzero(label)
        return {"row": r, "col": c, "component": label[r, c]}

    return per_image(grid, kernel, "row int, col int, component int", rows, cols, [mask])


def subject(grid: DataFrame, rows: int = ROWS, cols: int = COLS, least: int = 5000) -> DataFrame:
    """``image, row, col, subj``: the largest connected part of the plausible depths, smoothed and normalised; background isn't listed."""

    def kernel(depth):
        masked = np.where((depth < least) | (depth > depth.mean()), 0, depth)
        label = components(masked)
        if not label.any():
            return {"row": [], "col": [], "subj": []}
        largest = int(np.argmax(np.bincount(label.ravel())[1:])) + 1
        m = np.pad((label == largest).astype(np.int64), 1, mode="edge")
        m = sum(m[i : i + rows, j : j + cols] for i in range(3) for j in range(3)) >= 5
        if not m.any():
            return {"row": [], "col": [], "subj": []}
        low, high = masked[m].min(), masked[m].max()
        norm = np.rint((masked - low) * (NORM / (high - low))) if high > low else np.zeros_like(masked)
        norm = np.where(m, np.clip(norm, 0, NORM), 0).astype(np.int64)
        r, c = np.nonzero(norm)
        return {"row": r, "col": c, "subj": norm[r, c]}

    return per_image(grid, kernel, "row int, col int, subj int", rows, cols, ["depth"])


def _cross(m: np.ndarray, f) -> np.ndarray:
    p = np.pad(m, 1, constant_values=f is np.minimum)
    out = p[1:-1, 1:-1]
    for s in (p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]):
        out = f(out, s)
    return out


def skeleton_mask(mask: np.ndarray) -> np.ndarray:
    """What each erosion by a cross would lose beyond opening, gathered until nothing is left."""
    m, out = mask != 0, np.zeros(mask.shape, bool)
    while m.any():
        eroded = _cross(m, np.minimum)
        out |= m & ~_cross(eroded, np.maximum)
        if (eroded == m).all():  # all foreground: outside the image is foreground too
            break
        m = eroded
    return out


def skeleton(grid: DataFrame, mask: str = "subj", rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """``image, row, col`` of the morphological skeleton."""

    def kernel(m):
        r, c = np.nonzero(skeleton_mask(m))
        return {"row": r, "col": c}

    return per_image(grid, kernel, "row int, col int", rows, cols, [mask])


def silhouette(grid: DataFrame) -> DataFrame:
    """Experimental. ``image, head_row, head_col, neck_row, neck_col, shoulder_row, left_col, right_col, sternum_row, sternum_col``: landmarks from the
    row profile: the head's top is the first foreground row, the shoulders' row the steepest widening of the profile, the neck its
    narrowest row above that, the sternum one head height below the shoulders."""
    on = grid.where("subj <> 0")
    profile = on.groupBy("image", "row").agg(F.count("*").alias("n"), F.min("col").alias("l"), F.max("col").alias("r"), F.floor(F.avg("col")).cast("int").alias("m"))
    w = Window.partitionBy("image").orderBy("row")
    steep = profile.withColumn("_g", F.col("n") - F.coalesce(F.lag("n").over(w), F.col("n"))).withColumn("_top", F.min("row").over(Window.partitionBy("image")))
    shoulders = steep.groupBy("image").agg(F.max_by(F.struct("row", "l", "r", "m"), F.struct("_g", -F.col("row"))).alias("s"), F.min_by(F.struct("row", "m"), "row").alias("h"))
    neck = steep.join(shoulders, "image").where((F.col("row") < F.col("s.row")) & (F.col("row") >= F.floor((F.col("_top") + F.col("s.row")) / 2))).groupBy("image").agg(F.min_by(F.struct("row", "m"), F.struct("n", -F.col("row"))).alias("k"))
    both = shoulders.join(neck, "image", "left").withColumn("k", F.coalesce("k", "h"))
    return both.select(
        "image", F.col("h.row").alias("head_row"), F.col("h.m").alias("head_col"), F.col("k.row").alias("neck_row"), F.col("k.m").alias("neck_col"), F.col("s.row").alias("shoulder_row"), F.col("s.l").alias("left_col"),
        F.col("s.r").alias("right_col"), (2 * F.col("s.row") - F.col("h.row")).alias("sternum_row"), F.col("s.m").alias("sternum_col"),
    )


def stacked(planes: dict[str, DataFrame]) -> DataFrame:
    """Several planes ``image, row, col, <name>`` side by side, by position."""
    out = None
    for name, df in planes.items():
        one = df.select("image", "row", "col", name)
        out = one if out is None else out.join(one, ["image", "row", "col"])
    return out
