import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelgrove.operators import grid

H, W = 12, 15


def image(seed=0, share=0.6):
    rng = np.random.default_rng(seed)
    subj = np.where(rng.random((H, W)) < share, rng.integers(1, 1001, (H, W)), 0)
    return subj, rng.integers(4000, 40_000, (H, W))


def frame(spark, *images):
    rows = [(k, r, c, int(s[r, c]), int(d[r, c])) for k, (s, d) in enumerate(images) for r in range(H) for c in range(W)]
    return spark.createDataFrame(rows, "image bigint, row int, col int, subj int, depth int").repartition(3)


def plane(df, name, k=0, fill=0):
    out = np.full((H, W), fill)
    for r in df.where(F.col("image") == k).collect():
        out[r["row"], r["col"]] = r[name]
    return out


def test_prefix_counts_and_boxes(spark):
    s, d = image()
    df, on = frame(spark, (s, d)), (s != 0).astype(int)
    assert (plane(grid.horizontal_counts(df), "h") == on.cumsum(1)).all()
    assert (plane(grid.vertical_counts(df), "v") == on.cumsum(0)).all()
    assert (plane(grid.integral(df), "integral") == on.cumsum(0).cumsum(1)).all()
    box = np.array([[on[max(0, r - 5) : r + 6, max(0, c - 5) : c + 6].sum() for c in range(W)] for r in range(H)])
    assert (plane(grid.box_counts(df, 10), "box") == box).all()


def test_features_by_windows_and_joins_equal_the_kernel(spark):
    images = [image(1), image(2, 0.9)]
    df = frame(spark, *images)
    kernel = grid.features26(df, H, W)
    up, down, left, right = (-1, 0), (1, 0), (0, -1), (0, 1)
    same = {
        "f0": grid.corner_feature(df, 30), "f1": grid.one_sided_feature(df, 20, up), "f2": grid.one_sided_feature(df, 20, left), "f3": grid.one_sided_feature(df, 20, right),
        "f4": grid.two_sided_feature(df, 20, left, right, 1), "f5": grid.two_sided_feature(df, 30, up, down), "f6": grid.two_sided_feature(df, 30, up, left), "f7": grid.two_sided_feature(df, 30, up, right),
        "f8": grid.two_sided_feature(df, 17, (-1, -1), (1, 1)), "f19": grid.two_sided_feature(df, 8, (1, -1), (-1, 1)), "f10": grid.corner_feature(df, 15), "f14": grid.two_sided_feature(df, 10, left, right, 1),
        "f20": grid.balance(df, "h", W, W, "f"), "f21": grid.balance(df, "h", 20, W, "f"), "f22": grid.balance(df, "v", H, H, "f"), "f23": grid.balance(df, "v", 20, H, "f"), "f24": grid.box_counts(df, 20, "f"), "f25": grid.box_counts(df, 50, "f"),
    }
    for k, (s, _) in enumerate(images):
        for name, other in same.items():
            a, b = plane(kernel, name, k), plane(other, "f", k)
            assert (a[s != 0] == b[s != 0]).all(), name


@given(st.lists(st.lists(st.booleans(), min_size=9, max_size=9), min_size=7, max_size=7))
@settings(max_examples=150, deadline=None)
def test_components_equal_flood_fill(mask):
    m = np.array(mask)
    want, n = np.zeros(m.shape, int), 0
    for r in range(m.shape[0]):
        for c in range(m.shape[1]):
            if m[r, c] and not want[r, c]:
                n += 1
                stack = [(r, c)]
                while stack:
                    y, x = stack.pop()
                    if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x] and not want[y, x]:
                        want[y, x] = n
                        stack += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert (grid.components(m) == want).all()


def test_morphology(spark):
    s, d = image(3)
    df = frame(spark, (s, d))
    around = lambda f, half: np.array([[f(s[max(0, r - half) : r + half + 1, max(0, c - half) : c + half + 1]) for c in range(W)] for r in range(H)])
    assert (plane(grid.morph(df, "subj", "erode", 5), "erode") == around(np.min, 2)).all()
    assert (plane(grid.morph(df, "subj", "dilate", 3), "dilate") == around(np.max, 1)).all()
    p = np.pad((s != 0).astype(int), 1, mode="edge")
    want = sum(p[i : i + H, j : j + W] for i in range(3) for j in range(3)) >= 5
    assert (plane(grid.median3(df.withColumn("on", (F.col("subj") != 0).cast("int"))), "median") == want).all()


def test_skeleton_lies_inside_and_rebuilds_a_line():
    m = np.zeros((9, 9), int)
    m[4, 1:8] = 1
    assert (grid.skeleton_mask(m) == (m != 0)).all()
    m[3:6, 1:8] = 1
    assert (grid.skeleton_mask(m) <= (m != 0)).all() and grid.skeleton_mask(m).any() and not grid.skeleton_mask(m * 0).any()


def test_subject_is_the_largest_part(spark):
    depth = np.zeros((H, W), int)
    depth[1:6, 1:6] = np.arange(25).reshape(5, 5) * 10 + 6000
    depth[9:11, 10:12] = 6100
    depth[0, 14] = 4000
    df = frame(spark, (depth, depth))
    got = plane(grid.subject(df, H, W, 5000), "subj")
    # of the plausible depths (up to the image's mean there are none here): nothing is found
    assert depth.mean() < 6000 and not got.any()
    depth[depth == 0] = 30_000
    got = plane(grid.subject(frame(spark, (depth, depth)), H, W, 5000), "subj")
    assert got[5, 5] == 0 or got.max() == 1000
    assert not got[9:11, 10:12].any() and got[2, 2] > 0


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(spark, n):
    df = frame(spark, image()).limit(0) if n == 0 else spark.createDataFrame([(5, 0, 0, 7, 9000)], "image bigint, row int, col int, subj int, depth int")
    assert grid.features26(df, H, W).count() == n and grid.connected_components(df, "subj", H, W).count() == n
    assert grid.corner_feature(df, 30).count() == n and grid.integral(df).count() == n
    assert [r.f0 for r in grid.features26(df, H, W).collect()] == [1000] * n


def test_profiles(spark):
    s, d = image(4)
    df = frame(spark, (s, d))
    profile = {r["row"]: (r.total, r.smooth) for r in grid.row_profile(df).collect()}
    t = s.sum(1)
    assert all(profile[r] == (t[r], pytest.approx(t[max(0, r - 4) : r + 5].mean())) for r in range(H))
    assert grid.profile_peak(grid.row_profile(df), "total").collect()[0].peak_row == int(np.argmax(t))
    random.seed(0)
    landmarks = grid.silhouette(df).collect()[0]
    assert landmarks.head_row <= landmarks.neck_row <= landmarks.shoulder_row
