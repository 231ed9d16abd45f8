import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelgrove.operators import posture
from pixelgrove.schema import MEASUREMENTS, PARTS, STRAINS
from pixelgrove.streaming import background
from pixelgrove.streaming.tracking import distance_stream, track_stream

H = W = 80
SCHEMA = "stream bigint, frame bigint, row int, col int, depth int, category string"


def clip(frames=6, jump=4, seed=0):
    """Blobs of five parts that move; in frame ``jump`` one jumps far, in the last all are gone from one stream."""
    rng, rows = random.Random(seed), []
    for stream in (1, 2):
        for f in range(frames):
            for k, p in enumerate(PARTS):
                r0, c0 = 15 + 12 * k + f + (15 if f == jump and k == 0 else 0), 20 + 8 * k + f
                for _ in range(25):
                    r, c = r0 + rng.randint(-3, 3), c0 + rng.randint(-3, 3)
                    rows.append((stream, f, min(max(r, 0), H - 1), min(max(c, 0), W - 1), 5000 + r, p))
            rows.append((stream, f, 2, 2, 1, "Other"))
    return sorted(set(rows))


def test_mean_shift_stays_in_bounds_and_ends():
    r, c = np.array([10, 11, 12, 60]), np.array([10, 10, 10, 60])
    assert posture.mean_shift(r, c, (15, 12)) == (11, 10, True)
    assert posture.mean_shift(r[:0], c[:0], (5, 5)) == (5, 5, False)


def test_status_follows_drift_and_loss():
    t = posture.Tracker()
    blob = lambda y, x: (np.array([y, y + 1, y - 1]), np.array([x, x, x]))
    first = {p: blob(20 + 5 * i, 30) for i, p in enumerate(PARTS)}
    assert [x[3] for x in t.step(first, H, W)] == [1.0] * 5 and t.status == "TRACKED"
    moved = dict(first) | {"Head": blob(40, 45)}
    got = {p: (r, c, a) for p, r, c, a in t.step(moved, H, W)}
    assert got["Head"] == (40, 45, 0.8) and t.status == "INACCURATE"
    assert {a for *_, a in t.step({}, H, W)} == {0.0} and t.status == "UNTRACKED"


@pytest.fixture(scope="module")
def tracked(spark):
    rows = clip()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return rows, {tuple(r) for r in posture.track(df, H, W).collect()}


def test_batch_tracker_equals_one_pass_in_order(tracked):
    rows, got = tracked
    want = set()
    for s in (1, 2):
        t = posture.Tracker()
        for f in range(6):
            own = [r for r in rows if r[0] == s and r[1] == f and r[5] in PARTS]
            masks = {p: (np.array([r[2] for r in own if r[5] == p]), np.array([r[3] for r in own if r[5] == p])) for p in PARTS}
            depth = {(r[2], r[3]): r[4] for r in sorted(own)}
            want |= {(s, f, p, r, c, depth.get((r, c), 0), a, t.status) for p, r, c, a in t.step(masks, H, W)}
    drop = lambda x: {(*r[:5], *r[6:]) for r in x}  # noqa: E731 - two parts may share a pixel with different depths
    assert drop(got) == drop(want) and len({r[-1] for r in got}) > 1


def run(stream, tmp_path, out):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(out).parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path, tracked):
    rows, batch = tracked
    df = spark.createDataFrame(rows, SCHEMA)
    for f in range(0, 6, 2):  # three files, one per micro-batch
        df.where(F.col("frame").isin(f, f + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in run(track_stream(source, H, W), tmp_path, posture_schema()).collect()}
    drop = lambda x: {(*r[:5], *r[6:]) for r in x}
    assert drop(got) == drop(batch)


def posture_schema():
    from pixelgrove.schema import LOCATIONS

    return LOCATIONS


def test_adaptive_distance_batch_and_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, f, float(rng.randrange(4000, 20_000))) for s in (1, 2) for f in range(30)]
    df = spark.createDataFrame(rows, "stream bigint, frame bigint, greatest double")
    got = {tuple(r) for r in background.adaptive_distance(df.repartition(3)).collect()}
    want = set()
    for s in (1, 2):
        ring, at = [0.0] * 8, 0
        for _, f, v in [r for r in rows if r[0] == s]:
            ring[at] = v
            mean = int(sum(ring) / 8)
            if mean < 10_000:
                mean, ring[at] = 10_000, 10_000.0
            at = (at + 1) % 8
            want.add((s, f, mean))
    assert got == want
    df.where("frame < 15").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("frame >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    assert {tuple(r) for r in run(distance_stream(source), tmp_path, "stream bigint, frame bigint, distance bigint").collect()} == want


def test_background_model_counts_missing_history_as_zero(spark):
    df = spark.createDataFrame([(1, f, 0, 0, 100 * (f + 1)) for f in range(8)], "stream bigint, frame bigint, row int, col int, depth int")
    got = {r.frame: r.model for r in background.background_model(df, sample=2).collect()}
    assert got == {0: 25.0, 2: 100.0, 4: 225.0, 6: 400.0}


def test_nearest_is_exact_with_ties_and_few_entries(spark):
    rng = np.random.default_rng(0)
    queries, entries = rng.integers(0, 4, (40, 3)).astype(float), rng.integers(0, 4, (20, 3)).astype(float)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vec array<double>")
    k = spark.createDataFrame([(i, v.tolist(), *([i % 3] * 8)) for i, v in enumerate(entries)], "entry_id bigint, mm array<double>, " + ", ".join(f"{c} int" for c in STRAINS))
    near = posture.nearest(q, k, 5)
    got = {}
    for r in near.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.entry_id)
    for i, v in enumerate(queries):
        assert got[i] == sorted(range(20), key=lambda j, v=v: (((entries[j] - v) ** 2).sum(), j))[:5]
    totals = {r.query_id: r.neck_left for r in posture.strain_totals(near, k).collect()}
    assert totals == {i: sum(j % 3 for j in js) for i, js in got.items()}
    assert posture.nearest(q, k.limit(0), 5).count() == 0 and posture.nearest(q, k.limit(2), 5).count() == 80
    with pytest.raises(ValueError):
        posture.nearest(q, k, 5, most_entries=10)


def test_measurements(spark):
    point = lambda x, y, z: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(z)).alias("z"))
    xyz = {"Head": (0, 0, 0), "Neck": (1, 2, 2), "LeftShoulder": (3, 4, 0), "RightShoulder": (0, 0, 5), "Sternum": (2, 3, 6)}
    row = spark.range(1).select(*posture.measurements({p: point(*v) for p, v in xyz.items()})).collect()[0].asDict()
    assert list(row) == list(MEASUREMENTS)
    assert row["dist_head_l_shoulder"] == 5 and row["dist_head_sternum"] == 7 and row["off_head_neck"] == -1 and row["dep_r_shoulder_sternum"] == -1 and row["dist_neck_l_shoulder"] == pytest.approx(math.sqrt(12))
