import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelgrove.functions import scalar
from pixelgrove.operators import grid, posture
from pixelgrove.plans import pipeline, tables
from pixelgrove.sources import frames, text
from pixelgrove.streaming import background

SIDE = 24


def images(spark, n=3, seed=0):
    """Bodies of smooth depth on an empty ground, labelled in quarters."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for r in range(SIDE):
            for c in range(SIDE):
                body = 4 <= r < 20 and 5 <= c < 19
                depth = 9000 + 20 * r + 10 * c + int(rng.integers(5)) if body else 30_000
                label = ("Head", "Neck", "LeftShoulder", "RightShoulder", "Sternum", "Other", "None")[(r // 4 + c // 5) % 7] if body else "None"
                rows.append((i, r, c, depth, label))
    df = spark.createDataFrame(rows, "image bigint, row int, col int, depth int, name string")
    return df.withColumn("k", scalar.category_colour("name")).select("image", "row", "col", "depth", "k.r", "k.g", "k.b", "name")


def test_frames_become_records_and_strains(spark):
    df = images(spark)
    records = pipeline.records_from_frames(df, SIDE, SIDE, skip=(1, 1)).cache()
    assert {r.image for r in records.select("image").distinct().collect()} == {0, 2}
    wrong = records.join(df, ["image", "row", "col"]).where("label <> name or label = 'None'").count()
    assert wrong == 0 and records.count() > 300
    trees = pipeline.forest_from_records(records.withColumn("rec_id", F.monotonically_increasing_id()), 2)
    knowledge = spark.createDataFrame([(i, [float(i)] * 18, *[i % 3] * 8) for i in range(7)], "entry_id bigint, mm array<double>, neck_left int, neck_back int, neck_right int, neck_front int, upper_left int, upper_back int, upper_right int, upper_front int")
    shown = df.select(F.lit(0).cast("bigint").alias("stream"), F.col("image").alias("frame"), "row", "col", "depth")
    got = pipeline.strains_from_frames(shown, trees, knowledge, rows=SIDE, cols=SIDE).collect()
    assert sorted(r.frame for r in got) == [0, 1, 2] and all(0 <= r.neck_left <= 10 for r in got)


def test_integral_saturates_inside_the_recurrence():
    rng = np.random.default_rng(1)
    mask = rng.random((9, 13)) < 0.7

    def slow(top):
        out = np.zeros((10, 14), int)
        for r in range(9):
            for c in range(13):
                out[r + 1, c + 1] = max(0, min(min(int(mask[r, c]) + out[r, c + 1], top) + out[r + 1, c], top) - out[r, c])
        return out[1:, 1:]

    assert (grid.integral_image(mask) == mask.cumsum(0).cumsum(1)).all()
    assert (grid.integral_image(mask, 20) == slow(20)).all() and not (grid.integral_image(mask, 20) == np.minimum(mask.cumsum(0).cumsum(1), 20)).all()


def test_all_foreground_has_an_end():
    assert not grid.skeleton_mask(np.ones((5, 5))).any()


def test_nearest_in_slices_keeps_ties(spark):
    rng = np.random.default_rng(2)
    entries = [(i, rng.integers(0, 2, 18).astype(float).tolist()) for i in range(5000)]
    knowledge = spark.createDataFrame(entries, "entry_id bigint, mm array<double>")
    queries = spark.createDataFrame([(i, rng.integers(0, 2, 18).astype(float).tolist()) for i in range(9)], "query_id bigint, vec array<double>")
    got = {(r.query_id, r.rank): r.entry_id for r in posture.nearest(queries, knowledge).collect()}
    for q in queries.collect():
        d = ((np.array([v for _, v in entries]) - np.array(q.vec)) ** 2).sum(1)
        assert [got[q.query_id, k + 1] for k in range(5)] == np.argsort(d, kind="stable")[:5].tolist()


def test_ordered_text_over_many_partitions(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, *(int(x) if x < 40 else None for x in rng.integers(0, 50, 3))) for i in range(300)]
    df = spark.createDataFrame(rows, "rec_id bigint, f0 int, f1 int, f2 int").repartition(5)
    lines = [r.value for r in text.ordered_text(df, ["f0", "f1", "f2"]).collect()]
    assert len(lines) == 300
    for f in range(3):
        pairs = [(int(x[16 * f + 12 : 16 * f + 16]), int(x[16 * f : 16 * f + 12])) for x in lines]
        assert pairs == sorted((9999 if r[f + 1] is None else r[f + 1], r[0]) for r in rows)


def test_frames_kept_freed_saved_and_read(spark, tmp_path):
    df = spark.createDataFrame([(s, f, s * 10 + f) for s in (1, 2) for f in range(4 + s)], "stream bigint, frame bigint, seq int")
    assert {r.seq for r in frames.without_snapshots(df, [10, 21]).collect()} == {11, 12, 13, 14, 20, 22, 23, 24, 25}
    frames.save_snapshots(df, str(tmp_path / "kept"), [12, 23])
    assert {r.seq for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == {12, 23}
    with pytest.raises(Exception, match="exists"):
        frames.save_snapshots(df, str(tmp_path / "kept"), [12])
    assert {(r.stream, r.frame) for r in frames.last_frame(df).collect()} == {(1, 4), (2, 5)}
    got = frames.per_row(df, lambda b: b[["seq"]] + 1, "seq int")
    assert {r.seq for r in got.collect()} == {r.seq + 1 for r in df.collect()}


def test_background_chain(spark):
    # a square comes nearer by a metre in the third frame; one pixel flickers
    rows = [(0, f, r, c, 9000 - (1000 if f == 2 and 2 <= r < 9 and 2 <= c < 9 else 0) - (1000 if f == 2 and (r, c) == (11, 11) else 0)) for f in range(4) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(rows, "stream bigint, frame bigint, row int, col int, depth bigint")
    got = {(r.frame, r.row, r.col): r for r in background.background_chain(df, sample=1, length=1).collect()}
    assert len(got) == len(rows)
    assert {r.model for r in got.values() if r.frame == 0} == {9000.0} and not any(r.motion for r in got.values())
    two = {(r.frame, r.row, r.col): r for r in background.background_chain(df, sample=2, length=1).collect()}
    assert two[3, 5, 5].model == 8000.0 and {(r, c) for (f, r, c), x in two.items() if x.motion and f == 3} == {(r, c) for r in range(4, 7) for c in range(4, 7)}
    assert {x.distance for (f, _, _), x in two.items()} == {10_000} and all(x.in_view for x in two.values())


def test_intermediate_tables_end_with_their_scope(spark):
    with tables.scope(spark):
        df = tables.materialise(spark.range(3))
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert df.count() == 3
    import os

    assert not os.path.exists(path)


def test_a_cluster_without_shared_folder_is_refused(monkeypatch, spark):
    class Conf:
        get = staticmethod(lambda k: None)

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session)
    assert tables.shared_dir(spark)


def test_of_unequal_deliveries_the_least_is_taken(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "c"), (3, "d"), (None, "e")], "k bigint, v string")
    assert {(r.k, r.v) for r in tables.one_per_key(df, "k").collect()} == {(1, "a"), (2, None), (3, "d")}
