import numpy as np
import pytest

from pixelgrove.functions import scalar
from pixelgrove.plans import train
from pixelgrove.plans.core_queries import trees
from pixelgrove.schema import STRAINS, Settings
from pixelgrove.sources import frames, images, text

GOLDEN = "D(1,868,5,2,7)\nD(2,25,3,3,4)\nR(3,C(LeftShoulder,1.000000))\nD(4,746,5,5,6)\nR(5,C(Other,0.541667),C(Sternum,0.458333))\nR(6,C(RightShoulder,1.000000))\nR(7,C(Head,1.000000))"


def test_dataset_round_trip_and_errors(spark, tmp_path):
    df = spark.createDataFrame([(7, 1, None, "Head"), (8, 1000, 20, "5")], "rec_id bigint, f0 int, f1 int, label string")
    text.write_dataset(df, str(tmp_path / "a"), ["f0", "f1"], rec_id="rec_id")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "a")).collect()) == ["000000000007 0001 65535 Head", "000000000008 1000 0020 5"]
    assert {tuple(r) for r in text.read_dataset(spark, str(tmp_path / "a"), 2, True).collect()} == {tuple(r) for r in df.collect()}
    with pytest.raises(Exception, match="exists"):
        text.write_dataset(df, str(tmp_path / "a"), ["f0", "f1"])
    (tmp_path / "b.txt").write_bytes(b"1 2 a\r\n\r\n3 -1 b\r\n")
    assert sorted(tuple(r) for r in text.read_dataset(spark, str(tmp_path / "b.txt"), 2).collect() if r.f1) == [(1, 2, "a")]
    (tmp_path / "c.txt").write_text("1 2 a\n3\n")
    with pytest.raises(Exception, match="too few fields"):
        text.read_dataset(spark, str(tmp_path / "c.txt"), 2).collect()
    (tmp_path / "d.txt").write_text("1 x a\n")
    with pytest.raises(Exception, match="not a number"):
        text.read_dataset(spark, str(tmp_path / "d.txt"), 2).collect()
    assert [tuple(r) for r in text.read_dataset(spark, str(tmp_path / "d.txt"), 2, mode="PERMISSIVE").collect()] == [(1, None, "a")]


def test_trees_round_trip(spark, tmp_path):
    (tmp_path / "one.txt").write_text(GOLDEN)
    nodes = text.read_trees(spark, str(tmp_path / "one.txt"))
    assert nodes.count() == 7 and {r.tree_id for r in nodes.collect()} == {"one"}
    leaf = nodes.where("node_id = 5").collect()[0]
    assert leaf.kind == "R" and leaf.ref_val is None and [(x.outcome, x.probability) for x in leaf.results] == [("Other", 0.541667), ("Sternum", 0.458333)]
    assert "\n".join(r.line for r in text.tree_lines(nodes).orderBy("node_id").collect()) == GOLDEN
    ours = train.nodes_table(spark, trees()[0])
    text.write_tree(ours, str(tmp_path / "t0"))
    again = text.read_trees(spark, str(tmp_path / "t0")).drop("tree_id")
    assert {str(r) for r in again.collect()} == {str(r) for r in ours.drop("tree_id").collect()}
    (tmp_path / "bad.txt").write_text("D(1,2,3)")
    with pytest.raises(Exception, match="no node"):
        text.read_trees(spark, str(tmp_path / "bad.txt")).collect()


def test_ordered_and_map(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 9), (2, 3, 9), (3, 4, None)], "rec_id bigint, f0 int, f1 int")
    lines = [r.value for r in text.ordered_text(df, ["f0", "f1"]).collect()]
    assert lines == ["00000000000200030000000000010009", "00000000000300040000000000020009", "00000000000100050000000000039999"]
    (tmp_path / "o.txt").write_text("\n".join(lines))
    got = {(r.feature, r.rec_id): r.value for r in text.read_ordered(spark, str(tmp_path / "o.txt"), 2).collect()}
    assert got == {(0, 1): 5, (0, 2): 3, (0, 3): 4, (1, 1): 9, (1, 2): 9, (1, 3): 9999}
    (tmp_path / "m.txt").write_text("0000000000015\n0000000000022\n")
    assert {tuple(r) for r in text.read_map(spark, str(tmp_path / "m.txt"), 2).collect()} == {(1, 5), (2, 2)}
    with pytest.raises(ValueError):
        text.read_map(spark, str(tmp_path / "m.txt"), 3)


def test_strains_and_knowledge(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1;S(P(0,1,2,0),P(0,0,0,1))\n150;S(P(0,0,0,0),P(2,0,0,0)\n")
    got = [r[1:] for r in text.read_strains(spark, str(tmp_path / "s.txt")).orderBy("line_no").collect()]
    assert got == [(1, 0, 1, 2, 0, 0, 0, 0, 1), (150, 0, 0, 0, 0, 2, 0, 0, 0)]
    rows = [([1.5, -2.25] + [float(i) for i in range(16)], *range(3), 0, 1, 2, 0, 1)]
    df = spark.createDataFrame(rows, "mm array<double>, " + ", ".join(f"{c} int" for c in STRAINS))
    text.write_knowledge(df, str(tmp_path / "k"))
    assert [tuple(r[1:]) for r in text.read_knowledge(spark, str(tmp_path / "k")).collect()] == [tuple(r) for r in df.collect()]


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    deep, colour = rng.integers(0, 65_536, (6, 5)), rng.integers(0, 256, (4, 3, 3))
    assert (images.decode(images.encode_png(deep)) == deep).all() and (images.decode(images.encode_png(colour, 8)) == colour).all()
    assert (images.decode(b"P5\n# made here\n5 6\n65535\n" + deep.astype(">u2").tobytes()) == deep).all()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "12.png").write_bytes(images.encode_png(deep))
    (tmp_path / "x" / "readme").write_bytes(b"?")
    got = np.zeros((6, 5), int)
    for r in images.read_images(spark, str(tmp_path / "x")).collect():
        assert r.image == 12
        got[r["row"], r["col"]] = r.depth
    assert (got == deep).all()
    assert images.missing_folders(spark, str(tmp_path / "x"), str(tmp_path / "y"), str(tmp_path / "z")) == [str(tmp_path / "y"), str(tmp_path / "z")]
    assert {r.name for r in images.listing(spark, str(tmp_path / "x")).collect()} == {"12.png", "readme"}


def test_png_filters():
    """Every line filter undoes itself: lines are filtered here by their definition."""
    import struct
    import zlib

    rng = np.random.default_rng(1)
    x, lines = rng.integers(0, 256, (5, 7)), b""
    for y in range(5):
        row, how = [], y
        for i in range(7):
            a, b = (x[y, i - 1] if i else 0), (x[y - 1, i] if y else 0)
            c = x[y - 1, i - 1] if i and y else 0
            p = int(a) + int(b) - int(c)
            guess = [0, a, b, (int(a) + int(b)) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][how]
            row.append((int(x[y, i]) - int(guess)) % 256)
        lines += bytes([how, *row])
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.decode_png(raw) == x).all()


def test_frames(spark, tmp_path):
    df = spark.range(100).selectExpr("id seq", "id * 2 value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = frames.read_frames(spark, str(tmp_path / "in"), "seq bigint, value bigint")
    frames.write_frames(stream, str(tmp_path / "out"), str(tmp_path / "state"), 30).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 30, 60, 90]
    seen = []
    writers = frames.dispatch({"depth": stream}, {"depth": [lambda b, n: seen.append(b.count()), lambda b, n: seen.append(b.where("seq < 5").count())]}, str(tmp_path / "listen"))
    writers["depth"].trigger(availableNow=True).start().awaitTermination()
    assert seen == [100, 5]
    assert frames.with_operations(df, [lambda d: d.where("seq > 97"), lambda d: d.selectExpr("seq + 1 seq")]).count() == 2


def test_bounded_split(spark):
    a, b = text.bounded(spark.range(1000).toDF("rec_id"), None, "rec_id", 0.7)
    assert a.count() + b.count() == 1000 and 600 < a.count() < 800 and a.intersect(b).count() == 0
    assert text.bounded(spark.range(1000).toDF("rec_id"), 10, "rec_id")[0].count() == 10


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.category_code(scalar._c(scalar.F.lit("\t hEAD "))).alias("a"), scalar.category_code(scalar.F.lit(None).cast("string")).alias("b"), scalar.category_name(scalar.F.lit(7)).alias("c"),
        scalar.colour_category(scalar.F.lit(255), scalar.F.lit(255), scalar.F.lit(0), "real").alias("d"), scalar.colour_category(scalar.F.lit(90), scalar.F.lit(90), scalar.F.lit(0), yellow_is_neck=True).alias("e"),
        scalar.file_number(scalar.F.lit("/x/0012_a.png")).alias("f"), scalar.file_number(scalar.F.lit("a1.png")).alias("g"), scalar.depth_offset(25, scalar.F.lit(20_000)).alias("h"), scalar.depth_offset(25, scalar.F.lit(0)).alias("i"),
        scalar.unpack_lookup(scalar.pack_lookup(scalar.F.lit(300), scalar.F.lit(1), scalar.F.lit(5))).alias("j"), scalar.category_colour(scalar.F.lit("x")).alias("k"),
    ).collect()[0]
    assert tuple(row[:9]) == (2, 99, "None", "Sternum", "Neck", 12, None, 13, None) and tuple(row.j) == (300, 1, 5) and tuple(row.k) == (127, 127, 127)
    with pytest.raises(ValueError):
        Settings(op="<")
