import re

from pixelgrove.sources import rejects

GOOD_STRAINS = ["7;S(P(0,1,2,0),P(0,0,0,0))", "007;S(P(0,1,2,0),P(0,0,0,0)\r", ' "2147483647;S(P(0,0,0,0),P(2,2,2,2))"\t', "1;S(P(0,0,0,0),P(0,0,0,0)"]
BAD_STRAINS = {
    "0;S(P(0,0,0,0),P(0,0,0,0))": "image out of range", "2147483648;S(P(0,0,0,0),P(0,0,0,0))": "image out of range", "99999999999;S(P(0,0,0,0),P(0,0,0,0))": "image out of range",
    "x;S(P(0,0,0,0),P(0,0,0,0))": "image is not a number", "7;S(P(0,0,0),P(0,0,0,0))": "number of strains", "7;S(P(0,0,0,3),P(0,0,0,0))": "strain is not 0, 1 or 2", "7;S(P(0, 0,0,0),P(0,0,0,0))": "strain is not 0, 1 or 2",
    "7;S(P(0,0,0,0),P(0,0,0,0)))": "frame", "7;S(P(0,0,0,0))": "frame", "7;s(P(0,0,0,0),P(0,0,0,0))": "frame", "7;S(P(0,0,0,0),P(0,0,0,0))\n": "frame", '""': "frame", '"': "frame", "٣;S(P(0,0,0,0),P(0,0,0,0))": "image is not a number",
    '"7;S("P(0,0,0,0),P(0,0,0,0))"': "frame", "7;S(P(0,²,0,0),P(0,0,0,0))": "strain is not 0, 1 or 2", "﻿7;S(P(0,0,0,0),P(0,0,0,0))": "image is not a number", "7" * 1000 + ";S(P(0,0,0,0),P(0,0,0,0))": "image out of range",
}
NUMBERS = ["1", "-2.5", "+3", "1e3", "1E-3", "2.50e+07", "0", "00.10", "1e999", "7", "7", "7", "7", "7", "7", "7", "7", "7"]
BAD_NUMBERS = ["", "nan", "inf", "1.", ".5", "1e", "0x1F", "1,5", " 1", "１", "--1", "1.2.3"]


def knowledge(values, tail=";S(P(0,1,0,2),P(0,0,0,0)))"):
    return f"MS(M({','.join(values)}){tail}"


def frame(spark, rows):
    return spark.createDataFrame([(i, k, "f", i, line, "clash") for i, (k, line) in enumerate(rows)], "line_id bigint, kind string, file_name string, line_no int, line string, reason string")


def test_reasons(spark):
    rows = [("strains", x) for x in BAD_STRAINS] + [("knowledge", knowledge([b, *NUMBERS[1:]])) for b in BAD_NUMBERS] + [("knowledge", knowledge(NUMBERS[:17])), (None, GOOD_STRAINS[0]), ("other", "x"), ("knowledge", GOOD_STRAINS[0])]
    rows += [("knowledge", knowledge(NUMBERS, ",S(P(0,1,0,2),P(0,0,0,0)))")), ("knowledge", knowledge(NUMBERS) * 2)]
    df = frame(spark, rows)
    got = {r.line_id: r.reason for r in rejects.rejected(df.union(df)).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i in range(len(BAD_STRAINS))] == list(BAD_STRAINS.values())
    for i, b in enumerate(BAD_NUMBERS):
        assert got[len(BAD_STRAINS) + i] == ("number of measurements" if b == "1,5" else "measurement is not a number"), b


def test_valid_lines_are_loaded_and_blank_ones_are_neither(spark):
    rows = [("strains", x) for x in GOOD_STRAINS] + [("knowledge", knowledge(NUMBERS)), ("knowledge", knowledge(NUMBERS)[:-1] + "  ")] + [("strains", x) for x in (None, "", " \t\r", "\r")]
    df = frame(spark, rows)
    assert rejects.rejected(df).collect() == []
    got = {r.line_id: r for r in rejects.loaded(df.union(df)).collect()}
    assert set(got) == set(range(6))
    assert [got[i].image for i in range(4)] == [7, 7, 2147483647, 1] and got[0].neck_back == 1 and got[0].neck_right == 2
    assert got[4].mm == got[5].mm == [float(x) for x in NUMBERS] and got[4].image is None and got[0].mm is None and got[5].neck_front == 2


def test_large_dictionary_is_joined_salted(spark, monkeypatch):
    monkeypatch.setattr(rejects, "DICTIONARY_ROWS", 3)
    rows = [("strains", x) for x in [*GOOD_STRAINS, *BAD_STRAINS]]
    got = {r.line_id for r in rejects.rejected(frame(spark, rows)).collect()}
    assert got == set(range(len(GOOD_STRAINS), len(rows)))


def test_against_a_pattern(spark):
    import random

    rng = random.Random(0)
    exact = re.compile(r"0*[1-9][0-9]{0,8};S\(P\([012](,[012]){3}\),P\([012](,[012]){3}\)\)?")
    base, rows = "12;S(P(0,1,2,0),P(0,0,1,0))", []
    for _ in range(300):
        x = list(base)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(x))
            x[k : k + rng.randrange(2)] = rng.choice(["", "0", "3", ",", ")", "(", ";", "P", "x"])
        rows.append(("strains", "".join(x)))
    got = {r.line_id for r in rejects.rejected(frame(spark, rows)).collect()}
    assert got == {i for i, (_, x) in enumerate(rows) if x and not exact.fullmatch(x)}


def test_empty(spark):
    assert rejects.rejected(frame(spark, [])).collect() == [] and rejects.loaded(frame(spark, [])).collect() == []


def test_long_cells_are_judged_by_their_form(spark):
    tail = "S(P(0,1,2,0),P(0,0,0,0))"
    numbers = lambda first, last="1": f"MS(M({','.join([first, *['1'] * 16, last])});{tail})"
    lines = [
        (1, "strains", "0" * 500 + "7;" + tail), (2, "strains", "0" * 500 + ";" + tail), (3, "knowledge", numbers("0." + "3" * 600)), (4, "knowledge", numbers("3" * 600 + "x")),
        (5, "knowledge", numbers("0" * 500 + "2", "y")), (6, "strains", "7;S(P(" + "0" * 500 + ",1,2,0),P(0,0,0,0))"),
    ]
    df = spark.createDataFrame([(i, k, "f", 1, x) for i, k, x in lines], "line_id bigint, kind string, file_name string, line_no int, line string")
    good = {r.line_id: r for r in rejects.loaded(df).collect()}
    assert set(good) == {1, 3} and good[1].image == 7 and abs(good[3].mm[0] - 1 / 3) < 1e-12
    said = {r.line_id: r.reason for r in rejects.rejected(df).collect()}
    assert said == {2: "image out of range", 4: "measurement is not a number", 5: "measurement is not a number", 6: "strain is not 0, 1 or 2"}
    shown = {r.line_id: r.detail for r in rejects.rejected(df).collect()}
    assert shown[2] == "0" * 500 and shown[4] == "3" * 600 + "x" and shown[5] == "y"


def test_of_unequal_deliveries_one_is_taken(spark):
    rows = [(1, "strains", "b", 1, "7;x"), (1, "strains", "a", 1, GOOD_STRAINS[0]), (2, "strains", "a", 2, None), (2, "strains", "a", 2, "y")]
    df = spark.createDataFrame(rows, "line_id bigint, kind string, file_name string, line_no int, line string")
    assert [(r.line_id, r.file_name) for r in rejects.loaded(df).collect()] == [(1, "a")]
    assert [(r.line_id, r.reason) for r in rejects.rejected(df).collect()] == [(2, "frame")]
