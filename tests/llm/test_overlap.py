import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelgrove.llm import overlap
from pixelgrove.llm.queries import p6_shifted

N = 26
SCHEMA = "rec_id bigint, data_split string, sensor_id string, outcome string, same boolean, key string, " + ", ".join(f"f{i} int" for i in range(N))


def frame(spark, rows):
    return spark.createDataFrame([(i, s, f"S{(i or 0) % 3}", o, None, "k", *c) for i, s, o, c in rows], SCHEMA).repartition(3)


def brute(rows):
    seen, out = {}, set()
    for i, s, o, c in rows:
        o = (o or "").strip().lower()
        if i is not None and o in ("head", "other") and s is not None:
            seen[i] = (s, o, [None if x in (None, -1) else x for x in c])
    train = [(i, o, c) for i, (s, o, c) in seen.items() if s == "train"]
    for j, (s, o, c) in seen.items():
        if s == "train":
            continue
        for i, p, d in train:
            if o == p and sum((x is None and y is None) or (x is not None and y is not None and abs(x - y) <= 2) for x, y in zip(c, d, strict=True)) >= 23:
                out.add((min(i, j), max(i, j)))
    return out


def planted(seed=0, n=250, top=1000):
    rng = random.Random(seed)
    cell = lambda: rng.choice([None, -1, 0, top]) if rng.random() < 0.15 else rng.randrange(top)
    rows = []
    for i in range(n):
        rows.append((i, rng.choice(["train", "train", "train", "test", "validation", None]), rng.choice(["Head", " other", "OTHER\t", "None", None]), [cell() for _ in range(N)]))
    for i in range(n, 2 * n):  # near copies: small changes everywhere, up to four large ones
        _, _, o, c = rng.choice(rows)
        c = [x if x in (None, -1) else max(0, x + rng.randint(-2, 2)) for x in c]
        for k in rng.sample(range(N), rng.randrange(5)):
            c[k] = cell()
        rows.append((i, rng.choice(["train", "test"]), o, c))
    return rows + rows[:5] + [(None, "test", "Head", rows[0][3])]


def test_pairs_equal_brute_force(spark):
    rows = planted()
    want = brute(rows)
    assert len(want) > 40
    assert {tuple(r) for r in overlap.record_pairs(frame(spark, rows)).collect()} == want


def test_hot_keys_and_copies_lose_nothing(spark, monkeypatch):
    rows = planted(1, 120, 40)  # few values: crowded keys
    base = rows[0][3]
    rows += [(10_000 + i, "train" if i % 2 else "test", "Head", base) for i in range(60)]
    want = brute(rows)
    original = overlap.overlapping
    monkeypatch.setattr(overlap, "overlapping", lambda records: original(records, hot=8, copies=10))
    assert {tuple(r) for r in overlap.record_pairs(frame(spark, rows)).collect()} == want
    report = {(r.data_split, r.sensor_id): (r.records, r.same + r.near) for r in overlap.overlap_report(frame(spark, rows)).collect()}
    seen = {i: (s, o) for i, s, o, _ in rows if i is not None}
    met = {i for p in want for i in p}
    for (split, sensor), (n, hit) in report.items():
        own = [i for i, (s, o) in seen.items() if s == split and (o or "").strip().lower() in ("head", "other") and f"S{i % 3}" == sensor]
        assert (n, hit) == (len(own), len([i for i in own if i in met]))


def test_keys_hot_at_every_level_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PAIRS", 50)
    rows = planted(2, 80, 20)
    pairs, _ = overlap.overlapping(frame(spark, rows), hot=2, copies=10**6)
    got = [(min(r.train_id, r.eval_id), max(r.train_id, r.eval_id)) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def edit_distance(a, b):
    same = lambda x, y: (x is None and y is None) or (x is not None and y is not None and abs(x - y) <= 2)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (not same(x, y))))
        row = new
    return row[-1]


def test_shifted_cells_are_found_where_they_may_shift(spark):
    rng = random.Random(5)
    rows = [(i, "train", "Head", [rng.randrange(1000) for _ in range(N)]) for i in range(40)]
    for i in range(30):  # one cell lost, another inserted elsewhere, perhaps one changed
        c = list(rows[i][3])
        lost, put = rng.randrange(N), rng.randrange(N)
        c.pop(lost)
        c.insert(put, rng.randrange(1000))
        if i % 2:
            c[rng.randrange(N)] = rng.randrange(1000)
        rows.append((100 + i, "test", "Head", c))
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == "train" and b[1] == "test" and edit_distance(a[3], b[3]) <= 3}
    assert len(want) >= 30
    for hot in (1_000, 2):
        got = {(r.train_id, r.eval_id): r.differing for r in overlap.overlapping(frame(spark, rows), shift=1, hot=hot)[0].collect()}
        assert set(got) == want
        assert all(d == edit_distance(rows[t][3], rows[40 + e - 100][3]) for (t, e), d in got.items())
    assert len(overlap.overlapping(frame(spark, rows))[0].collect()) < len(want)


def test_copies_of_shifted_records_are_written_out(spark, tmp_path):
    rng = random.Random(7)
    base = [rng.randrange(1000) for _ in range(N)]
    moved = base[1:] + [rng.randrange(1000)]
    copies = lambda first, n, split, c: [(first + i, split, "Head", c) for i in range(n)]
    rows = copies(0, overlap.COPIES + 6, "train", base) + copies(1000, 3, "test", moved) + copies(2000, overlap.COPIES + 1, "validation", moved)
    rows += copies(3000, 2, "train", moved) + copies(4000, 1, "test", base)
    want = {(min(t[0], e[0]), max(t[0], e[0])): 2 for t in rows for e in rows if t[1] == "train" and e[1] != "train" and t[3] != e[3]}
    assert len(want) == 70 * 68 + 2
    frame(spark, rows + rows[:5]).write.parquet(str(tmp_path / "records.parquet"))
    got = [tuple(r) for r in p6_shifted(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want


def test_segments_are_disjoint_runs():
    runs = overlap.segments([list(range(26))], 3)
    assert [len(x) for x in runs] == [6, 7, 6, 7] and sum(runs, []) == list(range(26))
    left = overlap.without([list(range(26))], runs[1])
    again = overlap.segments(left, 3)
    assert len(again) == 4 and sorted(sum(again, [])) == sorted(sum(left, [])) and all(x == list(range(x[0], x[-1] + 1)) for x in again)
    assert overlap.segments([[1, 2], [5]], 3) == [[]]


@given(st.lists(st.integers(0, 3), min_size=5, max_size=5), st.lists(st.integers(0, 3), min_size=5, max_size=5), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_banded_distance_is_the_edit_distance(a, b, band):
    table = [[0] * 6 for _ in range(6)]
    for i in range(6):
        for j in range(6):
            if not i or not j:
                table[i][j] = i + j
            else:
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    got = int(overlap.banded_distance(np.array([a]), np.array([b]), band, 0)[0])
    assert got >= table[5][5]
    if band >= table[5][5] or band == 4:
        assert got == table[5][5]
    if band == 0:
        assert got == sum(x != y for x, y in zip(a, b, strict=True))


def test_empty_splits(spark):
    assert overlap.record_pairs(frame(spark, [])).collect() == []
    assert overlap.record_pairs(frame(spark, [(1, "train", "Head", [1] * N)])).collect() == []
    assert overlap.overlap_report(frame(spark, [(1, "train", "Head", [1] * N)])).collect() == []


def test_records_that_lack_everything(spark):
    rows = [(1, "train", "Head", [None] * N), (2, "test", "head ", [-1] * N), (3, "test", "Other", [-1] * N)]
    assert [tuple(r) for r in overlap.record_pairs(frame(spark, rows)).collect()] == [(1, 2)]


def test_equal_cells_of_different_outcomes_are_no_pairs(spark):
    outcomes = ("LeftShoulder", "RightShoulder", "Head", "Neck", "Sternum", "Other")
    for cells in ([None] * N, [7] * N):
        rows = [(i, "train" if i < 3 else "test", o, cells) for i, o in enumerate(outcomes)]
        for shift in (0, 1):
            assert overlap.overlapping(frame(spark, rows), shift=shift)[0].collect() == []
