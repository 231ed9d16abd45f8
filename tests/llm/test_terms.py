from collections import Counter, defaultdict

from pixelgrove.llm import terms

CELLS = [(1, 5, None), (1, 5, None), (2, 5, 7), (3, 5, -1), (4, 6, 7), (5, 6, 8), (None, 9, 9), (6, 5, 8)]


def test_cells(spark):
    df = spark.createDataFrame([(*r, "x") for r in CELLS], "rec_id bigint, f0 int, f1 int, val string")
    got = {(r.feature, r.val): (r.in_records, r.occurrences, r.mark) for r in terms.cell_frequencies(df, features=["f0", "f1"], rare_below=2, common_share=0.5).collect()}
    once = {r[0]: r[1:] for r in CELLS if r[0] is not None}
    n = Counter((i, v) for cells in once.values() for i, v in enumerate(cells) if v not in (None, -1))
    assert got == {k: (c, c, "rare" if c < 2 else "common" if c > 0.5 * len(once) else "useful") for k, c in n.items()}


def test_lists(spark):
    lists = [(1, 0, [3, 1, 3]), (1, 0, [3, 1, 3]), (2, 0, [1]), (3, 0, None), (4, 0, []), (5, 0, [1, None, 2]), (6, 1, [1]), (7, None, [4]), (8, 0, [1, 9])]
    df = spark.createDataFrame(lists, "uv_id bigint, feature int, vals array<int>")
    got = {(r.feature, r.val): (r.occurrences, r.in_records, r.mark) for r in terms.list_frequencies(df, rare_below=2, common_share=0.6).collect()}
    once = {r[0]: r[1:] for r in lists}
    occ, inn, total = Counter(), Counter(), Counter()
    for f, v in once.values():
        if v is None:
            continue
        total[f] += 1
        for x in v:
            if x is not None:
                occ[f, x] += 1
        for x in set(v) - {None}:
            inn[f, x] += 1
    assert got == {k: (occ[k], c, "rare" if c < 2 else "common" if c > 0.6 * total[k[0]] else "useful") for k, c in inn.items()}


def test_hot_value_and_not_useful(spark):
    df = spark.range(2000).selectExpr("id rec_id", "if(id % 3 = 0, 42, cast(id as int)) f0")
    rows = terms.cell_frequencies(df, features=["f0"]).collect()
    marks = defaultdict(int)
    for r in rows:
        marks[r.mark] += 1
    assert marks == {"common": 1, "rare": 1333}  # 667 records share one value


def test_empty(spark):
    cells = spark.createDataFrame([], "rec_id bigint, " + ", ".join(f"f{i} int" for i in range(26)))
    lists = spark.createDataFrame([], "uv_id bigint, feature int, vals array<int>")
    assert terms.not_useful(cells, lists).collect() == []
