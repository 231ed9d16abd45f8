from pixelgrove.operators import forest, joins
from pixelgrove.plans import core_queries, tables


def test_joins(spark):
    images = spark.createDataFrame([(1,), (2,), (3,), (None,)], "image int")
    strains = spark.createDataFrame([(9, 1, "late"), (4, 1, "first"), (5, 2, "two"), (6, None, "none")], "line_no int, image int, s string")
    got = {r.image: (r.s, r.found) for r in joins.looked_up(images, strains).collect()}
    assert got == {1: ("first", True), 2: ("two", True), 3: (None, False), None: (None, False)}
    assert tuple(joins.lookup_counts(joins.looked_up(images, strains)).collect()[0]) == (2, 2)
    assert {r.image for r in joins.missing(images, strains).collect()} == {3, None}
    assert joins.same_name(images, strains, "image").count() == 3
    cells, labels = spark.createDataFrame([(1, 5), (2, 6)], "rec_id int, v int"), spark.createDataFrame([(1, "a")], "rec_id int, l string")
    for most in (0, 10):
        assert [tuple(r) for r in joins.record_lookup(cells, labels, most=most).collect()] == [(1, 5, "a")]
    mapping = spark.createDataFrame([(1, 10), (2, None)], "old int, new int")
    assert [r.node_id for r in joins.remapped(spark.createDataFrame([(1,), (2,), (3,)], "node_id int"), mapping).collect()] == [10]


def test_single_record(spark):
    df = spark.range(3).selectExpr("id rec_id", "'Head' label", *[f"{i} f{i}" for i in range(26)])
    row = forest.check_record(df, 1, core_queries.trees(), core_queries.FEATURES).collect()
    assert len(row) == 1 and row[0].rec_id == 1 and row[0].correct == (row[0].vote == "Head")


def test_tracing_and_tables(spark):
    assert tables.traced(spark.range(5), "seen").count() == 5 and tables.traced(spark.range(5), "seen", False).count() == 5
    again = tables.materialise(spark.range(7).toDF("x"))
    assert again.count() == 7 and tables.small_enough(again, 7) and not tables.small_enough(again, 6)
    assert tables.materialise(spark.range(0).toDF("x")).count() == 0


def test_same_name_joins_whole_listings(spark, tmp_path):
    records = [(1, 7, "train"), (2, 7, "validation"), (3, 7, "test"), (3, 7, "test"), (4, 8, None), (5, 9, "train"), (6, None, "test")]
    spark.createDataFrame(records, "rec_id bigint, image int, data_split string").write.parquet(f"{tmp_path}/records.parquet")
    spark.createDataFrame([(70, 7), (70, 7), (71, 7), (80, 8), (81, None)], "mm_id bigint, image int").write.parquet(f"{tmp_path}/measurements.parquet")
    got = sorted((r.rec_id, r.mm_id) for r in core_queries.same_name(spark, str(tmp_path)).collect())
    assert got == [(1, 70), (1, 71), (2, 70), (2, 71), (3, 70), (3, 71), (4, 80)]
