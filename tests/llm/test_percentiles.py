import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from pixelgrove.llm import percentiles as P


def test_relative_error_of_doubles(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(3, 4, 3000), -rng.lognormal(0, 3, 2000), np.zeros(50)])
    df = spark.createDataFrame([(0, float(v)) for v in values], "g int, v double")
    s = P.sketch(df, ["g"], "v", 0.01)
    exact = np.sort(values)
    for r in P.percentiles(s, ["g"], P.PERCENTILES, 0.01).collect():
        rank = max(1, math.ceil(r.pct * len(exact) / 100))
        true = exact[rank - 1]
        assert abs(r.value - true) <= 0.0101 * abs(true) + 1e-9
        assert r.rank_low <= rank <= r.rank_high and r.rank_high - r.rank_low >= r.rank_error


def test_combining_equals_the_whole(spark):
    df = spark.range(3000).selectExpr("cast(id % 7 as int) g", "cast((id * 7919) % 1601 - 800 as int) v", "id % 3 day")
    whole = P.sketch(df, ["g"], "v")
    parts = [P.sketch(df.where(F.col("day") == k), ["g"], "v") for k in range(3)]
    a = {tuple(r) for r in P.percentiles(whole, ["g"]).collect()}
    assert a == {tuple(r) for r in P.percentiles(P.combine(*parts, keys=["g"]), ["g"]).collect()}
    assert all(r.rank_error == 0 for r in P.percentiles(whole, ["g"]).collect())


def test_integers_are_exact(spark):
    df = spark.range(2049).selectExpr("0 g", "cast(id as int) v")
    got = {r.pct: r.value for r in P.percentiles(P.sketch(df, ["g"], "v"), ["g"]).collect()}
    assert got == {q: math.ceil(q * 2049 / 100) - 1 for q in P.PERCENTILES}


def test_nulls_nan_infinities_ties_and_empty(spark):
    rows = [(1, None), (1, float("nan")), (2, float("inf")), (2, float("-inf")), (2, 5.0), (2, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r.g, r.pct): r.value for r in P.percentiles(P.sketch(df, ["g"], "v"), ["g"], (1, 50, 99)).collect()}
    assert got == {(2, 1.0): -math.inf, (2, 50.0): 5.0, (2, 99.0): math.inf}
    assert P.percentiles(P.sketch(df.limit(0), ["g"], "v"), ["g"]).collect() == []


def test_records(spark):
    at = datetime.datetime(2024, 3, 4, 12)
    rows = [(1, " head", at, 10, -1, "a"), (1, " head", at, 10, -1, "b"), (2, "HEAD", None, 20, None, "c"), (3, None, at, 30, 7, "d"), (4, "Head\t", at, 40, 8, "e"), (None, "Head", at, 99, 9, "f")]
    df = spark.createDataFrame(rows, "rec_id bigint, outcome string, captured_at timestamp, f0 int, f1 int, bucket string")
    s = P.record_sketch(df, features=["f0", "f1"])
    sums = {(r.outcome, r.feature): r.n for r in s.groupBy("outcome", "feature").agg(F.sum("n").alias("n")).collect()}
    assert sums == {("Head", 0): 3, ("Head", 1): 1, ("None", 0): 1, ("None", 1): 1}
    assert {r.day for r in s.collect()} == {datetime.date(2024, 3, 4), None}
