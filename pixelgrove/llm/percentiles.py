"""Percentiles per group from mergeable counts in signed logarithmic buckets.

A value v falls into bucket sign(v) * ceil(log_gamma |v|), gamma = (1 + a) / (1 - a), zero into its own; the value returned for a
bucket lies within the relative error ``a`` of every value in it. A sketch is a table (group, bucket, n): sketches of days,
batches or partitions are combined by adding counts (``combine``), nothing else, in any order.

Rank error. The reported percentile has the exact bucket of the exact percentile, so its rank is off by at most the number of
values in that bucket less one, by none if they are all equal; ``rank_low`` to ``rank_high`` are the bucket's ranks, ``rank_error`` the bound. With the default
``a = 2**-12`` neighbouring integers up to 2,048 never share a bucket: there the value is the exact percentile and the rank error 0.

The q-th percentile is the smallest value whose rank is at least ``q / 100 * n`` (nearest rank). Null and -1 cells are no values;
records delivered twice count once; groups without values give no rows; a null outcome is the group ``None``, a null day stays
a group of its own (``day`` null). NaN is no value either; infinities keep their sign and rank beyond all numbers.

For the 26 integer columns of records the counting runs on Arrow batches: each task sorts the values of up to ``FLUSH`` records column by column
and sends one row per group with all its buckets packed. Packed sketches are merged as a stream, one group at a time, so that
no task holds more than one sketch, and written once; both levels of percentiles are read from that table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import OUTCOMES, feature_names, materialise, one_per_key, outcome_code, present

ACCURACY = 2.0**-12
PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
#: Records whose cells (26 numbers of 4 bytes) a task counts at once.
FLUSH = 500_000
_INFINITE = 2_000_000_000


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """Bucket number as int; strictly increasing in the value. Magnitudes below 1e-9 count as zero."""
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    size = F.abs(value.cast("double"))
    shift = math.ceil(math.log(1e-9) / gamma) - 1
    k = (F.ceil(F.log(size) / gamma - 1e-9) - shift).cast("int")
    return F.when(size < 1e-9, F.lit(0)).when(size == float("inf"), F.signum(value).cast("int") * _INFINITE).otherwise(F.signum(value.cast("double")).cast("int") * k)


def bucket_value(b: Column, accuracy: float = ACCURACY) -> Column:
    """The value that stands for a bucket: within ``accuracy`` (relative) of all its values."""
    gamma = (1 + accuracy) / (1 - accuracy)
    shift = math.ceil(math.log(1e-9) / math.log(gamma)) - 1
    mid = F.exp((F.abs(b) + shift) * math.log(gamma)) * (2 / (1 + gamma))
    return F.when(b == 0, F.lit(0.0)).when(F.abs(b) == _INFINITE, F.signum(b) * float("inf")).otherwise(F.signum(b) * mid)


def sketch(values: DataFrame, keys: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """``keys, bucket, n, low, high``: counts, least and greatest value of each bucket. Null and NaN are no values."""
    v = F.col(value)
    kept = values.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    return kept.select(*keys, bucket(v, accuracy).alias("bucket"), v.alias("_v")).groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def combine(*sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up per ``keys`` (all or fewer keys than they have)."""
    out = sketches[0].select(*keys, "bucket", "n", "low", "high")
    for s in sketches[1:]:
        out = out.unionByName(s.select(*keys, "bucket", "n", "low", "high"))
    return out.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def percentiles(sketched: DataFrame, keys: list[str], qs: tuple[float, ...] = PERCENTILES, accuracy: float = ACCURACY) -> DataFrame:
    """``keys, pct, value, rank_low, rank_high, rank_error, n_values``: one row per group and percentile.

    ``value`` is the bucket's stand-in, held within the least and greatest value seen there.
    """
    w = Window.partitionBy(*keys)
    running = sketched.withColumn("_to", F.sum("n").over(w.orderBy("bucket"))).withColumn("_all", F.sum("n").over(w))
    want = F.array(*[F.struct(F.lit(float(q)).alias("pct"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("_all") / 100.0)).cast("bigint").alias("rank")) for q in qs])
    hit = running.select("*", F.explode(F.filter(want, lambda x: (x["rank"] <= F.col("_to")) & (x["rank"] > F.col("_to") - F.col("n")))).alias("q"))
    value = F.least(F.greatest(bucket_value(F.col("bucket"), accuracy), F.col("low").cast("double")), F.col("high").cast("double"))
    return hit.select(*keys, F.col("q.pct").alias("pct"), value.alias("value"), (F.col("_to") - F.col("n") + 1).alias("rank_low"), F.col("_to").alias("rank_high"), F.when(F.col("low") == F.col("high"), 0).otherwise(F.col("n") - 1).alias("rank_error"), F.col("_all").alias("n_values"))


# --- integer columns of records, packed --------------------------------------------------------------------------------------


def _buckets(v: np.ndarray, accuracy: float) -> np.ndarray:
    """As ``bucket``, of integers."""
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    shift = math.ceil(math.log(1e-9) / gamma) - 1
    size = np.abs(v).astype(float)
    k = np.ceil(np.log(np.maximum(size, 1)) / gamma - 1e-9).astype(np.int64) - shift
    return np.where(v == 0, 0, np.sign(v) * k)


def _values(b: np.ndarray, accuracy: float) -> np.ndarray:
    gamma = (1 + accuracy) / (1 - accuracy)
    shift = math.ceil(math.log(1e-9) / math.log(gamma)) - 1
    return np.where(b == 0, 0.0, np.sign(b) * np.exp((np.abs(b) + shift) * math.log(gamma)) * (2 / (1 + gamma)))


def _pack(m: np.ndarray) -> bytes:
    """A 4 x n matrix (bucket, n, low, high; buckets ascending) as bytes: differences, byte plane by byte plane, compressed."""
    d = np.stack([np.diff(m[0], prepend=0), m[1], np.diff(m[2], prepend=0), m[3] - m[2]]).astype("<i8")
    return pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 32 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, 4 * n)
    d = np.ascontiguousarray(planes.T).view("<i8").reshape(4, n)
    low = d[2].cumsum()
    return np.stack([d[0].cumsum(), d[1], low, low + d[3]])


def _add(parts: list[np.ndarray]) -> np.ndarray:
    """The sum of sketches of one group."""
    if len(parts) == 1:
        return parts[0]
    m = np.concatenate(parts, 1)
    m = m[:, np.argsort(m[0], kind="stable")]
    at = np.flatnonzero(np.r_[True, m[0, 1:] != m[0, :-1]])
    return np.stack([m[0, at], np.add.reduceat(m[1], at), np.minimum.reduceat(m[2], at), np.maximum.reduceat(m[3], at)])


_PACKED = "g int, d int, n int, packed binary"


def _counted(batches, n_features: int, accuracy: float):
    """Columns o, d and cells in; one row per group (o * 1000 + feature, d) of every ``FLUSH`` records out."""

    def answer(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        o = t.column("o").to_numpy().astype(np.int64)
        day = t.column("d").cast(pa.int64()).fill_null(_NO_DAY).to_numpy()
        pairs, group = np.unique((o << 32) + (day - _NO_DAY), return_inverse=True)
        rows = []
        for i in range(n_features):
            c = t.column(2 + i).combine_chunks()
            valid = np.flatnonzero(c.is_valid().to_numpy(zero_copy_only=False))
            if not len(valid):
                continue
            v = c.fill_null(0).to_numpy().astype(np.int64)[valid]
            code, n = np.unique((group[valid] << 33) + (v + (1 << 32)), return_counts=True)
            at, value = code >> 33, (code & ((1 << 33) - 1)) - (1 << 32)
            b = _buckets(value, accuracy)
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (b[1:] != b[:-1])])
            last = np.r_[new[1:], len(b)] - 1
            m = np.stack([b[new], np.add.reduceat(n, new), value[new], value[last]])
            edges = np.flatnonzero(np.r_[True, np.diff(at[new]) != 0, True])
            for x, y in zip(edges, edges[1:], strict=False):
                k = int(pairs[at[new[x]]])
                d = (k & ((1 << 32) - 1)) + _NO_DAY
                rows.append(((k >> 32) * 1000 + i, None if d == _NO_DAY else d, y - x, _pack(m[:, x:y])))
        names = ["g", "d", "n", "packed"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= FLUSH:
            yield from answer(held)
            held, size = [], 0
    if size:
        yield from answer(held)


_NO_DAY = -(1 << 31)


def _grouped(frames, keys: list[str]):
    """``key, sketch`` of every group of rows sorted by ``keys``; one group is held at a time."""
    key, parts, held = None, [], 0
    for pdf in frames:
        columns = [[None if pd.isna(x) else int(x) for x in pdf[k]] for k in keys]
        for *k, n, packed in zip(*columns, pdf["n"].tolist(), pdf["packed"].tolist(), strict=True):
            if k != key:
                if parts:
                    yield key, _add(parts)
                key, parts, held = k, [], 0
            parts.append(_unpack(packed, n))
            held += n
            if held > 1_000_000:
                parts = [_add(parts)]
                held = 0
    if parts:
        yield key, _add(parts)


def _merged(frames, keys: list[str]):
    rows = []
    for key, m in _grouped(frames, keys):
        rows.append((*key, m.shape[1], _pack(m)))
        if len(rows) >= 1_000:
            yield pd.DataFrame(rows, columns=[*keys, "n", "packed"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=[*keys, "n", "packed"])


def _ranked(frames, keys: list[str], qs: tuple[float, ...], accuracy: float):
    names = [*keys, "pct", "value", "rank_low", "rank_high", "rank_error", "n_values"]
    rows = []
    for key, (b, n, low, high) in _grouped(frames, keys):
        upto = n.cumsum()
        rank = np.maximum(1, np.ceil(np.array(qs) * upto[-1] / 100.0)).astype(np.int64)
        at = np.searchsorted(upto, rank)
        value = np.clip(_values(b[at], accuracy), low[at], high[at])
        error = np.where(low[at] == high[at], 0, n[at] - 1)
        rows += [(*key, float(q), float(v), int(u - c + 1), int(u), int(e), int(upto[-1])) for q, v, u, c, e in zip(qs, value, upto[at], n[at], error, strict=True)]
        if len(rows) >= 10_000:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def packed_sketches(records: DataFrame, key: str = "rec_id", features: list[str] | None = None, accuracy: float = ACCURACY) -> DataFrame:
    """``g, d, n, packed``: one sketch per (outcome, feature, day), written to the shared folder. g is outcome code * 1000 + feature, d days since 1970.

    Files hold few days each, so most of a group comes from few tasks.
    """
    features = features or feature_names()
    fixed = records.select(key, outcome_code("outcome").alias("o"), F.datediff(F.col("captured_at"), F.lit("1970-01-01")).alias("d"), *[present(c).cast("int").alias(f"c{i}") for i, c in enumerate(features)])
    counted = one_per_key(fixed, key).drop(key).mapInArrow(lambda it: _counted(it, len(features), accuracy), _PACKED)
    return materialise(counted.repartition("g", "d").sortWithinPartitions("g", "d").mapInPandas(lambda it: _merged(it, ["g", "d"]), _PACKED))


def _decoded(coded: DataFrame, *rest: str) -> DataFrame:
    """``outcome, [day,] feature`` and the rest for g and d."""
    code = F.floor(F.col("g") / 1000).cast("int")
    name = F.when(code < len(OUTCOMES), F.element_at(F.array(*map(F.lit, OUTCOMES)), code + 1)).otherwise("None")
    day = [F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).alias("day")] if "d" in coded.columns else []
    return coded.select(name.alias("outcome"), *day, (F.col("g") % 1000).alias("feature"), *rest)


def record_sketch(records: DataFrame, key: str = "rec_id", features: list[str] | None = None, accuracy: float = ACCURACY) -> DataFrame:
    """``outcome, day, feature, bucket, n, low, high`` of all feature cells of distinct records; may be combined by ``combine``."""

    def run(frames):
        for pdf in frames:
            for s in range(0, len(pdf), 256):
                part = pdf.iloc[s : s + 256]
                n = part["n"].to_numpy(np.int64)
                m = np.concatenate([_unpack(p, k) for p, k in zip(part["packed"], n.tolist(), strict=True)], 1)
                yield pd.DataFrame({"g": np.repeat(part["g"].to_numpy(), n), "d": part["d"].astype("Int64").repeat(n).array, "bucket": m[0], "n": m[1], "low": m[2], "high": m[3]})

    return _decoded(packed_sketches(records, key, features, accuracy).mapInPandas(run, "g int, d int, bucket int, n bigint, low int, high int"), "bucket", "n", "low", "high")


def record_percentiles(records: DataFrame, accuracy: float = ACCURACY, qs: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``level, outcome, day, feature, pct, value, rank_low, rank_high, rank_error, n_values``, per outcome (``level='all'``, day null) and per
    outcome and capture day (``level='day'``). The first comes from the day sketches by addition."""
    days = packed_sketches(records, accuracy=accuracy)
    rest = ("pct", "value", "rank_low", "rank_high", "rank_error", "n_values")
    kinds = "pct double, value double, rank_low bigint, rank_high bigint, rank_error bigint, n_values bigint"
    per_day = days.mapInPandas(lambda it: _ranked(it, ["g", "d"], qs, accuracy), "g int, d int, " + kinds)
    whole = days.repartition("g").sortWithinPartitions("g").mapInPandas(lambda it: _ranked(it, ["g"], qs, accuracy), "g int, " + kinds)
    columns = ["level", "outcome", "day", "feature", *rest]
    per_day = _decoded(per_day, *rest).withColumn("level", F.lit("day"))
    whole = _decoded(whole, *rest).withColumns({"level": F.lit("all"), "day": F.lit(None).cast("date")})
    return whole.select(columns).unionByName(per_day.select(columns))
