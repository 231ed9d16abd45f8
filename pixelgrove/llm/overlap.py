"""Records of evaluation splits that appear, exactly or almost, in the training split.

Edit-distance segment join. A record is a string of 26 cells over the integers; two cells are the same character if both are
missing, or both present and at most ``TOLERANCE`` apart. A record of an evaluation split is cut into k + 1 segments; if at most k
edits turn it into a training record, one segment is met unchanged there, at most ``shift`` positions away. Training records emit their substrings at
all allowed positions of each segment. Columns have names and cannot shift, so the default is ``shift=0``: the only allowed
position is the segment's own, the band of the verifying dynamic program is the diagonal, and the distance is the number of differing
columns. With ``shift=1`` cells lost or inserted (columns displaced by a faulty export) are found too.

*Keys.* A cell falls into a bucket of ``WIDTHS[0]`` values. Training records emit one key per segment and position (outcome, segment, buckets);
evaluation records emit those of every bucket within the tolerance of each cell, about 1.1 per cell. Keys travel with the record's id and,
for ``shift=0``, a signature of 16 cells in 4 bits each; cells and texts stay behind.

*Matching.* One shuffle by key; each key's rows pass sorted, evaluation first. Pairs whose signatures differ in more than k
cells for certain are dropped at once; only the others leave the task.

*Hot keys.* A key of more than ``HOT`` rows forms no pairs: its rows, and only these, go on to the next level, where the cells outside the segment are cut into
k + 1 segments again (all differences have to lie in there) and the key grows by one of them, in narrower buckets. Keys still hot after the last level hold
near copies throughout; their rows are divided into blocks of ``HOT`` on both sides, and every pair of blocks is verified within one task.

*Copies.* Groups of at least ``COPIES`` records of a side equal in every cell and outcome take part with their smallest id;
``members`` says whom it stands for.

Defined results: outcome None or null takes no part; neither does a record without id or split. Missing planes are ordinary
missing cells; two records that lack everything agree in everything. Repeated deliveries count once; unequal ones count as one record each in the search,
and the pair is reported once. Empty splits give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, feature_names, materialise, one_per_key, outcome_code, present

MAX_DIFFERENT = 3
TOLERANCE = 2
WIDTHS = (32, 24, 16)
HOT = 1_024
COPIES = 64
#: Pairs whose signatures are compared at once.
PAIRS = 1_000_000
_MISSING = -(1 << 40)


def segments(runs: list[list[int]], k: int) -> list[list[int]]:
    """Runs of neighbouring positions cut into k + 1 pieces of nearly equal length, none across two runs; one empty piece if there are too few positions.

    Every run gets a piece for its length; the longest ones get those left over.
    """
    runs = [r for r in runs if r]
    n, parts = sum(map(len, runs)), k + 1
    if n < parts:
        return [[]]
    share = [len(r) * parts // n for r in runs]
    while sum(share) < parts:
        i = max(range(len(runs)), key=lambda i: len(runs[i]) / (share[i] + 1))
        share[i] += 1
    return [r[len(r) * i // m : len(r) * (i + 1) // m] for r, m in zip(runs, share, strict=True) for i in range(m)]


def without(runs: list[list[int]], piece: list[int]) -> list[list[int]]:
    """The runs left when a piece is taken out of one of them."""
    out = []
    for r in runs:
        if piece and piece[0] in r:
            at = r.index(piece[0])
            out += [r[:at], r[at + len(piece) :]]
        else:
            out.append(r)
    return [r for r in out if r]


def prepared(records: DataFrame, features: list[str]) -> DataFrame:
    """``rec_id, side, o, c0..`` of the records that take part; side 0 is training, 1 evaluation."""
    split = F.lower(F.trim(F.col("data_split")))
    side = F.when(split == "train", 0).when(split.isin("validation", "test"), 1)
    cells = [present(f).cast("int").alias(f"c{i}") for i, f in enumerate(features)]
    return records.select(F.col("rec_id").cast("bigint").alias("rec_id"), side.alias("side"), outcome_code("outcome").alias("o"), *cells).where("rec_id is not null and side is not null and o < 99")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class KeyMaker:
    """Keys of segments of rows of cells, level by level. A path names the segments met so far: one digit of base 32 per level."""

    n: int
    k: int = MAX_DIFFERENT
    tolerance: int = TOLERANCE
    widths: tuple[int, ...] = WIDTHS
    shift: int = 0

    def __post_init__(self):
        if min(self.widths) <= 2 * self.tolerance:
            raise ValueError("a bucket must be wider than twice the tolerance")
        if not 0 <= self.k < 31:
            raise ValueError("at most 30 differences")
        self.factor = _mix(np.arange(1, self.n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def rest(self, path: int) -> list[list[int]]:
        """Positions outside the segments of a path."""
        runs, digits = [list(range(self.n))], []
        while path:
            path, d = divmod(path, 32)
            digits.append(d - 1)
        for d in reversed(digits):
            runs = without(runs, segments(runs, self.k)[d])
        return runs

    def keys(self, cells: np.ndarray, seed: np.ndarray, probing: bool, path: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, key, path`` of the next level: ``seed`` is the outcome, or the key that ``path`` led to."""
        level = 0
        while path >> (5 * level):
            level += 1
        width, rows, keys, paths = self.widths[level], [], [], []
        for tag, segment in enumerate(segments(self.rest(path), self.k)):
            for shift in range(-self.shift, self.shift + 1) if not probing else (0,):
                if segment and not 0 <= segment[0] + shift <= segment[-1] + shift < self.n or shift and not segment:
                    continue
                r, x = np.arange(len(cells)), _mix(_mix(seed) + np.uint64(tag + 17 * level + 1))
                for j, i in enumerate(segment):
                    v = cells[r, i + shift]
                    missing = v == _MISSING
                    own = np.where(missing, np.int64(1 << 30), v // width)
                    add = self.factor[j]
                    with np.errstate(over="ignore"):
                        grown = x + own.astype(np.uint64) * add
                        if probing:
                            low, high = (v - self.tolerance) // width, (v + self.tolerance) // width
                            other = np.where(low != own, low, high)
                            near = ~missing & (other != own)
                            r = np.concatenate([r, r[near]])
                            x = np.concatenate([grown, x[near] + other[near].astype(np.uint64) * add])
                        else:
                            x = grown
                rows.append(r), keys.append(_mix(x)), paths.append(np.full(len(r), path * 32 + tag + 1))
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(paths)

    def signature(self, cells: np.ndarray) -> np.ndarray:
        """16 cells in 4 bits each: 15 for a missing one, else a bucket of 8 values modulo 15."""
        out = np.zeros(len(cells), np.uint64)
        for j in range(16):
            v = cells[:, self.n * j // 16]
            code = np.where(v == _MISSING, 15, (v // max(8, self.tolerance)) % 15).astype(np.uint64)
            out |= code << np.uint64(4 * j)
        return out


def _apart() -> np.ndarray:
    """Whether two codes of a signature differ for certain: one is missing, or their buckets aren't neighbours."""
    a, b = np.divmod(np.arange(256), 16)
    near = np.isin((a - b) % 15, (0, 1, 14))
    return np.where((a == 15) | (b == 15), a != b, ~near)


_APART = _apart()


def _read(batch: pa.RecordBatch, n: int) -> np.ndarray:
    cells = np.empty((batch.num_rows, n), np.int64)
    for i in range(n):
        cells[:, i] = batch.column(batch.schema.get_field_index(f"c{i}")).cast(pa.int64()).fill_null(_MISSING).to_numpy(zero_copy_only=False)
    return cells


_EMITTED = "key bigint, rec_id bigint, side int, sign bigint, path int"


def _emit(rows: DataFrame, maker: KeyMaker) -> DataFrame:
    """``_EMITTED``: the keys of the next level of all rows; ``seed`` and ``path`` say where they have got to."""

    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            cells, side, path, seed, ids = _read(batch, maker.n), get("side"), get("path"), get("seed").astype(np.int64).view(np.uint64), get("rec_id")
            sign = np.zeros(len(cells), np.uint64) if maker.shift else maker.signature(cells)
            for group in np.unique(path * 2 + side):
                mine = np.flatnonzero(path * 2 + side == group)
                at, key, to = maker.keys(cells[mine], seed[mine], bool(group % 2), int(group // 2))
                at = mine[at]
                columns = (key.view(np.int64), ids[at], np.full(len(at), group % 2, np.int32), sign[at].view(np.int64), to.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "rec_id", "side", "sign", "path"])

    return rows.mapInArrow(run, _EMITTED)


_MATCHED = "side int, a bigint, b bigint, path int"


def _matched(frames, hot: int, most: int, signed: bool):
    """Rows sorted by (key, side descending) in. Out: pairs as (-1, training id, evaluation id, 0), rows of hot keys as (side, id, key, path)."""
    names = ["side", "a", "b", "path"]
    held: pd.DataFrame | None = None
    crowded = None  # the hot key that is being passed through

    def hot_rows(p):
        return pd.DataFrame({"side": p["side"], "a": p["rec_id"], "b": p["key"], "path": p["path"]})[names]

    def whole(p):
        key, side, ids, sign = (p[c].to_numpy() for c in ("key", "side", "rec_id", "sign"))
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[begin, len(key)])
        evals = np.add.reduceat(side == 1, begin)
        many = (size > hot) & (evals > 0) & (evals < size)
        if many.any():
            yield hot_rows(p[np.repeat(many, size)])
        both = (evals > 0) & (evals < size) & ~many
        group = np.repeat(np.arange(len(begin)), size)
        e = np.flatnonzero((side == 1) & both[group])
        n = (size - evals)[group[e]]
        first = (begin + evals)[group[e]]
        f, load = 0, np.cumsum(n)
        while f < len(e):
            g = max(f + 1, int(np.searchsorted(load, (load[f - 1] if f else 0) + PAIRS, "right")))
            count = n[f:g]
            left = np.repeat(e[f:g], count)
            right = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[f:g], count)
            if signed:
                x, y = sign[left].view(np.uint64), sign[right].view(np.uint64)
                apart = np.zeros(len(left), np.int32)
                for j in range(16):
                    apart += _APART[(((x >> np.uint64(4 * j)) & np.uint64(15)) * np.uint64(16) + ((y >> np.uint64(4 * j)) & np.uint64(15))).astype(np.int64)]
                left, right = left[apart <= most], right[apart <= most]
            if len(left):
                yield pd.DataFrame({"side": np.int32(-1), "a": ids[right], "b": ids[left], "path": np.int32(0)}, index=range(len(left)))[names].drop_duplicates()
            f = g

    for pdf in frames:
        if pdf.empty:
            continue
        if crowded is not None:
            same = (pdf["key"] == crowded).to_numpy()
            if same.any():
                yield hot_rows(pdf[same])
                pdf = pdf[~same]
                if pdf.empty:
                    continue
            crowded = None
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = (pdf["key"] == pdf["key"].iloc[-1]).to_numpy()  # may go on in the next batch
        held = pdf[last]
        if not last.all():
            yield from whole(pdf[~last])
        if len(held) > hot:
            if (held["side"] == 1).any():
                yield hot_rows(held)
                crowded, held = int(held["key"].iloc[0]), None
            else:  # no evaluation record comes after training ones: this key matches nothing
                held = held.iloc[:1]
    if held is not None and len(held):
        yield from whole(held)


def banded_distance(a: np.ndarray, b: np.ndarray, band: int = 0, tolerance: int = TOLERANCE) -> np.ndarray:
    """Edit distance of the rows of ``a`` and ``b`` (n x m cells, missing ones ``MISSING``) within a band of the given half-width.

    The dynamic program runs over the band's cells for all pairs at once: unit costs for replacing, inserting and deleting, none for
    characters within the tolerance. With ``band=0`` it counts the differing columns.
    """
    n, m = a.shape
    far = m + 1
    row = np.full((n, 2 * band + 1), far, np.int32)  # row[:, d + band]: i characters of a against i + d of b
    for d in range(band + 1):
        row[:, band + d] = d
    for i in range(1, m + 1):
        new = np.full_like(row, far)
        for d in range(-band, band + 1):
            j = i + d
            if j < 0 or j > m:
                continue
            best = np.full(n, far, np.int32)
            if j == 0:
                best = np.full(n, i, np.int32)
            else:
                x, y = a[:, i - 1], b[:, j - 1]
                same = ((x == _MISSING) & (y == _MISSING)) | ((x != _MISSING) & (y != _MISSING) & (np.abs(x - y) <= tolerance))
                best = row[:, d + band] + ~same
                if d > -band:
                    best = np.minimum(best, new[:, d - 1 + band] + 1)
            if d < band:
                best = np.minimum(best, row[:, d + 1 + band] + 1)
            new[:, d + band] = best
        row = new
    return row[:, band]


def members(rows: DataFrame, n: int, copies: int = COPIES) -> DataFrame | None:
    """``side, h, g, rep``: the groups of at least ``copies`` equal records of a side; None if there are none."""
    hashed = rows.select("rec_id", "side", F.xxhash64("o", *[f"c{i}" for i in range(n)]).alias("h"), F.hash("o", *[f"c{i}" for i in range(n)]).alias("g"))
    groups = materialise(hashed.groupBy("side", "h", "g").agg(F.count("*").alias("_n"), F.min("rec_id").alias("rep")).where(F.col("_n") >= copies).drop("_n"))
    return groups if groups.limit(1).count() else None


def _array(n: int):
    return F.array(*[F.coalesce(F.col(f"c{i}").cast("bigint"), F.lit(_MISSING)) for i in range(n)])


_PAIRS = "train_id bigint, eval_id bigint, differing int, same boolean"


def _blocks(rows: DataFrame, n: int, k: int, shift: int, block: int) -> DataFrame:
    """``_PAIRS`` of rows ``(rec_id, side, key, cells)`` whose key stayed hot: each pair of blocks of a key is compared within one task."""
    counts = rows.groupBy("key", "side").agg(F.ceil(F.count("*") / block).alias("n"))
    sizes = counts.groupBy("key").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("t"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("e")).where("t is not null and e is not null")
    own = lambda c: F.pmod(F.xxhash64("rec_id"), F.col(c))
    every = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
    joined = rows.join(sizes, "key")
    spread = joined.where("side = 0").select("key", own("t").alias("i"), F.explode(every("e")).alias("j"), "side", "rec_id", "cells").unionByName(
        joined.where("side = 1").select("key", F.explode(every("t")).alias("i"), own("e").alias("j"), "side", "rec_id", "cells")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, side, ids = np.stack(pdf["cells"].to_numpy()), pdf["side"].to_numpy(), pdf["rec_id"].to_numpy()
        t, e = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        for s in range(0, len(e), 64):
            left, right = np.repeat(e[s : s + 64], len(t)), np.tile(t, len(e[s : s + 64]))
            d = banded_distance(x[right], x[left], shift)
            near = d <= k
            left, right = left[near], right[near]
            out.append(pd.DataFrame({"train_id": ids[right], "eval_id": ids[left], "differing": d[near], "same": (x[right] == x[left]).all(1)}))
        return pd.concat(out) if out else pd.DataFrame({"train_id": [], "eval_id": [], "differing": [], "same": []})

    return spread.groupBy("key", "i", "j").applyInPandas(compare, _PAIRS)


def overlapping(records: DataFrame, features: list[str] | None = None, k: int = MAX_DIFFERENT, hot: int = HOT, copies: int = COPIES, shift: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """``(pairs, represented)``.

    pairs: ``train_id, eval_id, differing, same`` between representatives: their edit distance, at most k, and whether all cells are equal. represented: ``side, rep,
    rec_id`` of all records in large groups of copies (the representative included), None if there are none.
    """
    features = features or feature_names()
    n = len(features)
    rows = prepared(records, features)
    groups = members(rows, n, copies)
    represented = None
    if groups is not None:
        tagged = rows.withColumn("h", F.xxhash64("o", *[f"c{i}" for i in range(n)])).withColumn("g", F.hash("o", *[f"c{i}" for i in range(n)]))
        tagged = tagged.join(broadcast_if_small(groups), ["side", "h", "g"], "left").drop("h", "g")
        represented = materialise(tagged.where("rep is not null").select("side", "rep", "rec_id").distinct())
        rows = tagged.where("rep is null or rep = rec_id").drop("rep")
    maker = KeyMaker(n, k, shift=shift)
    asked = rows.withColumns({"seed": F.col("o").cast("bigint"), "path": F.lit(0)})
    candidates, still = [], None
    for _ in maker.widths:
        sorted_ = _emit(asked, maker).repartition("key").sortWithinPartitions("key", F.desc("side"))
        found = materialise(sorted_.mapInPandas(lambda it: _matched(it, hot, k, not shift), _MATCHED))
        candidates.append(found.where("side < 0").select(F.col("a").alias("train_id"), F.col("b").alias("eval_id")))
        still = found.where("side >= 0").select(F.col("a").alias("rec_id"), "side", F.col("b").alias("seed"), "path").distinct()
        if not still.limit(1).count():
            still = None
            break
        asked = materialise(rows.join(broadcast_if_small(still), ["rec_id", "side"]))
    pairs = candidates[0]
    for c in candidates[1:]:
        pairs = pairs.unionByName(c)
    pairs = materialise(pairs.distinct())
    ids = pairs.select(F.explode(F.array("train_id", "eval_id")).alias("rec_id")).distinct()
    vectors = materialise(one_per_key(rows.select("rec_id", _array(n).alias("c")).join(broadcast_if_small(materialise(ids)), "rec_id", "left_semi"), "rec_id"))
    left = vectors.select(F.col("rec_id").alias("train_id"), F.col("c").alias("a"))
    right = vectors.select(F.col("rec_id").alias("eval_id"), F.col("c").alias("b"))

    def verify(frames):
        for pdf in frames:
            if pdf.empty:
                continue
            a, b = np.stack(pdf["a"].to_numpy()), np.stack(pdf["b"].to_numpy())
            d = banded_distance(a, b, shift)
            yield pd.DataFrame({"train_id": pdf["train_id"], "eval_id": pdf["eval_id"], "differing": d.astype(np.int32), "same": (a == b).all(1)})[d <= k]

    verified = pairs.join(left, "train_id").join(right, "eval_id").mapInPandas(verify, _PAIRS)
    if still is not None:
        last = asked.select("rec_id", "side", F.col("seed").alias("key"), _array(n).alias("cells"))
        verified = verified.unionByName(_blocks(last, n, k, shift, hot)).distinct()
    return materialise(verified), represented


def written_out(pairs: DataFrame, represented: DataFrame | None) -> DataFrame:
    """``rec_id_a, rec_id_b, edits`` (a < b): one row for every pair of records that ``pairs`` stand for, groups of copies written out."""
    if represented is not None:
        t = represented.where("side = 0").select(F.col("rep").alias("train_id"), F.col("rec_id").alias("_t"))
        e = represented.where("side = 1").select(F.col("rep").alias("eval_id"), F.col("rec_id").alias("_e"))
        pairs = pairs.join(t, "train_id", "left").join(e, "eval_id", "left").select(F.coalesce("_t", "train_id").alias("train_id"), F.coalesce("_e", "eval_id").alias("eval_id"), "differing")
    ordered = pairs.select(F.least("train_id", "eval_id").alias("rec_id_a"), F.greatest("train_id", "eval_id").alias("rec_id_b"), "differing").where("rec_id_a < rec_id_b")
    return ordered.groupBy("rec_id_a", "rec_id_b").agg(F.min("differing").alias("edits"))


def record_pairs(records: DataFrame) -> DataFrame:
    """``rec_id_a, rec_id_b`` (a < b): all overlapping pairs of a training and an evaluation record, groups of copies written out."""
    return written_out(*overlapping(records)).select("rec_id_a", "rec_id_b")


def shifted_pairs(records: DataFrame) -> DataFrame:
    """``rec_id_a, rec_id_b, edits`` (a < b): pairs that overlap only if cells may have moved by one column, groups of copies written out."""
    pairs, represented = overlapping(records, shift=1)
    same = overlapping(records)[0]  # the same records stand for groups of copies
    return written_out(pairs.join(same, ["train_id", "eval_id"], "left_anti"), represented)


def overlap_report(records: DataFrame) -> DataFrame:
    """``data_split, sensor_id, records, same, near``: evaluation records that take part, those met exactly and those met only almost in
    training, per split and source. Copies are counted without being written out as pairs."""
    pairs, represented = overlapping(records)
    met = pairs.groupBy("eval_id").agg(F.max("same").alias("same"))
    if represented is not None:
        e = represented.where("side = 1").select(F.col("rep").alias("eval_id"), F.col("rec_id").alias("_e"))
        met = met.join(e, "eval_id", "left").select(F.coalesce("_e", "eval_id").alias("eval_id"), "same")
    met = met.select(F.col("eval_id").alias("rec_id"), "same")
    split = F.lower(F.trim(F.col("data_split")))
    rows = records.where(split.isin("validation", "test") & (outcome_code("outcome") < 99) & F.col("rec_id").isNotNull()).select("rec_id", split.alias("data_split"), "sensor_id").dropDuplicates(["rec_id"])
    return rows.join(met, "rec_id", "left").groupBy("data_split", "sensor_id").agg(F.count("*").alias("records"), F.count_if(F.col("same")).alias("same"), F.count_if(~F.col("same")).alias("near"))
