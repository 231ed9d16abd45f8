"""A sample whose category shares follow given targets, drawn by the cube method.

Every record has an inclusion probability: size of its (batch, outcome) cell over available number. The
balancing equations are the indicators of the cells, so a flight step moves two undecided records of one cell along (1, -1) until
one of them is decided; every equation stays satisfied. Records of a cell are divided by a hash of their id into blocks of about
``BLOCK_ROWS``, whatever the partitioning of the input; flights run per block, in order of another hash, each leaving at most one undecided record;
these merge upward into one flight per cell. Landing drops the cell equations and keeps the batch totals: undecided records of
one batch are paired across cells, and a last one is drawn at its probability. The same records and seed give the same sample, however they are stored.

*Two phases.* A cell wants the larger of ``min_rows`` and ``target_pct * n_wanted / 100``; its size in the sample is set per batch (``cell_sizes``), so that
all cells together have ``n_wanted`` records: minima first, the rest by ``target_pct`` among cells with records left. The share that a batch's
targets leave open (100 less their sum) is drawn from its outcomes without target. Only minima that exceed ``n_wanted`` by themselves make a
sample larger, only a lack of records makes it smaller. The first phase draws a reserve for every cell: as many records as it wants by itself or has in the
sample, whichever is more, rounded up. A cell whose reserve stays below what it wants is short: the batch cannot provide it. The second
phase draws the sample from the reserve. The report states wanted, available, reserved and drawn numbers and the residual
imbalance; ``balance`` sets drawn shares against ``target_pct`` and drawn totals against ``n_wanted``.

Defined results: repeated target rows
count once (of unequal ones the largest wish); null batches, categories or numbers are no targets; records delivered twice count
once (of unequal deliveries the one of least batch and outcome); records without one of the six outcomes are never drawn; a cell without records is reported short with 0 available.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, one_per_key, outcome_name

EPS = 1e-7
BLOCK_ROWS = 100_000
SCHEMA = "batch_id int, outcome string, rec_id bigint, p double"


def wishes(targets: DataFrame) -> DataFrame:
    """``batch_id, outcome, wanted double``: one row per listed cell."""
    want = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("double"), F.col("target_pct") * F.col("n_wanted") / 100.0)
    named = targets.select("batch_id", outcome_name("outcome").alias("outcome"), want.alias("wanted"))
    return named.where("batch_id is not null and outcome is not null and wanted is not null").groupBy("batch_id", "outcome").agg(F.max("wanted").alias("wanted"))


def goals(targets: DataFrame) -> DataFrame:
    """``batch_id, outcome, pct double, low double, n double``: share, minimum and size of the batch's sample, one row per listed cell."""
    cells = targets.join(wishes(targets).select("batch_id").distinct(), "batch_id", "left_semi").withColumn("outcome", outcome_name("outcome")).where("outcome is not null")
    size = cells.groupBy("batch_id").agg(F.max("n_wanted").cast("double").alias("n"))
    zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("double")
    return cells.groupBy("batch_id", "outcome").agg(zero("target_pct").alias("pct"), zero("min_rows").alias("low")).join(size, "batch_id").fillna(0.0, ["n"])


def fill(weight: np.ndarray, low: np.ndarray, high: np.ndarray, goal: float) -> np.ndarray:
    """``clip(x * weight, low, high)`` with the one x that gives the sum ``goal``, or the nearest sum that there is."""
    low = np.minimum(low, high)
    if low.sum() >= goal or not (weight > 0).any():
        return low
    on = weight > 0
    turns = np.unique(np.concatenate([low[on] / weight[on], high[on] / weight[on]]))
    at = lambda x: np.where(on, np.clip(x * weight, low, high), low)
    sums = np.array([at(x).sum() for x in turns])
    if sums[-1] <= goal:
        return np.where(on, high, low)
    k = int(np.searchsorted(sums, goal, side="right"))  # at least 1, as the first sum is that of low; sums grow linearly between turns
    return at(turns[k - 1] + (turns[k] - turns[k - 1]) * (goal - sums[k - 1]) / (sums[k] - sums[k - 1]))


def cell_sizes(pct: np.ndarray, low: np.ndarray, available: np.ndarray, n: float, listed: np.ndarray) -> np.ndarray:
    """Numbers to draw from one batch's cells; ``pct`` and ``low`` count for listed cells only."""
    out, share = np.zeros(len(pct)), min(1.0, pct[listed].sum() / 100)
    own = np.minimum(np.maximum(low[listed], pct[listed] * n / 100), available[listed]).sum()
    out[listed] = fill(pct[listed], low[listed], available[listed], min(n, max(own, n * share)))
    left = max(0.0, min(n - out.sum(), n * (1 - share)))
    out[~listed] = fill(available[~listed], np.zeros((~listed).sum()), available[~listed], left)
    out[out < EPS] = 0.0  # what is left by rounding of the sum isn't a part of a record
    return out


def _sized(frames):
    """Cells of whole batches with ``size``."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    pdf = pd.concat(frames, ignore_index=True)
    size = np.zeros(len(pdf))
    pct, low, n, available, listed = (pdf[c].to_numpy(kind) for c, kind in (("pct", float), ("low", float), ("n", float), ("available", float), ("listed", bool)))
    for at in pdf.groupby("batch_id", sort=False).indices.values():
        size[at] = cell_sizes(pct[at], low[at], available[at], float(n[at].max()), listed[at])
    yield pdf[["batch_id", "outcome", "available"]].assign(size=size)


def distinct_labels(records: DataFrame) -> DataFrame:
    """``rec_id, batch_id, outcome`` of distinct records with one of the six outcomes."""
    rows = records.select("rec_id", F.col("batch_id").cast("int").alias("batch_id"), outcome_name("outcome").alias("outcome"))
    return one_per_key(rows.where("outcome is not null and batch_id is not null"), "rec_id")


def flight(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Flight phase over the undecided units of one cell: p afterwards, all 0 or 1 but at most one; the sum is unchanged.

    Each step takes the carried unit i and the next unit j and moves along the null vector (1, -1) of their indicator by the
    largest step up or down, with the probabilities that make it a martingale; ``u`` are uniform numbers, one per step.
    """
    p = np.clip(p, 0.0, 1.0).tolist()
    out, i = list(p), -1
    for j, b in enumerate(p):
        if b <= EPS or b >= 1 - EPS:
            out[j] = float(round(b))
            continue
        if i < 0:
            i = j
            continue
        a = out[i]
        up, down = min(1 - a, b), min(a, 1 - b)  # a + up, b - up; or a - down, b + down
        if u[j] * (up + down) < down:
            a, b = a + up, b - up
        else:
            a, b = a - down, b + down
        out[i], out[j] = a, b
        if a <= EPS or a >= 1 - EPS:
            out[i] = float(round(a))
            i = j if EPS < b < 1 - EPS else -1
            if i < 0:
                out[j] = float(round(b))
        else:
            out[j] = float(round(b))
    return np.array(out)


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + 1) & (2**64 - 1))
        for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def _fly(frames, seed: int):
    """Flights over rows sorted by (batch, outcome, block, hash); only undecided rows are carried along, at most one per block at its end."""
    left, by = None, ["batch_id", "outcome", "block"]
    for pdf in frames:
        pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        if pdf.empty:
            continue
        p = pdf["p"].to_numpy(float).copy()
        u = _uniform(pdf["rec_id"].to_numpy(), seed)
        for at in pdf.groupby(by, sort=False).indices.values():
            p[at] = flight(p[at], u[at])
        pdf["p"] = p
        yield pdf[p >= 1][["batch_id", "outcome", "rec_id", "p"]]
        # blocks other than the last one read are finished
        open_ = pdf[(p > 0) & (p < 1)]
        last = (open_[by] == pdf[by].iloc[-1]).all(axis=1)
        yield open_[~last][["batch_id", "outcome", "rec_id", "p"]]
        left = open_[last]
    if left is not None:
        yield left[["batch_id", "outcome", "rec_id", "p"]]


def _land(frames, seed: int):
    """One task's last undecided records, at most one per cell: flights over whole batches, then a draw of what is left."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    pdf = pd.concat(frames, ignore_index=True)
    ids, p = pdf["rec_id"].to_numpy(), pdf["p"].to_numpy(float).copy()
    u = _uniform(ids, seed)
    for at in pdf.groupby("batch_id", sort=True).indices.values():
        p[at] = flight(p[at], u[at])
    yield pdf[p > _uniform(ids, seed + 1)]


def cube(rows: DataFrame, seed: int) -> DataFrame:
    """``batch_id, outcome, rec_id`` of a balanced sample of ``rows (batch_id, outcome, rec_id, p, blocks)``; ``p`` and ``blocks`` are equal within a cell."""
    sure = rows.where("p >= 1").select("batch_id", "outcome", "rec_id")
    order = F.xxhash64("rec_id", F.lit(seed))

    def flown(df: DataFrame, number: int) -> DataFrame:
        spread = df.repartition("batch_id", "outcome", "block").sortWithinPartitions("batch_id", "outcome", "block", order, "rec_id")
        return materialise(spread.select("batch_id", "outcome", "block", "rec_id", "p").mapInPandas(lambda it: _fly(it, seed + number), SCHEMA))

    first = flown(rows.where("p < 1").withColumn("block", F.pmod(F.xxhash64("rec_id", F.lit(seed + 31)), F.col("blocks"))), 0)
    second = flown(first.where("p < 1").withColumn("block", F.lit(0)), 1)
    landed = second.where("p < 1").repartition("batch_id").sortWithinPartitions("batch_id", "outcome", "rec_id").mapInPandas(lambda it: _land(it, seed + 104729), SCHEMA)
    out = sure
    for df in (first.where("p >= 1"), second.where("p >= 1"), landed):
        out = out.unionByName(df.select("batch_id", "outcome", "rec_id"))
    return materialise(out)


def draw(records: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)``: sample ``batch_id, outcome, rec_id``; report ``batch_id, outcome, wanted, available, reserved, size, drawn, residual, short``.

    ``size`` is the cell's part of the batch's sample before rounding. ``residual`` is drawn less what could be drawn of what the cell wants by itself: below 0
    where records went back to keep to the batch's ``n_wanted``, above where the cell stands in for others. The report has listed cells only.
    """
    cells = materialise(distinct_labels(records))
    available = materialise(cells.groupBy("batch_id", "outcome").agg(F.count("*").alias("available")))
    wish = wishes(targets)
    goal = materialise(goals(targets))
    size = goal.groupBy("batch_id").agg(F.max("n").alias("n"))
    known = available.join(goal.drop("n").withColumn("listed", F.lit(True)), ["batch_id", "outcome"], "full").join(size, "batch_id")
    known = known.fillna(0, ["available", "pct", "low"]).fillna(False, ["listed"])
    sized = known.repartition("batch_id").mapInPandas(_sized, "batch_id int, outcome string, available bigint, size double").join(wish, ["batch_id", "outcome"], "left")
    most = F.ceil(F.greatest(F.col("size"), F.coalesce("wanted", F.lit(0.0))) - 1e-9)
    sized = materialise(sized.withColumn("most", F.least(F.col("available"), most)))
    blocks = F.ceil(F.col("available") / BLOCK_ROWS)
    rows = cells.join(broadcast_if_small(sized.where("most > 0").select("batch_id", "outcome", (F.col("most") / F.col("available")).alias("p"), blocks.alias("blocks"))), ["batch_id", "outcome"])
    reserve = cube(rows, seed)
    reserved = reserve.groupBy("batch_id", "outcome").agg(F.count("*").alias("reserved"))
    thinned = sized.where("size > 0").select("batch_id", "outcome", F.least(F.lit(1.0), F.col("size") / F.col("most")).alias("p"), blocks.alias("blocks"))
    sample = cube(reserve.join(broadcast_if_small(thinned), ["batch_id", "outcome"]), seed + 977)
    drawn = sample.groupBy("batch_id", "outcome").agg(F.count("*").alias("drawn"))
    got, kept = F.coalesce("drawn", F.lit(0)), F.coalesce("reserved", F.lit(0))
    report = sized.where("wanted is not null").join(reserved, ["batch_id", "outcome"], "left").join(drawn, ["batch_id", "outcome"], "left").select(
        "batch_id", "outcome", "wanted", "available", kept.alias("reserved"), F.round("size", 6).alias("size"), got.alias("drawn"),
        F.round(got - F.least("wanted", F.col("available").cast("double")), 9).alias("residual"),
        (kept < F.col("wanted")).alias("short"),
    )
    return sample, report


def totals(records: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """``batch_id, n_wanted, expected, met``: size of each batch's sample before rounding, and whether the sample drawn, in every cell and in all, is less than one record off."""
    sample, report = draw(records, targets, seed)
    off = report.groupBy("batch_id").agg(F.max(F.abs(F.col("drawn") - F.col("size"))).alias("off"))
    size = goals(targets).groupBy("batch_id").agg(F.max("n").cast("bigint").alias("n_wanted"))
    cells = report.groupBy("batch_id").agg(F.sum("size").alias("listed"))
    all_ = sample.groupBy("batch_id").agg(F.count("*").alias("drawn"))
    listed = report.select("batch_id", "outcome")
    others = distinct_labels(records).groupBy("batch_id", "outcome").agg(F.count("*").alias("n")).join(listed, ["batch_id", "outcome"], "left_anti").groupBy("batch_id").agg(F.sum("n").alias("n"))
    share = goals(targets).groupBy("batch_id").agg(F.least(F.lit(1.0), F.sum("pct") / 100).alias("share"))
    joined = size.join(cells, "batch_id").join(share, "batch_id").join(off, "batch_id").join(others, "batch_id", "left").join(all_, "batch_id", "left").fillna(0, ["n", "drawn"])
    left = F.greatest(F.lit(0.0), F.least(F.col("n_wanted") - F.col("listed"), F.col("n_wanted") * (1 - F.col("share"))))
    expected = F.col("listed") + F.least(left, F.col("n"))
    return joined.select("batch_id", "n_wanted", F.round(expected, 4).alias("expected"), ((F.col("off") < 1) & (F.abs(F.col("drawn") - expected) < 1)).alias("met"))


def balance(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """``batch_id, outcome, target_pct, drawn, drawn_pct, n_wanted, batch_drawn``: shares and totals of a sample against its targets.

    Outcomes drawn without a target have a null ``target_pct``; a batch without any record drawn has a null ``drawn_pct``.
    """
    goal = goals(targets)
    drawn = sample.groupBy("batch_id", "outcome").agg(F.count("*").alias("drawn"))
    cells = goal.select("batch_id", "outcome", F.col("pct").alias("target_pct")).join(drawn, ["batch_id", "outcome"], "full")
    totals = goal.groupBy("batch_id").agg(F.max("n").cast("bigint").alias("n_wanted")).join(sample.groupBy("batch_id").agg(F.count("*").alias("all")), "batch_id", "left")
    got, every = F.coalesce("drawn", F.lit(0)), F.coalesce("all", F.lit(0))
    return cells.join(totals, "batch_id").select(
        "batch_id", "outcome", "target_pct", got.alias("drawn"), F.round(100 * got / F.when(every > 0, every), 6).alias("drawn_pct"), "n_wanted", every.alias("batch_drawn")
    )
