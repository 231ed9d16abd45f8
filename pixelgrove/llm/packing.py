"""Filling containers of fixed capacity with items of varying length.

Pattern packing. The histogram of item lengths (at most ``capacity`` entries, whatever the number of items) goes to the driver.
There, patterns of a few documents are enumerated: a body of up to two distinct length bins, and one closing document that fills what the body
leaves. Repeat counts of all patterns are fitted to the histogram, closing documents included, by non-negative least squares, and rounded down.
Bodies are laid out first. Then each gap, whose exact size is known by now, is closed by the longest document that fits. Since the fit has set
aside as many closing documents of each bin as there are gaps, one of nearly the exact length is there for most. Containers still emptier than
``TOLERANCE`` are taken apart again, and what is left is fitted anew; after ``ROUNDS`` the residue is packed best-fit. All of it works on counts: items
and containers of equal contents are interchangeable. The result is a plan of intervals

    items number ``first`` .. ``last`` of length L go to containers ``container``, ``container + 1``, ..., ``each`` to a container

which a narrow pass applies to every item by its number within its length. Numbers come from a window over (length, block of
keys) plus the counts of earlier blocks, so that a length shared by a third of all items is spread over all tasks.

Only an item longer than the capacity is cut: into full containers and one remainder. Null and empty items take no space and get
no row. Equal lengths are told apart by key and piece number; repeated keys are separate items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise

CAPACITY = 8192
BINS = 64
ROUNDS = 4
#: Part of the capacity that may stay unused in a container filled by a pattern.
TOLERANCE = 1 / 512


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by the active-set method: min ||a x - b||, x >= 0."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= 1e-9 * scale or passive.sum() >= m:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = float(np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)))
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12 * scale) & low]
            passive[gone if len(gone) else at[low]] = False
            x[~passive] = 0
    return x


def patterns(want: np.ndarray, mean: np.ndarray, width: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bodies of up to two distinct bins, and what each pattern uses of every bin, its closing document included: two matrices with a row per bin.

    ``want`` and ``mean`` are number and mean length of each bin's documents. Bodies never exceed the capacity, even with the longest
    documents of their bins; the closing document's expected length is divided between the two nearest bins.
    """
    present = [int(k) for k in np.flatnonzero(want)]
    pairs = [(k, m) for k in present for m in range(1, capacity // (k * width) + 1)]
    bodies: list[dict[int, int]] = [{}, *({k: m} for k, m in pairs)]
    bodies += [{i: m, j: n} for a, (i, m) in enumerate(pairs) for j, n in pairs[a + 1 :] if j != i and (i * m + j * n) * width <= capacity]
    body = np.zeros((len(want), len(bodies)), np.float32)
    for c, p in enumerate(bodies):
        for k, m in p.items():
            body[k, c] = m
    gap = capacity - mean @ body
    centres = mean[present]
    whole = (gap >= centres[0]) & (gap <= centres[-1])  # such a document exists
    body, gap = body[:, whole], gap[whole]
    at = np.clip(np.searchsorted(centres, gap), 1, max(1, len(present) - 1))
    low, high = np.array(present)[at - 1], np.array(present)[np.minimum(at, len(present) - 1)]
    part = np.clip((gap - mean[low]) / np.maximum(mean[high] - mean[low], 1e-9), 0, 1)
    used, columns = body.copy(), np.arange(len(gap))
    np.add.at(used, (low, columns), 1 - part)
    np.add.at(used, (high, columns), part)
    return body, used


#: Containers of equal contents: how many, unused space of each, contents as (length, how many).
Group = tuple[int, int, tuple[tuple[int, int], ...]]


def _bodies(left: dict[int, int], capacity: int, bins: int) -> list[Group]:
    """Bodies by the fitted repeat counts; their documents are taken out of ``left``."""
    width = -(-capacity // min(bins, capacity))
    bins = capacity // width  # whole bins never exceed the capacity; a length beyond them is left to the residue
    pools: dict[int, deque[int]] = defaultdict(deque)
    want, total = np.zeros(bins + 1), np.zeros(bins + 1)
    for length in sorted(left):
        if (k := -(-length // width)) <= bins:
            pools[k].append(length)
            want[k] += left[length]
            total[k] += length * left[length]
    if not want.any():
        return []
    body, used = patterns(want, total / np.maximum(want, 1), width, capacity)
    if not body.shape[1]:
        return []
    repeats = np.floor(nnls(used, want) + 1e-9).astype(np.int64)
    out: list[Group] = []
    for c in np.argsort(-repeats, kind="stable"):
        slots = [int(k) for k in np.flatnonzero(body[:, c]) for _ in range(int(body[k, c]))]
        short = [sum(left.get(x, 0) for x in pools[k]) // slots.count(k) for k in set(slots)]
        n = min([int(repeats[c]), *short])
        if n <= 0 or not slots:
            continue
        groups: list[Group] = [(n, capacity, ())]
        for number, k in enumerate(slots):
            laid = []
            for count, slack, contents in groups:
                while count:  # longest and shortest first in turn, which keeps sums near the mean
                    length = pools[k][-1 if number % 2 else 0]
                    if length not in left:
                        pools[k].pop() if number % 2 else pools[k].popleft()
                        continue
                    m = min(count, left[length])
                    _take(left, length, m)
                    laid.append((m, slack - length, (*contents, (length, 1))))
                    count -= m
            groups = laid
        out += groups
    return out


def _take(left: dict[int, int], length: int, n: int) -> None:
    left[length] -= n
    if not left[length]:
        del left[length]


def _best_fit(left: dict[int, int], groups: list[Group], capacity: int, new: bool) -> list[Group]:
    """Documents of ``left``, longest first, into the smallest gap that holds them; without one into new containers, if ``new``."""
    done, gaps = [], defaultdict(list)  # gap -> (how many, contents)
    for n, slack, contents in groups:
        gaps[slack].append((n, contents)) if slack else done.append((n, slack, contents))
    open_, rest = sorted(gaps), sorted(left)
    while rest:
        length = rest.pop()
        while length in left:
            k = bisect_left(open_, length)
            if k < len(open_):
                slack = open_[k]
                room, contents = gaps[slack].pop()
            elif new:
                slack, room, contents = capacity, left[length], ()
            else:
                break
            each = min(slack // length, left[length])
            n = min(room, left[length] // each)
            if n < room and k < len(open_):
                gaps[slack].append((room - n, contents))
            if k < len(open_) and not gaps[slack]:
                del gaps[slack]
                open_.pop(k)
            _take(left, length, n * each)
            slack, contents = slack - length * each, (*contents, (length, each))
            if not slack:
                done.append((n, 0, contents))
                continue
            if slack not in gaps:
                insort(open_, slack)
            gaps[slack].append((n, contents))
    return done + [(n, slack, contents) for slack, some in gaps.items() for n, contents in some]


def filled(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, rounds: int = ROUNDS) -> tuple[list[Group], list[Group]]:
    """Containers filled by patterns, and those of the residue."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be between 1 and the capacity")
    full: list[Group] = []
    for _ in range(rounds if left else 0):
        before = sum(left.values())
        for n, slack, contents in _best_fit(left, _bodies(left, capacity, bins), capacity, False):
            if slack <= capacity * TOLERANCE:
                full.append((n, slack, contents))
                continue
            for length, each in contents:
                left[length] = left.get(length, 0) + n * each
        if sum(left.values()) in (0, before):
            break
    return full, _best_fit(left, [], capacity, True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals ``(length, first, last (exclusive), container, each)`` for a histogram of lengths 1..capacity, and the number of containers.

    ``rounds=0`` leaves the patterns out: best fit alone, for comparison.
    """
    out, done, used = [], defaultdict(int), 0
    for n, _, contents in (group for part in filled(histogram, capacity, bins, rounds) for group in part):
        for length, each in contents:
            out.append((length, done[length], done[length] + n * each, used, each))
            done[length] += n * each
        used += n
    return out, used


def pieces(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key, piece_no, n_tokens``: one row per item, several only for an item longer than the capacity; none for sizes null or 0."""
    n = F.col(size)
    return (
        sizes.where(n > 0)
        .select(F.col(key), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / capacity))).alias("_k"))
        .select(F.col(key), F.col("_k").cast("int").alias("piece_no"), F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("_k") * capacity).cast("int").alias("n_tokens"))
    )


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, blocks: int | None = None) -> DataFrame:
    """``key, piece_no, n_tokens, container_id``: every item of positive size in a container, no container above ``capacity``.

    ``sizes`` must be cheap to read more than once (a materialised table). An empty table gives no rows.
    """
    spark = sizes.sparkSession
    items = pieces(sizes, key, size, capacity)
    histogram = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    intervals, _ = plan(histogram, capacity)
    kind = sizes.schema[key].dataType
    if not intervals:
        return spark.createDataFrame([], T.StructType([T.StructField(key, kind), T.StructField("piece_no", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("container_id", T.LongType())]))
    intervals.sort()
    lengths, firsts, _lasts, containers, each = (np.array(c, np.int64) for c in zip(*intervals, strict=True))
    shared = spark.sparkContext.broadcast((lengths, firsts, containers, each))  # bounded by the capacity
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = items.withColumn("_block", F.pmod(F.xxhash64(key, "piece_no"), F.lit(blocks)).cast("int"))
    per_block = items.groupBy("n_tokens", "_block").count()
    before = per_block.select("n_tokens", "_block", (F.sum("count").over(Window.partitionBy("n_tokens").orderBy("_block")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "_block").orderBy(key, "piece_no"))
    numbered = items.withColumn("_within", within).join(before, ["n_tokens", "_block"]).select(key, "piece_no", "n_tokens", (F.col("_before") + F.col("_within") - 1).alias("_number"))

    def place(frames):
        lengths, firsts, containers, each = shared.value
        for pdf in frames:
            n, number = pdf["n_tokens"].to_numpy(np.int64), pdf["_number"].to_numpy(np.int64)
            lo, hi = np.searchsorted(lengths, n, "left"), np.searchsorted(lengths, n, "right") - 1
            while (lo < hi).any():  # the last interval of the length that begins at or before the number
                mid = (lo + hi + 1) // 2
                below = firsts[mid] <= number
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid - 1)
            yield pd.DataFrame({key: pdf[key], "piece_no": pdf["piece_no"], "n_tokens": pdf["n_tokens"], "container_id": containers[lo] + (number - firsts[lo]) // each[lo]})

    return numbered.mapInPandas(place, f"`{key}` {kind.simpleString()}, piece_no int, n_tokens int, container_id bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, unused share, and the lower bound of containers that any packing needs."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    total = F.coalesce(F.sum("t"), F.lit(0))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
        F.count("*").alias("containers"),
        total.alias("tokens"),
        F.ceil(total / capacity).cast("bigint").alias("containers_at_least"),
        F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        F.round(F.lit(1.0) - F.try_divide(total, F.count("*") * capacity), 6).alias("unused_share"),
    )


def methods_report(counts: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: containers needed at least, used in all, of these filled by patterns, and used by best fit without patterns. Planned on the histogram; nothing is placed."""
    histogram = {r[0]: r[1] for r in pieces(counts, key, size, capacity).groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    full, rest = filled(histogram, capacity)
    number = lambda groups: sum(n for n, _, _ in groups)
    row = (-(-sum(k * v for k, v in histogram.items()) // capacity), number(full) + number(rest), number(full), plan(histogram, capacity, rounds=0)[1])
    return counts.sparkSession.createDataFrame([row], "containers_at_least bigint, containers bigint, by_patterns bigint, best_fit_alone bigint")


def packed_documents(counts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Token counts written once to the shared folder, then packed."""
    return pack(materialise(counts), key, "n_tokens", capacity)
