"""Column expressions: categories, colours, predicates, distances, world coordinates, text forms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORIES, COLS, NONE, NONE_CODE, ONE_METER, ROWS


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- categories and colours ---------------------------------------------------------------------------------------------


def category_code(name: Column | str) -> Column:
    """Code of a category name in any case and spacing; 99 for everything else, null included."""
    position = F.array_position(F.array(*[F.lit(n.lower()) for n in CATEGORIES]), F.lower(F.btrim(_c(name), F.lit(" \t\r\n\f\v"))))
    return F.when(position > 0, position.cast("int") - 1).otherwise(NONE_CODE)


def category_name(code: Column | str) -> Column:
    known = _c(code).between(0, len(CATEGORIES) - 1)
    return F.when(known, F.element_at(F.array(*map(F.lit, CATEGORIES)), _c(code).cast("int") + 1)).otherwise(NONE)


# Which of red, green and blue are lit for each category.
_LIT = (("Head", "b"), ("Neck", "gb"), ("LeftShoulder", "g"), ("RightShoulder", "r"), ("Sternum", "rg"), ("Other", "rgb"))
# A lit channel's range and its exact value, and the upper bound of a dark one.
_PALETTES = {"synthetic": (85, 95, 90), "real": (250, 255, 255)}
_DARK, _GRAY = 5, 127


def colour_category(r: Column | str, g: Column | str, b: Column | str, palette: str = "synthetic", yellow_is_neck: bool = False) -> Column:
    """Category of a label colour. ``yellow_is_neck`` reproduces older label files, in which the sternum's colour meant the neck."""
    low, high, _ = _PALETTES[palette]
    channel = {"r": _c(r), "g": _c(g), "b": _c(b)}
    out = None
    for name, lit in _LIT:
        name = "Neck" if name == "Sternum" and yellow_is_neck else name
        test = F.lit(True)
        for k, v in channel.items():
            test = test & (v.between(low, high) if k in lit else v <= _DARK)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(NONE)


def category_colour(name: Column | str, palette: str = "synthetic") -> Column:
    """``struct<r, g, b>`` of a category; gray for none."""
    value = _PALETTES[palette][2]
    colour = lambda lit: F.struct(*[F.lit(value if k in lit else 0).alias(k) for k in "rgb"])
    gray = F.struct(*[F.lit(_GRAY).alias(k) for k in "rgb"])
    position = F.coalesce(F.array_position(F.array(*[F.lit(n) for n, _ in _LIT]), _c(name)), F.lit(0)).cast("int")
    return F.element_at(F.array(gray, *[colour(lit) for _, lit in _LIT]), position + 1)


# --- predicates ----------------------------------------------------------------------------------------------------------


def split_predicate(feature: Column | str, value: Column | int, op: str = "le") -> Column:
    """Whether a record takes the true branch; a missing cell takes the false one."""
    test = _c(feature) <= value if op == "le" else _c(feature) < value
    return F.coalesce(test, F.lit(False))


def is_foreground(subj: Column | str) -> Column:
    return _c(subj) != 0


def is_labelled(label: Column | str) -> Column:
    return _c(label).isNotNull() & (_c(label) != NONE)


def outside_images(image: Column | str, first: int = 49, last: int = 146) -> Column:
    """Images outside a range of unusable ones."""
    return ~_c(image).between(first, last)


def file_number(name: Column | str) -> Column:
    """The digits a file name begins with as int; null without any."""
    digits = F.regexp_extract(F.regexp_extract(_c(name), r"([^/]*)$", 1), r"^\s*(\d+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def hash_share(key: Column | str, buckets: int = 10_000, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) per key, to split or thin out records without ``rand``."""
    return F.pmod(F.xxhash64(_c(key), F.lit(seed)), F.lit(buckets)) / F.lit(float(buckets))


def key_share(key: Column | str, buckets: int = 10_000, seed: int = 0) -> Column:
    """As ``hash_share``, by plain arithmetic on integer keys: the same in every engine."""
    return F.pmod(_c(key).cast("bigint") * 7919 + 104729 + seed * 31, F.lit(buckets)) / F.lit(float(buckets))


def in_training(key: Column | str, proportion: float, buckets: int = 10_000) -> Column:
    """Arithmetic split of integer keys: the same in every engine."""
    return F.pmod(_c(key).cast("bigint") * 7919 + 104729, F.lit(buckets)) < F.lit(int(round(proportion * buckets)))


# --- geometry --------------------------------------------------------------------------------------------------------------


def depth_offset(offset: Column | int, depth: Column | str) -> Column:
    """An offset in pixels at one metre, at a pixel's depth, rounded half away from zero; null at depth 0."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.round(F.try_divide(offset.cast("double"), _c(depth).cast("double") / float(ONE_METER))).cast("int")


def distance3(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two structs with x, y, z."""
    a, b = _c(a), _c(b)
    d = [a[k] - b[k] for k in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def distance_array(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays of equal length, summed from the first element on."""
    squares = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def add_arrays(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def to_world(row: Column | str, col: Column | str, depth: Column | str, rows: int = ROWS, cols: int = COLS, hfov: float = 1.0144686707507438, vfov: float = 0.7898090284550769) -> Column:
    """``struct<x, y, z>`` of a pixel by the pinhole model; the fields of view (radians) are those of the sensor at hand."""
    z = _c(depth).cast("double")
    x = (_c(col) / float(cols) - 0.5) * z * (2 * math.tan(hfov / 2))
    y = (F.lit(0.5) - _c(row) / float(rows)) * z * (2 * math.tan(vfov / 2))
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def saturated16(c: Column | str) -> Column:
    return F.least(F.greatest(_c(c), F.lit(0)), F.lit(65_535))


# --- packing and text ------------------------------------------------------------------------------------------------------


def pack_lookup(node: Column | str, flag: Column | str, category: Column | str) -> Column:
    """Node, pass flag and category in one long: bits 8.., bit 7, bits 0-6."""
    return F.shiftleft(_c(node).cast("bigint"), 8).bitwiseOR(F.shiftleft(_c(flag).cast("bigint"), 7)).bitwiseOR(_c(category).cast("bigint").bitwiseAND(127))


def unpack_lookup(packed: Column | str) -> Column:
    p = _c(packed)
    return F.struct(F.shiftright(p, 8).alias("node"), F.shiftright(p, 7).bitwiseAND(F.lit(1).cast("bigint")).cast("int").alias("flag"), p.bitwiseAND(F.lit(127).cast("bigint")).cast("int").alias("category"))


def padded(c: Column | str, width: int) -> Column:
    """Zero-padded to ``width``, never cut."""
    text = _c(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def record_text(columns: Sequence[str], label: Column | str, rec_id: Column | str | None = None, missing: int = 65_535) -> Column:
    """One line of a dataset file: id (12 digits, if any), features (4 digits), label."""
    cells = [padded(F.coalesce(F.col(c).cast("int"), F.lit(missing)), 4) for c in columns]
    head = [] if rec_id is None else [padded(rec_id, 12)]
    return F.concat_ws(" ", *head, *cells, _c(label).cast("string"))


def strains_text(columns: Sequence[str]) -> Column:
    area = lambda cs: F.concat(F.lit("P("), F.concat_ws(",", *[F.col(c).cast("string") for c in cs]), F.lit(")"))
    return F.concat(F.lit("S("), area(columns[:4]), F.lit(","), area(columns[4:]), F.lit(")"))


def measures_text(values: Column | str) -> Column:
    """``M(v0,...)`` with six significant digits at most, as ``%g`` prints them, by plain decimals."""
    return F.concat(F.lit("M("), F.array_join(F.transform(_c(values), lambda v: F.format_string("%s", v)), ","), F.lit(")"))


def knowledge_text(values: Column | str, columns: Sequence[str]) -> Column:
    return F.concat(F.lit("MS("), measures_text(values), F.lit(";"), strains_text(columns), F.lit(")"))


def node_text() -> Column:
    """A row of ``nodes`` as its line in a tree file."""
    results = F.transform("results", lambda r: F.format_string("C(%s,%.6f)", r["outcome"], r["probability"]))
    leaf = F.concat(F.lit("R("), F.concat_ws(",", F.array(F.col("node_id").cast("string")), results), F.lit(")"))
    return F.when(F.col("kind") == "D", F.format_string("D(%d,%d,%d,%d,%d)", "node_id", "ref_val", "feature", "true_id", "false_id")).otherwise(leaf)
