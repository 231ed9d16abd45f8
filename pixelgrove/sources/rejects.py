"""Loading of dropped text lines with every unreadable one set apart, and why.

Two kinds of lines: ``strains`` (``image;S(P(a,b,c,d),P(e,f,g,h))``) and ``knowledge`` (``MS(M(v0,...,v17);S(P(a,b,c,d),P(e,f,g,h)))``).
Blanks, tabs and carriage returns at both ends and then one enclosing pair of double quotes are removed first; the very last
``)`` may be absent; nothing else may stand anywhere.

Structure (frame, number of columns) is judged line by line. Cells are judged by a dictionary: every distinct (type, text) is cast
once, those that cannot be cast form a dictionary with reasons, and it is joined back to the cells. Texts over ``WHOLE`` characters stand in
it by their hash, so that an entry's size is bounded while cells may have any length. A small dictionary is broadcast; a large one is
joined by shuffle with the text salted, so that a value that fills a third of all cells is spread.

Defined results: null and blank lines are neither loaded nor rejected; a line whose kind is null or unknown is rejected
(``unknown kind``); lines delivered twice count once, of unequal deliveries the least by kind, file, line number and text, nulls first; a number
beyond the range of double is read as infinity. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import broadcast_if_small, materialise, one_per_key, small_enough

N_MEASUREMENTS = 18
STRAIN_COLUMNS = ("neck_left", "neck_back", "neck_right", "neck_front", "upper_left", "upper_back", "upper_right", "upper_front")
#: Entries of the dictionary that may be broadcast; none is over 150 bytes.
DICTIONARY_ROWS = 100_000
#: A cell up to this length stands in the dictionary as it is, a longer one by its hash.
WHOLE = 64
SALTS = 16

_AREA = r"P\(([^()]*)\)"
_FRAMES = {
    "strains": r"\A([^;]*);S\(" + _AREA + "," + _AREA + r"\)?\z",
    "knowledge": r"\AMS\(M\(([^()]*)\);S\(" + _AREA + "," + _AREA + r"\)\)?\z",
}


def stripped(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\r"))
    quoted = (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    return F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def _present(lines: DataFrame) -> DataFrame:
    return lines.select("line_id", "kind", "file_name", "line_no", "line").where(F.col("line").isNotNull() & (F.btrim("line", F.lit(" \t\r")) != ""))


def framed(lines: DataFrame) -> DataFrame:
    """Lines with their cells ``_c`` in order and the structural reason ``_structure``, if any.

    One pass of the pattern per line: it turns a line into ``upper)lower)first``, of which ``)`` cannot occur in the first two.
    """
    knowledge, strains = F.col("kind") == "knowledge", F.col("kind") == "strains"
    cut = lines.withColumn("_t", stripped(F.col("line")))
    turned = F.when(knowledge, F.regexp_replace("_t", _FRAMES["knowledge"], "$2)$3)$1")).when(strains, F.regexp_replace("_t", _FRAMES["strains"], "$2)$3)$1"))
    cut = cut.withColumn("_r", turned).withColumn("_p", F.when(F.length("_r") < F.length("_t"), F.split("_r", r"\)", 3)))  # a frame that fits loses its letters
    a, b, first = (F.split(F.col("_p")[i], ",", -1) if i < 2 else F.col("_p")[i] for i in range(3))
    cut = cut.withColumns({"_a": a, "_b": b, "_m": F.when(knowledge, F.split(first, ",", -1)).otherwise(F.array(first))})
    structure = (
        F.when(F.col("_r").isNull(), "unknown kind")
        .when(F.col("_p").isNull(), "frame")
        .when(knowledge & (F.size("_m") != N_MEASUREMENTS), "number of measurements")
        .when((F.size("_a") != 4) | (F.size("_b") != 4), "number of strains")
    )
    return cut.withColumn("_structure", structure).withColumn("_c", F.when(F.col("_structure").isNull(), F.concat("_m", "_a", "_b"))).drop("_t", "_r", "_p", "_m", "_a", "_b")


def cells(cut: DataFrame) -> DataFrame:
    """``line_id, pos, type, key, long`` of structurally sound lines: ``key`` names the cell's text in the dictionary, ``long`` is the text if it is over ``WHOLE``."""
    every = cut.where("_structure is null").select("line_id", "kind", F.posexplode("_c").alias("pos", "raw"))
    kind = F.when(F.col("pos") >= F.when(F.col("kind") == "knowledge", N_MEASUREMENTS).otherwise(1), "strain").when(F.col("kind") == "knowledge", "number").otherwise("image")
    long = F.length("raw") > WHOLE
    return every.select("line_id", "pos", kind.alias("type"), F.when(long, F.concat(F.lit("#"), F.sha2("raw", 256))).otherwise(F.col("raw")).alias("key"), F.when(long, F.col("raw")).alias("long"))


def cast_reason(kind: Column, raw: Column) -> Column:
    """Why a cell's text has no value of its type; null if it has one."""
    digits = F.regexp_replace(raw, r"\A0+", "")
    image = F.when(~raw.rlike(r"\A[0-9]+\z"), "image is not a number").when((F.length(digits) == 0) | (F.length(digits) > 10), "image out of range").when(digits.cast("decimal(11,0)") > 2147483647, "image out of range")
    strain = F.when(~raw.rlike(r"\A[012]\z"), "strain is not 0, 1 or 2")
    number = F.when(~raw.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"), "measurement is not a number")
    return F.when(kind == "image", image).when(kind == "strain", strain).otherwise(number)


def dictionary(found: DataFrame) -> DataFrame:
    """``type, key, reason`` of all distinct cells that have no value."""
    distinct = found.select("type", "key", "long").distinct()
    return materialise(distinct.select("type", "key", cast_reason(F.col("type"), F.coalesce("long", "key")).alias("reason")).where("reason is not null"))


def bad_cells(found: DataFrame, invalid: DataFrame) -> DataFrame:
    """``line_id, pos, reason`` of the cells in the dictionary of invalid values."""
    found = found.drop("long")
    if small_enough(invalid, DICTIONARY_ROWS):
        return found.join(F.broadcast(invalid), ["type", "key"]).select("line_id", "pos", "reason")
    salted = invalid.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("_s", F.pmod(F.xxhash64("line_id"), F.lit(SALTS)).cast("int")).join(salted, ["type", "key", "_s"]).select("line_id", "pos", "reason")


def judged(lines: DataFrame) -> DataFrame:
    """Every distinct non-blank line with ``reason`` (null: valid) and ``detail``, the first offending cell (null where the structure is at fault)."""
    cut = materialise(framed(one_per_key(_present(lines), "line_id")))  # lines are cut once and read thrice
    found = cells(cut)
    worst = bad_cells(found, dictionary(found)).groupBy("line_id").agg(F.min(F.struct("pos", "reason")).alias("_w"))
    worst = materialise(worst.select("line_id", "_w.pos", F.col("_w.reason").alias("_cell")))  # lines with an invalid cell only
    out = cut.join(broadcast_if_small(worst), "line_id", "left")
    return out.withColumn("reason", F.coalesce("_structure", "_cell")).withColumn("detail", F.get("_c", F.col("pos"))).drop("pos")


def rejected(lines: DataFrame) -> DataFrame:
    """``line_id, kind, file_name, line_no, line, reason, detail`` of every unreadable line."""
    return judged(lines).where("reason is not null").select("line_id", "kind", "file_name", "line_no", "line", "reason", "detail")


def loaded(lines: DataFrame) -> DataFrame:
    """``line_id, kind, file_name, line_no, image, mm`` and the eight strain columns of every valid line; image is null for knowledge, mm for strains."""
    good = judged(lines).where("reason is null")
    strains, c = F.col("kind") == "strains", F.col("_c")
    first = F.when(strains, 1).otherwise(N_MEASUREMENTS)
    image = F.when(strains, F.try_to_number(F.lpad(F.regexp_replace(c[0], r"\A0+", ""), 10, "0"), F.lit("9999999999")).cast("int"))
    mm = F.when(~strains, F.transform(F.slice("_c", 1, N_MEASUREMENTS), lambda x: x.try_cast("double")))
    return good.select("line_id", "kind", "file_name", "line_no", image.alias("image"), mm.alias("mm"), *[F.get("_c", first + i).try_cast("int").alias(n) for i, n in enumerate(STRAIN_COLUMNS)])
