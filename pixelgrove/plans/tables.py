"""Reading tables, cutting lineage, and size checks before anything is broadcast."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine (tests) gets a temporary one; on a cluster that would scatter tables over the
    executors' own disks, so there it is an error.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="pixelgrove-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end, so results have to be written or collected before; for long sessions."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            _remove(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table into the shared folder and read it back.

    The table survives the loss of any executor. It is removed at the end of the innermost ``scope``, without one when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def traced(df: DataFrame, name: str, enabled: bool = True) -> DataFrame:
    """``df`` that reports its number of rows under ``name`` to query listeners and the log of the run, without a pass of its own."""
    return df.observe(name, F.count(F.lit(1)).alias("rows")) if enabled else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter does
        pass


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


#: Most rows of a few numbers each (under 100 bytes) that are sent to every task.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; for tables of a few numbers a row that are cheap to count."""
    return F.broadcast(df) if small_enough(df, rows) else df


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per non-null key: of unequal deliveries the least by the order of the columns, nulls first. Rows delivered once, nearly all, aren't shuffled.

    Only the keys are aggregated first. If those delivered again are at most ``BROADCAST_ROWS``, they are sent to the tasks and only their rows
    are deduplicated; otherwise all rows are. Columns must be orderable (no maps).
    """

    def least(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != key]
        if not others:
            return rows.distinct()
        return rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(*[key if c == key else F.col("_r")[c].alias(c) for c in rows.columns])

    keyed = df.where(F.col(key).isNotNull())
    again = materialise(keyed.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if not small_enough(again, BROADCAST_ROWS):
        return least(keyed)
    marked = F.broadcast(again)
    return keyed.join(marked, key, "left_anti").unionByName(least(keyed.join(marked, key, "left_semi")))


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to all executors, present and later ones, once per application; for sessions started without ``--py-files``."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    path = f"{shared_dir(spark)}/{package.name}-{uuid.uuid4().hex}.zip"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where)
    out.write(packed.getvalue())
    out.close()
    atexit.register(_remove, spark, path)
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
