"""Frames as they arrive: streaming sources and sinks, sampling, snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def read_frames(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 8, form: str = "parquet") -> DataFrame:
    """A stream of the frames dropped into a folder."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def every_nth(frames: DataFrame, n: int, seq: str = "seq", offset: int = 0) -> DataFrame:
    """Frames number ``offset``, ``offset + n``, ... of streams that carry a number; works on batches and streams."""
    return frames.where(F.pmod(F.col(seq) - offset, F.lit(n)) == 0)


def numbered(frames: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "seq") -> DataFrame:
    """Frames numbered from 0 per stream (batches only)."""
    return frames.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def snapshots(frames: DataFrame, keep: Sequence[int], seq: str = "seq") -> DataFrame:
    """The frames of given numbers."""
    return frames.where(F.col(seq).isin(list(keep)))


def without_snapshots(frames: DataFrame, drop: Sequence[int], seq: str = "seq") -> DataFrame:
    """Snapshots with those of given numbers freed."""
    return frames.where(~F.col(seq).isin(list(drop)))


def save_snapshots(frames: DataFrame, path: str, keep: Sequence[int], seq: str = "seq", form: str = "parquet", mode: str = "errorifexists") -> None:
    """The frames of given numbers, saved."""
    snapshots(frames, keep, seq).write.format(form).mode(mode).save(path)


def last_frame(frames: DataFrame, by: Sequence[str] = ("stream",), seq: str = "frame") -> DataFrame:
    """All rows of each stream's last frame: of pixels, of a background model, or of masks alike."""
    newest = frames.groupBy(*by).agg(F.max(seq).alias(seq))
    return frames.join(newest, [*by, seq])


def per_row(rows: DataFrame, callback: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """A callback over all rows of a scan, called with blocks of them (Arrow batches) and not row by row; no shuffle."""

    def run(blocks):
        for block in blocks:
            yield callback(block)

    return rows.mapInPandas(run, schema)


def write_frames(frames: DataFrame, path: str, checkpoint: str, n: int = 30, seq: str = "seq", form: str = "parquet") -> DataStreamWriter:
    """Sink that keeps every n-th frame; start it with ``.start()``."""
    return every_nth(frames, n, seq).writeStream.format(form).option("checkpointLocation", checkpoint).option("path", path).outputMode("append")


def with_operations(frames: DataFrame, operations: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Frame operations one after another."""
    for f in operations:
        frames = frames.transform(f)
    return frames


def listen(frames: DataFrame, listeners: Sequence[Callable[[DataFrame, int], None]], checkpoint: str) -> DataStreamWriter:
    """Every micro-batch is shown to all listeners, read once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for f in listeners:
                f(batch, number)
        finally:
            batch.unpersist()

    return frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def dispatch(streams: dict[str, DataFrame], listeners: dict[str, Sequence[Callable[[DataFrame, int], None]]], checkpoint: str) -> dict[str, DataStreamWriter]:
    """One writer per named stream (depth, colour ...) with that stream's listeners."""
    return {name: listen(df, listeners.get(name, ()), f"{checkpoint}/{name}") for name, df in streams.items()}
