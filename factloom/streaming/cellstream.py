"""Extension: the matrix as a stream. The original has no streaming; this keeps first cells and windowed counts over arriving cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def once(cells: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """[J17] Each (relation, tuple) once while its first arrival is within the watermark; state for older ones is dropped."""
    return cells.withWatermark(time, delay).dropDuplicatesWithinWatermark(["relation", "arg1", "arg2"])


def windowed_counts(cells: DataFrame, time: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """[A1] Cells of each relation in each time window, late ones counted within the watermark."""
    return cells.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "relation").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "relation", "n")
