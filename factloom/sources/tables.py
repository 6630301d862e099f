"""The parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import tune


def table(spark: SparkSession, sf_dir: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Table ``name`` of the folder; columns and filters of the query reach the scan. ``schema`` can name fewer fields, nested ones too."""
    tune(spark)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def ids_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """[S19] Rows whose key is among the ids: a batch lookup, whatever the size of either side."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def index(df: DataFrame, path: str, keys: list[str]) -> None:
    """[S19] Write a table once for each declared key, sorted by ranges of it, so that a lookup reads only the row groups whose bounds hold the key."""
    for key in keys:
        df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/by-{key}")


def find(spark: SparkSession, path: str, key: str, values: list, order: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """[S19] Rows of an indexed table whose key is one of a few values; the filter reaches the scan. With ``order`` a cursor that skips rows and ends after
    ``limit``."""
    out = spark.read.parquet(f"{path}/by-{key}").filter(F.col(key).isin(values))
    if order is not None:
        out = out.orderBy(order).offset(skip)
    return out if limit is None else out.limit(limit)


def grouped_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """[S19] The sorted values of each key, as an index would give them."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))
