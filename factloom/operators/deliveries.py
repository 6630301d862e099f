"""Repeated deliveries of one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``; the rows of a key must be alike in the columns given, so any of them serves.

    Rows whose key is null can't be known as repeats: each stays. One shuffle on the key.
    """
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.filter(F.col(key).isNull()))


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """For each value of ``key`` the row that is last in ``order``, nulls first; ties end by the hash of the row.

    The pick is one aggregation, with a partial one before the shuffle. Rows with a null key each stay.
    """
    names = [c for c in df.columns if c != key]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64(*names).alias("tie"))
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), rank).alias("_r"))
    kept = best.select(key, *[F.col("_r").getField(c).alias(c) for c in names])
    return kept.select(*df.columns).unionByName(df.filter(F.col(key).isNull()))
