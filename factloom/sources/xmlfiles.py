"""XML query files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slot_queries(spark: SparkSession, path: str, kb: DataFrame | None = None) -> DataFrame:
    """[S17] (query_id, name, enttype, docid) of the ``query`` elements; with ``kb`` (name, guid) also the smallest guid of that name."""
    df = spark.read.format("xml").option("rowTag", "query").schema("_id string, name string, enttype string, docid string").load(path)
    out = df.select(F.col("_id").alias("query_id"), "name", "enttype", "docid")
    return out if kb is None else out.join(kb.groupBy("name").agg(F.min("guid").alias("guid")), "name", "left")
