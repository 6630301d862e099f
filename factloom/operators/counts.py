"""Counting operators: vocabularies, attribute matrices, document frequencies, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPECIALS


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """[A1, A21] Rows of each value."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def token_counts(df: DataFrame, words: Column) -> DataFrame:
    """[A2] Occurrences of each token."""
    return df.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, size: int, specials: list[str] = SPECIALS) -> DataFrame:
    """[A2, A3] (token, id, n): the specials first, then the most frequent tokens up to ``size`` in all, ties by token. A top-k, so
    each task keeps at most ``size`` rows and one task sorts that many."""
    top = counts.filter(~F.col("token").isin(specials)).orderBy(F.col("n").desc(), "token").limit(max(0, size - len(specials)))
    ids = top.withColumn("id", (F.row_number().over(Window.orderBy(F.col("n").desc(), "token")) + len(specials) - 1).cast("int"))
    head = counts.sparkSession.createDataFrame([(s, i, 0) for i, s in enumerate(specials)], "token string, id int, n bigint")
    return head.unionByName(ids.select("token", "id", "n"))


def as_map(vocab: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map of the vocabulary, to be broadcast: bounded by the vocabulary's size."""
    return vocab.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("vocab"))


def top_attributes(rows: DataFrame, entity: str, attr: str, global_above: int, local_above: int, k: int = 50) -> DataFrame:
    """[A7, O3] Per entity the ``k`` attributes it holds most, of those with more than ``global_above`` in all and ``local_above`` of its own."""
    local = rows.groupBy(entity, attr).agg(F.count(F.lit(1)).alias("n_local"))
    total = local.groupBy(attr).agg(F.sum("n_local").alias("n_global")).filter(F.col("n_global") > global_above)
    kept = local.filter(F.col("n_local") > local_above).join(total, attr)
    w = Window.partitionBy(entity).orderBy(F.col("n_local").desc(), attr)
    return kept.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k).select(entity, attr, "n_local", "n_global", "rnk")


def frequent_attributes(rows: DataFrame, attr: str, above: int) -> DataFrame:
    """[A8] Rows whose attribute occurs more than ``above`` times."""
    return rows.join(label_counts(rows.filter(F.col(attr).isNotNull()), attr).filter(F.col("n") > above).select(attr), attr, "left_semi")


def informative_types(rows: DataFrame, key: str, kind: str, above: int, share: float) -> DataFrame:
    """[A9] Types of more than ``above`` keys and less than ``share`` of all keys."""
    per = rows.filter(F.col(kind).isNotNull()).groupBy(kind).agg(F.countDistinct(key).alias("n"))
    total = rows.agg(F.countDistinct(key).alias("n_all"))
    return per.crossJoin(F.broadcast(total)).filter((F.col("n") > above) & (F.col("n") < F.col("n_all") * share)).select(kind, "n")


def dictionary(values: DataFrame, value: str) -> DataFrame:
    """[A20, F33] (value, id): ids from 0 in order of the values.

    Distinct values are range-partitioned and sorted; an id is the place in the partition plus the size of the partitions before,
    so no task sees them all.
    """
    d = values.select(value).filter(F.col(value).isNotNull()).distinct().repartitionByRange(value).sortWithinPartitions(value)
    from ..session import settled

    d = settled(d.select(value, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "dictionary")
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))  # one row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(F.broadcast(before.select("_p", "_first", "_before")), "_p").select(value, (F.col("_i") - F.col("_first") + F.col("_before")).alias("id"))


def feature_matrix(rows: DataFrame, row: str, feature: str, column_cutoff: int, row_cutoff: int) -> DataFrame:
    """[A20] (row, feature) of features in at least ``column_cutoff`` rows, then of rows with at least ``row_cutoff`` such features."""
    d = rows.select(row, feature).filter(F.col(row).isNotNull() & F.col(feature).isNotNull()).distinct()
    d = d.join(d.groupBy(feature).count().filter(F.col("count") >= column_cutoff).select(feature), feature, "left_semi")
    return d.join(d.groupBy(row).count().filter(F.col("count") >= row_cutoff).select(row), row, "left_semi").select(row, feature)


def label_sets(rows: DataFrame, row: str, items: str, prefix: str) -> DataFrame:
    """[A25] Per row, the sorted labels among its items, joined by commas."""
    return rows.select(row, F.array_join(F.array_sort(F.filter(items, lambda x: x.startswith(prefix))), ",").alias("labels"))
