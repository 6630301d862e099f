"""Top N items within every group (problem 2).

Method: in each partition, the N-th best score of a group is a lower bound of the group's N-th best score overall; the
largest bound of each group is joined to the rows, rows below it are filtered, and only the survivors are ranked. A group
with millions of rows so sends about N rows of each partition on, and no task ever holds a whole group.

Cases: rows whose score is null or NaN are left out; equal scores are ordered by the tie columns (nulls as given there);
groups with fewer than N rows in every partition have no bound and stay whole; a null group is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.naming import free


def latest_scores(cells: DataFrame) -> DataFrame:
    """(relation, arg1, arg2, predicted, cell_id): per tuple of a relation the valid cell scored last, then of the largest id.

    One shuffle on (relation, arg1, arg2) with a partial aggregation before it; a null scored_at counts as the earliest.
    """
    valid = cells.filter(F.col("predicted").isNotNull() & ~F.isnan("predicted"))
    last = F.max(F.struct(F.col("scored_at").alias("s"), F.col("cell_id").alias("c"), F.col("predicted").alias("p")))
    return valid.groupBy("relation", "arg1", "arg2").agg(last.alias("m")).select("relation", "arg1", "arg2", F.col("m.p").alias("predicted"), F.col("m.c").alias("cell_id"))


def partition_bounds(rows: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """(group, bound): the largest of the partitions' own N-th best scores.

    Spark limits each partition to its N best rows of a group before the exchange (WindowGroupLimit), so that exchange
    carries at most N rows for each group and partition.
    """
    part, place = free([group, score, "bound"], "_part", "_place")
    local = rows.select(group, score, F.spark_partition_id().alias(part))
    w = Window.partitionBy(group, part).orderBy(F.col(score).desc())
    nth = local.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n).filter(F.col(place) == n)
    return nth.groupBy(group).agg(F.max(score).alias("bound"))


def top_n(rows: DataFrame, group: str, score: str, ties: list[Column], n: int, rank: str = "rnk") -> DataFrame:
    """The N best rows of each group with ``rank`` INT 1..N; ``ties`` orders equal scores and should be total.

    Rows equal to the bound survive, so ties across partitions are decided by the tie columns alone. All columns of ``rows`` stay.
    """
    g, bound = free([*rows.columns, rank], "_group", "_bound")
    bounds = partition_bounds(rows, group, score, n).select(F.col(group).alias(g), F.col("bound").alias(bound))
    alive = rows.join(bounds, rows[group].eqNullSafe(bounds[g]), "left").filter(F.col(bound).isNull() | (F.col(score) >= F.col(bound))).drop(g, bound)
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), *ties)
    return alive.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
