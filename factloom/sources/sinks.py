"""Writers. Everything that later jobs read is Parquet; the text formats are exports. All writers replace what is there."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger("factloom")


def columns(df: DataFrame, folder: str, order: list[str]) -> None:
    """[K1] One text file folder for each column, lines in a common order; nulls are empty lines."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    for c in df.columns:
        s.select(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(f"{folder}/{c}")


def ranked(df: DataFrame, path: str, score: str, cols: list[str]) -> None:
    """[K3, K4] A tab-separated list in falling order of the score, ties by the other columns; its parts are in order."""
    order = [F.col(score).desc_nulls_last(), *[F.col(c) for c in cols]]
    df.select(score, *cols).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("sep", "\t").csv(path)


def tac(df: DataFrame, path: str, query: str, slot: str, filler: str, doc: str, score: str) -> DataFrame:
    """[K5] Slot fillers as numbered tab lines, in string order; returns what was written."""
    line = F.concat_ws("\t", query, slot, filler, doc, F.col(score).cast("string"))
    w = Window.partitionBy(query).orderBy("line")
    out = df.select(query, line.alias("line")).withColumn("no", F.row_number().over(w))
    out.select(F.concat_ws("\t", F.col("no").cast("string"), "line").alias("value")).write.mode("overwrite").text(path)
    return out


def metrics(df: DataFrame, path: str) -> None:
    """[K6] A small table of measures as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def distinct_lists(lists: dict[str, DataFrame], folder: str) -> None:
    """[K7] Distinct labels, patterns, tuples ... one folder for each list."""
    for name, df in lists.items():
        df.distinct().write.mode("overwrite").option("sep", "\t").csv(f"{folder}/{name}")


def dictionaries(tables: dict[str, DataFrame], folder: str) -> None:
    """[K8] Dimension tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def miml(df: DataFrame, path: str) -> DataFrame:
    """[K9] Pairs with their mentions (src, dst, labels, mentions ARRAY) as blocks of a RELATION line and MENTION lines; returns the blocks."""
    head = F.concat_ws("\t", F.lit("RELATION"), "src", "dst", "labels")
    block = df.select(F.concat_ws("\n", F.concat(F.array(head), F.transform("mentions", lambda m: F.concat(F.lit("MENTION\t"), m)))).alias("value"))
    block.write.mode("overwrite").text(path)
    return block


def by_relation(df: DataFrame, path: str, relation: str) -> None:
    """[K13] A ranked list split by relation, one folder for each."""
    df.repartition(relation).write.mode("overwrite").partitionBy(relation).parquet(path)


def relation_mentions(pairs: DataFrame, path: str, doc: str, typed: list[str] | None = None, kind: str = "label_1", other: str = "label_2") -> None:
    """[K14] Mention pairs, one row for each feature; with ``typed`` only pairs with an argument of these types."""
    df = pairs if typed is None else pairs.filter(F.col(kind).isin(typed) | F.col(other).isin(typed))
    df.withColumn("feature", F.explode("features")).drop("features").repartitionByRange(doc).sortWithinPartitions(doc).write.mode("overwrite").parquet(path)


def dump(df: DataFrame, path: str, name: str) -> None:
    """[K10, K15] A debug table, with a line in the log."""
    df.write.mode("overwrite").parquet(path)
    log.info("%s written to %s", name, path)


def result_table(df: DataFrame, row: str, column: str, value: str, columns: list[str], style: str = "text", digits: int = 3) -> DataFrame:
    """[K11] (no, line): a table of measures as lines, for LaTeX, gnuplot or reading, a row for each ``row`` and a column for each of the few ``columns``; the
    best of a line is set in bold in LaTeX. Missing values are dashes (``NaN`` for gnuplot). The lines are few: a measure for each relation."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.round(F.first(value), digits))
    cells = [F.col(f"`{c}`") for c in columns]
    best = F.greatest(*cells) if len(cells) > 1 else cells[0]
    number = lambda c: F.format_number(c, digits)
    if style == "latex":
        parts = [F.when(c == best, F.concat(F.lit("\\textbf{"), number(c), F.lit("}"))).otherwise(F.coalesce(number(c), F.lit("-"))) for c in cells]
        line = F.concat(F.concat_ws(" & ", F.regexp_replace(row, "([_$])", "\\\\$1"), *parts), F.lit(" \\\\"))
        head = " & ".join([row, *columns]) + " \\\\"
    elif style == "gnuplot":
        line = F.concat_ws(" ", F.concat(F.lit('"'), F.col(row), F.lit('"')), *[F.coalesce(number(c), F.lit("NaN")) for c in cells])
        head = " ".join(["#", row, *columns])
    else:
        line = F.concat_ws("\t", row, *[F.coalesce(number(c), F.lit("-")) for c in cells])
        head = "\t".join([row, *columns])
    body = wide.select((F.row_number().over(Window.orderBy(row)) + 1).alias("no"), line.alias("line"))
    return df.sparkSession.createDataFrame([(1, head)], "no int, line string").unionByName(body)
