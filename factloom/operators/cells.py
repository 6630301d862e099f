"""The cell matrix (arg1, arg2) x relation as a long table: filters, fills and set operations. Ids of the survey in brackets.

A tuple is (arg1, arg2); arg2 is null for unary relations, and null equals null in all comparisons of tuples here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_prefix

TUPLE = ["arg1", "arg2"]


def same_tuple(a: DataFrame, b: DataFrame) -> Column:
    """Equality of the tuples of two tables."""
    return a["arg1"].eqNullSafe(b["arg1"]) & a["arg2"].eqNullSafe(b["arg2"])


def tuple_join(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on tuple columns (null-safe) and others; only ``a``'s key columns stay."""
    names = {c: f"_r_{c}" for c in on}
    right = b.withColumnsRenamed(names)
    cond = None
    for c in on:
        eq = a[c].eqNullSafe(right[names[c]])
        cond = eq if cond is None else cond & eq
    return a.join(right, cond, how).drop(*names.values()) if how not in ("left_semi", "left_anti") else a.join(right, cond, how)


def distinct_cells(cells: DataFrame) -> DataFrame:
    """(relation, arg1, arg2) once each."""
    return cells.select("relation", *TUPLE).distinct()


def frequency_filter(cells: DataFrame, rel_cutoff: int, tuple_cutoff: int, predict: list[str], below: int = 50, negative: str = "REL$NA") -> DataFrame:
    """[P4] Two stages, in this order: cells whose relation has at least ``rel_cutoff`` cells (repeats counted), then tuples with
    ``tuple_cutoff`` <= n < ``below`` surviving predictable cells that aren't negative. Adds n_rel and n_tuple.

    Both counts are partial aggregates joined back, so no relation or tuple, however much of the table it holds, has to be in one task.
    """
    rels = cells.groupBy("relation").agg(F.count(F.lit(1)).alias("n_rel")).filter(F.col("n_rel") >= rel_cutoff)
    kept = cells.join(rels, "relation")
    n = F.count_if(has_prefix(F.col("relation"), predict) & (F.col("relation") != negative))
    tuples = kept.groupBy(*TUPLE).agg(n.alias("n_tuple")).filter((F.col("n_tuple") >= tuple_cutoff) & (F.col("n_tuple") < below))
    return tuple_join(kept, tuples, TUPLE, "inner")


def roles(cells: DataFrame) -> DataFrame:
    """Cells with ``training``, ``unlabeled`` and ``test``, by hide, to_predict and gold."""
    hide, predict = F.coalesce("hide", F.lit(False)), F.coalesce("to_predict", F.lit(False))
    return cells.withColumns({"training": ~hide & predict, "unlabeled": hide & ~predict, "test": hide & (F.col("gold") != 0.5)})


def role_of(relation: Column, features: list[str], predicted: list[str], unused: list[str]) -> Column:
    """[P1, P5] skipped, feature, label or pattern by a relation's prefix."""
    return F.when(has_prefix(relation, unused), "skipped").when(has_prefix(relation, features), "feature").when(has_prefix(relation, predicted), "label").otherwise("pattern")


def sample_negative_labels(cells: DataFrame, keep_every: int, line_no: Column, negative: str = "NA", prefix: str = "REL$") -> DataFrame:
    """[P3] Of the tuples labelled NA only each ``keep_every``-th keeps its label cells; all keep their other cells."""
    na = cells.filter(F.col("relation") == prefix + negative).select(*TUPLE).distinct().withColumn("_na", F.lit(True))
    dropped = F.coalesce("_na", F.lit(False)) & (F.pmod(line_no, F.lit(keep_every)) != 0) & F.col("relation").startswith(prefix)
    return tuple_join(cells, na, TUPLE, "left").filter(~dropped).drop("_na")


def known_cells(test: DataFrame, train: DataFrame, labels: list[str]) -> DataFrame:
    """[P6] Test cells whose relation training knows or that are labels, of tuples with at least one such predictable cell."""
    known = train.select("relation").distinct().withColumn("_known", F.lit(True))
    marked = test.join(known, "relation", "left").withColumn("hidden", has_prefix(F.col("relation"), labels))
    return marked.filter(F.coalesce("_known", F.lit(False)) | F.col("hidden")).drop("_known")


def remove_uninformative(cells: DataFrame, label: str = "REL$", only_labelled: bool = False) -> DataFrame:
    """[P7] Leaves out tuples with at most one training cell and no hidden one; with ``only_labelled`` also those without a positive label."""
    hide = F.coalesce("hide", F.lit(False))
    good = F.max(F.col("relation").startswith(label) & (F.col("gold") > 0.5)) if only_labelled else F.lit(True)
    told = cells.groupBy(*TUPLE).agg(F.count_if(~hide).alias("_n"), F.max(hide).alias("_h"), good.alias("_g")).filter("(_n > 1 or _h) and _g")
    return tuple_join(cells, told.select(*TUPLE), TUPLE, "left_semi")


def whitelist(cells: DataFrame, relations: DataFrame, tuples: DataFrame) -> DataFrame:
    """[P8] Cells of allowed relations and tuples."""
    return tuple_join(cells.join(relations.select("relation"), "relation", "left_semi"), tuples.select(*TUPLE), TUPLE, "left_semi")


def missing_tuples(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """[P8, U2] Wanted tuples that no cell has."""
    return tuple_join(wanted.select(*TUPLE).distinct(), cells.select(*TUPLE).distinct(), TUPLE, "left_anti")


def insert_absent(cells: DataFrame, more: DataFrame) -> DataFrame:
    """[J17] ``cells`` and those of ``more`` whose (relation, tuple) isn't there yet."""
    return cells.unionByName(tuple_join(more, distinct_cells(cells), ["relation", *TUPLE], "left_anti"))


def first_cell(cells: DataFrame, order: str) -> DataFrame:
    """[J17] Of cells with the same (relation, tuple) the first by ``order``: one aggregation with a partial step."""
    rest = [c for c in cells.columns if c not in ("relation", *TUPLE)]
    best = cells.groupBy("relation", *TUPLE).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(*[F.col("_b").getField(c).alias(c) if c in rest else F.col(c) for c in cells.columns])


def filled(tuples: DataFrame, relations: DataFrame, cells: DataFrame, value: float = 0.0) -> DataFrame:
    """[J18, J19] Every tuple x relation that has no cell, with a value. ``relations`` is a short list of targets."""
    every = tuples.select(*TUPLE).distinct().crossJoin(relations.select("relation").distinct())
    return tuple_join(every, distinct_cells(cells), ["relation", *TUPLE], "left_anti").withColumn("target", F.lit(value))


def add_to_known(cells: DataFrame, more: DataFrame) -> DataFrame:
    """[J20] Cells of ``more`` whose tuple has a cell."""
    return tuple_join(more, cells.select(*TUPLE).distinct(), TUPLE, "left_semi")


def gold_values(cells: DataFrame, gold: DataFrame) -> DataFrame:
    """[J16] ``value`` 1.0 where (tuple, relation) is in ``gold``, else 0.0."""
    g = gold.select("relation", *TUPLE).distinct().withColumn("_g", F.lit(1.0))
    return tuple_join(cells, g, ["relation", *TUPLE], "left").withColumn("value", F.coalesce("_g", F.lit(0.0))).drop("_g")


def duplicated_rows(cells: DataFrame, extra: DataFrame) -> DataFrame:
    """[J26, P17] For each cell of ``extra``, a copy of its tuple's cells under the tuple name ``arg1 [relation]``, with the extra cell
    as negative; ``is_dup`` marks the copies."""
    copies = tuple_join(cells.select(*TUPLE, F.col("relation").alias("_own")), extra.select(*TUPLE, F.col("relation").alias("_neg")), TUPLE, "inner")
    name = F.concat("arg1", F.lit(" ["), "_neg", F.lit("]"))
    copied = copies.select(F.col("_own").alias("relation"), name.alias("arg1"), "arg2", F.lit(1.0).alias("target"))
    neg = tuple_join(extra, cells.select(*TUPLE).distinct(), TUPLE, "left_semi")
    negs = neg.select("relation", F.concat("arg1", F.lit(" ["), "relation", F.lit("]")).alias("arg1"), "arg2", F.lit(0.0).alias("target"))
    return copied.unionByName(negs).withColumn("is_dup", F.lit(True)).distinct()


def label_overlap(cells: DataFrame, label: str = "REL$") -> DataFrame:
    """[S10] Tuples that hold a hidden label cell and how many open cells stand beside them."""
    lab = F.col("relation").startswith(label)
    return cells.groupBy(*TUPLE).agg(F.count_if(lab).alias("n_labels"), F.count_if(~lab).alias("n_open")).filter("n_labels > 0")


def unary_of_known(cells: DataFrame) -> DataFrame:
    """[S11] Unary cells whose entity is an argument of a binary cell."""
    unary = cells.filter(F.col("arg2").isNull())
    binary = cells.filter(F.col("arg2").isNotNull())
    ents = binary.select(F.col("arg1").alias("e")).union(binary.select("arg2")).distinct()
    return unary.join(ents, unary["arg1"] == ents["e"], "left_semi")


def lookup(cells: DataFrame, relation: str | None = None, arg1: str | None = None, entity: str | None = None) -> DataFrame:
    """[P16] Cells by relation, first argument or any argument; the filters reach the scan."""
    if relation is not None:
        cells = cells.filter(F.col("relation") == relation)
    if arg1 is not None:
        cells = cells.filter(F.col("arg1") == arg1)
    return cells if entity is None else cells.filter((F.col("arg1") == entity) | (F.col("arg2") == entity))


def without(cells: DataFrame, gone: DataFrame) -> DataFrame:
    """[P16] Cells that aren't in ``gone``."""
    return tuple_join(cells, distinct_cells(gone), ["relation", *TUPLE], "left_anti")


def pseudo_features(cells: DataFrame, label: str = "REL$", bias: bool = False) -> DataFrame:
    """[M12] For each training cell, the other non-label relations of its tuple as features; with ``bias`` a constant one too."""
    train = cells.filter(~F.coalesce("hide", F.lit(False))).select("relation", *TUPLE).distinct()
    feats = train.filter(~F.col("relation").startswith(label)).withColumnRenamed("relation", "feature")
    out = tuple_join(train, feats, TUPLE, "inner").filter("relation <> feature")
    return out.unionByName(train.withColumn("feature", F.lit("_bias"))) if bias else out
