"""Distant supervision, groupings of mention pairs and joins of the matrix with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_ranks


def distant_labels(pairs: DataFrame, kb: DataFrame, entities: DataFrame, known: DataFrame | None) -> DataFrame:
    """[J2] (src, dst, relation, tag, inverse) for each pair.

    A KB triple of the pair makes it POSITIVE; else one of the reversed pair, with the ends swapped and ``inverse`` set; else, if neither
    direction is in ``known``, NEGATIVE where both ends are KB entities and UNLABELED where not; all others are dropped. Without
    ``known`` all pairs without a triple are dropped.
    """
    triples = kb.select("source", "dest", "relation").distinct()
    f = triples.select(F.col("source").alias("src"), F.col("dest").alias("dst"), F.col("relation").alias("_fwd"))
    r = triples.select(F.col("dest").alias("src"), F.col("source").alias("dst"), F.col("relation").alias("_rev"))
    p = pairs.select("src", "dst").distinct()
    hit = p.join(f, ["src", "dst"]).select("src", "dst", F.col("_fwd").alias("relation"), F.lit("POSITIVE").alias("tag"), F.lit(False).alias("inverse"))
    rest = p.join(f.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    back = rest.join(r, ["src", "dst"]).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("_rev").alias("relation"), F.lit("POSITIVE").alias("tag"), F.lit(True).alias("inverse"))
    out = hit.unionByName(back)
    if known is None:
        return out
    k = known.select("src", "dst")
    both = k.unionByName(k.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    none = rest.join(r.select("src", "dst").distinct(), ["src", "dst"], "left_anti").join(both, ["src", "dst"], "left_anti")
    e = entities.select(F.col("entity"), F.lit(True).alias("_is")).distinct()
    none = none.join(e.withColumnsRenamed({"entity": "src", "_is": "_s"}), "src", "left").join(e.withColumnsRenamed({"entity": "dst", "_is": "_d"}), "dst", "left")
    tag = F.when(F.col("_s") & F.col("_d"), "NEGATIVE").otherwise("UNLABELED")
    return out.unionByName(none.select("src", "dst", F.lit("REL$NA").alias("relation"), tag.alias("tag"), F.lit(False).alias("inverse")))


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """[J2] Mention rows (src, dst, src_ner, dst_ner, path, features, ...) with the ``tag`` and ``relation`` that ``distant_labels`` gave their pair,
    and ``ner`` as source->dest. Where the KB has the reversed pair, ends and types change places, and path and features are marked ``:INV``.
    Null paths and features stay null; pairs without a label give no row."""
    rest = [c for c in rows.columns if c not in ("src", "dst", "src_ner", "dst_ner", "path", "features")]
    inv = F.col("inverse")
    # a reversed label names the pair as the KB does; the rows have it the other way round
    at = labels.select(F.when(inv, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(inv, F.col("src")).otherwise(F.col("dst")).alias("dst"), "tag", "relation", "inverse")
    j = rows.join(at, ["src", "dst"])
    turned = lambda a, b: F.when(inv, F.col(b)).otherwise(F.col(a))
    mark = lambda c: F.concat(c, F.when(inv, F.lit(":INV")).otherwise(F.lit("")))
    return j.select(
        *rest, "tag", turned("src", "dst").alias("src"), turned("dst", "src").alias("dst"), "relation", F.concat(turned("src_ner", "dst_ner"), F.lit("->"), turned("dst_ner", "src_ner")).alias("ner"),
        mark(F.col("path")).alias("path"), F.transform("features", mark).alias("features"),
    )


def unmatched_triples(pairs: DataFrame, kb: DataFrame) -> DataFrame:
    """[J2, U2] Pairs of the KB that no pair matches in either direction."""
    p = pairs.select(F.col("src").alias("source"), F.col("dst").alias("dest"))
    both = p.unionByName(p.select(F.col("dest").alias("source"), F.col("source").alias("dest"))).distinct()
    return kb.select("source", "dest").distinct().join(both, ["source", "dest"], "left_anti")


def named_ends(rel: DataFrame, names: DataFrame) -> DataFrame:
    """[J3] Triples with the names of both ends; those with an unknown end are left out. ``names`` has (guid, name), guid unique."""
    a = names.select(F.col("guid").alias("source"), F.col("name").alias("source_name"))
    b = names.select(F.col("guid").alias("dest"), F.col("name").alias("dest_name"))
    return rel.join(a, "source").join(b, "dest")


def unknown_ends(rel: DataFrame, names: DataFrame) -> DataFrame:
    """[J3, J13] Guids of ends without a name."""
    ends = rel.select(F.col("source").alias("guid")).union(rel.select("dest")).distinct()
    return ends.join(names.select("guid"), "guid", "left_anti")


def attached(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """[J4, J7] Left rows with the sorted distinct values of the right side, empty where there are none."""
    per = right.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(f"{value}_list"))
    return left.join(per, keys, "left").withColumn(f"{value}_list", F.coalesce(f"{value}_list", F.array().cast("array<string>")))


def mapped_types(rows: DataFrame, key: str, kind: str, mapping: DataFrame) -> DataFrame:
    """[J6] Types sent through a map (kind, target), unmapped ones dropped; the distinct targets of each key."""
    hit = rows.join(mapping.select(F.col("kind").alias(kind), "target"), kind)
    return hit.groupBy(key).agg(F.array_sort(F.collect_set("target")).alias("types"))


def tag_priority(tag: Column) -> Column:
    """POSITIVE before NEGATIVE before UNLABELED; anything else below all."""
    t = F.upper(F.trim(tag))
    return F.when(t == "POSITIVE", 3).when(t == "NEGATIVE", 2).when(t == "UNLABELED", 1).otherwise(0)


def grouped_pairs(mentions: DataFrame, features: str) -> DataFrame:
    """[A4] (src, dst, tag, n_mentions, feature): per pair the strongest tag and number of mentions, with a row for each of its distinct features, one
    with a null feature where it has none; ``sen#`` features, tags and nulls are left out.

    Rows, not an array of features for each pair, so that a pair which holds much of the table is no larger a row than others.
    """
    tags = mentions.groupBy("src", "dst").agg(F.max(tag_priority(F.col("tag"))).alias("p"), F.count(F.lit(1)).alias("n_mentions"))
    flat = mentions.select("src", "dst", F.explode(features).alias("feature"))
    flat = flat.filter(F.col("feature").isNotNull() & ~F.col("feature").startswith("sen#") & ~F.col("feature").isin("POSITIVE", "NEGATIVE", "UNLABELED")).distinct()
    name = F.get(F.array(F.lit(None).cast("string"), F.lit("UNLABELED"), F.lit("NEGATIVE"), F.lit("POSITIVE")), F.col("p"))
    return tags.join(flat, ["src", "dst"], "left").select("src", "dst", name.alias("tag"), "n_mentions", "feature")


def pair_sets(rows: DataFrame, src: str, dst: str, value: str) -> DataFrame:
    """[A5, A6, S21] Per pair, the sorted distinct values."""
    flat = rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(value).alias("v")).filter("v is not null").distinct()
    return flat.groupBy("src", "dst").agg(F.array_sort(F.collect_list("v")).alias("values"))


def two_hops(triples: DataFrame, order: str) -> DataFrame:
    """[J8] Compositions (a, r1, b) (b, r2, c) with one second leg for each b, the last by ``order``; ``mark`` POS where a triple joins
    (a, c), or else (c, a), and that relation."""
    legs = triples.groupBy(F.col("source").alias("b")).agg(F.max_by(F.struct(F.col("relation").alias("r2"), F.col("dest").alias("c")), order).alias("_l")).select("b", "_l.r2", "_l.c")
    hops = triples.select(F.col("source").alias("a"), F.col("relation").alias("r1"), F.col("dest").alias("b")).join(legs, "b")
    direct = triples.groupBy("source", "dest").agg(F.max_by("relation", order).alias("direct"))
    fwd = direct.select(F.col("source").alias("a"), F.col("dest").alias("c"), F.col("direct").alias("_f"))
    rev = direct.select(F.col("dest").alias("a"), F.col("source").alias("c"), F.col("direct").alias("_r"))
    out = hops.join(fwd, ["a", "c"], "left").join(rev, ["a", "c"], "left")
    rel = F.coalesce("_f", "_r")
    return out.select("a", "r1", "b", "r2", "c", rel.alias("direct"), F.when(rel.isNotNull(), "POS").alias("mark"))


def second_order(triples: DataFrame, target: str) -> DataFrame:
    """[J9] For each pair (a, b) of the target relation and each c with (a, ., c) and (c, ., b): the sorted relations of both legs.

    Legs are grouped per pair first, so relations don't multiply. Each pair starts from the end that has fewer legs, and the legs that must close
    the triangle are joined by both their ends; so a hub is gone through only for pairs whose other end is one too.
    """
    legs = triples.groupBy("source", "dest").agg(F.array_sort(F.collect_set("relation")).alias("rels"))
    want = triples.filter(F.col("relation") == target).select(F.col("source").alias("a"), F.col("dest").alias("b")).distinct()
    first = legs.select(F.col("source").alias("a"), F.col("dest").alias("c"), F.col("rels").alias("rels_ac"))
    second = legs.select(F.col("source").alias("c"), F.col("dest").alias("b"), F.col("rels").alias("rels_cb"))
    out_of_a = legs.groupBy(F.col("source").alias("a")).agg(F.count(F.lit(1)).alias("_out"))
    into_b = legs.groupBy(F.col("dest").alias("b")).agg(F.count(F.lit(1)).alias("_in"))
    sized = want.join(out_of_a, "a").join(into_b, "b")
    forth = sized.filter("_out <= _in").select("a", "b").join(first, "a").join(second, ["c", "b"])
    back = sized.filter("_out > _in").select("a", "b").join(second, "b").join(first, ["a", "c"])
    cols = ["a", "b", "c", "rels_ac", "rels_cb"]
    return forth.select(*cols).unionByName(back.select(*cols))


def cooccurrence(cells: DataFrame, order: str) -> DataFrame:
    """[A10] (rel_i, rel_j, n): ordered pairs of a tuple's cells, the first before the second by ``order``.

    A join of the cells with themselves, so no tuple is gathered into one row and a dominant tuple's partition can be split.
    """
    key = ["arg1", "arg2"]
    x = cells.select(*key, F.col("relation").alias("rel_i"), F.col(order).alias("_i"))
    y = cells.select(*key, F.col("relation").alias("rel_j"), F.col(order).alias("_j"))
    return x.join(y, key).filter("_i < _j").groupBy("rel_i", "rel_j").agg(F.count(F.lit(1)).alias("n"))


def symmetric_cooccurrence(cells: DataFrame) -> DataFrame:
    """[A11] (relation, other, n): in how many tuples two different relations stand together, both ways. Cells are made distinct first; null
    second arguments are equal."""
    c = cells.select("relation", "arg1", "arg2").distinct()
    y = c.select(F.col("relation").alias("other"), F.col("arg1").alias("_a"), F.col("arg2").alias("_b"))
    half = c.join(y, c["arg1"].eqNullSafe(y["_a"]) & c["arg2"].eqNullSafe(y["_b"]) & (c["relation"] < y["other"])).groupBy("relation", "other").agg(F.count(F.lit(1)).alias("n"))
    return half.select("relation", "other", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("_s")).select(
        F.when(F.col("_s") == 0, F.col("relation")).otherwise(F.col("other")).alias("relation"), F.when(F.col("_s") == 0, F.col("other")).otherwise(F.col("relation")).alias("other"), "n"
    )


def correlated_features(counts: DataFrame, cutoff: int) -> DataFrame:
    """[A12] Feature pairs (relation, other) with at least ``cutoff`` common tuples, counted both ways."""
    return counts.filter(F.col("n") >= cutoff)


def feature_universe(features: DataFrame, targets: DataFrame) -> DataFrame:
    """[A13] All feature x target relations that differ. Both are lists of distinct relations."""
    t = targets.select(F.col("relation").alias("target")).distinct()
    return features.select(F.col("relation").alias("feature")).distinct().crossJoin(t).filter("feature <> target")


def aligned(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """[J27] Gold pairs with ``hit``: whether the predicted label is a part of the pair's joined labels."""
    j = gold.join(predicted, ["src", "dst"], "left")
    return j.withColumn("hit", F.coalesce(F.contains("labels", F.col("predicted")), F.lit(False)))


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """[S14] A lookup from lines: of repeated keys the last line counts."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """[J23] Rows with ``line_no`` from 1 in a given total order, by ranges. For lists that are joined by position."""
    return global_ranks(rows, order).withColumnRenamed("rnk", "line_no")


def by_position(a: DataFrame, b: DataFrame, order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """[J23] Two lists side by side, row by row in their orders; a shorter one gives nulls. Columns of ``b`` that clash get the suffix ``_b``."""
    y = numbered(b, order_b)
    y = y.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c in a.columns})
    return numbered(a, order_a).join(y, "line_no", "full")
