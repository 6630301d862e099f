"""The queries of the llm operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deliveries import once_per_key
from ..session import settled, spread
from ..sources.tables import table
from . import bpe, forms, freq, leak, names, overlap, together, topn


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train record and a validation or test record that overlap; smaller rec_id first."""
    p = overlap.split_overlaps(table(spark, d, "corpus_records"))
    return p.select(F.least("rec_id_train", "rec_id_held").alias("rec_id_a"), F.greatest("rec_id_train", "rec_id_held").alias("rec_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping held-out records and pairs per split and source."""
    return overlap.overlap_report(table(spark, d, "corpus_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each relation's five best tuples."""
    rows = topn.latest_scores(table(spark, d, "cells"))
    ties = [F.col("arg1").asc_nulls_first(), F.coalesce("arg2", F.lit("")).asc(), F.col("cell_id").asc()]
    return topn.top_n(rows, "relation", "predicted", ties, 5).select("relation", "rnk", "cell_id")


def corpus_terms(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """One array of terms for each record, by field."""
    # written once without the repeats: two fields are counted in it, each in two passes
    corpus = settled(once_per_key(table(spark, d, "corpus_records").select("rec_id", "relations", "sentences"), "rec_id"), "corpus")
    kb = settled(once_per_key(table(spark, d, "kb_relations").select("rel_key", F.col("mention.feature").alias("f")), "rel_key"), "features")
    return {
        "relations": corpus.select(F.array(F.trim("relations")).alias("terms")),
        "sentences": corpus.select(F.split(F.lower("sentences"), " ").alias("terms")),
        "feature": kb.select(F.flatten(F.array_compact("f")).alias("terms")),
    }


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every field with its occurrences, records and mark."""
    out = None
    for field, records in corpus_terms(spark, d).items():
        one = freq.term_frequencies(records).select(F.lit(field).alias("field"), "term", "n_occurrences", "n_records", "mark")
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms that are too rare or too common."""
    return p5_terms(spark, d).filter("mark is not null").select("field", "term", "mark")


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """The items of each record of kb_relations: its reltype and the features of all its mentions."""
    kb = once_per_key(table(spark, d, "kb_relations").select("rel_key", "reltype", F.col("mention.feature").alias("f")), "rel_key")
    return kb.select(F.concat(F.array("reltype"), F.coalesce(F.flatten(F.array_compact("f")), F.array().cast("array<string>"))).alias("items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items in at least 5 records together and at least 10 times as often as by chance."""
    return together.associated(baskets(spark, d), min_together=5, min_lift=10.0).select("item_a", "item_b")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """Count and excess over chance of every pair of items."""
    return together.associated(baskets(spark, d)).select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that name the same entity: two of kb_entities, or one of them and an unlinked mention."""
    return names.same_entity_pairs(table(spark, d, "kb_entities"), table(spark, d, "entity_mentions"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their texts over all cores: each is worked through in Python."""
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(_texts(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 13 consecutive words of an item."""
    return p9_matches(spark, d).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of each document and item, and where it is in both."""
    return leak.leaks(_texts(spark, d), table(spark, d, "eval_items"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay when affected ones are removed."""
    docs = table(spark, d, "documents")
    return leak.without_leaks(docs.select("doc_id", "source"), p9_matches(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look alike and differ as stored."""
    return forms.same_form_pairs(_texts(spark, d))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its one form, with its tokens of mixed scripts and whole-script look-alikes."""
    return forms.with_forms(_texts(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p5_found, p5_terms, p6_found, p6_scores, p7_found, p8_ids, p9_found, p9_matches, p9_clean, p10_found, p10_forms)}
