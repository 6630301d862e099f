"""Queries of the smaller operators: field choice, set operations, indexes, evidence, group terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scoring, text
from ..models import factor
from ..operators import ranking
from ..operators.deliveries import latest_per_key
from ..session import scratch
from ..sources.tables import find, grouped_by, ids_in, index, table


def model_fields(spark: SparkSession, d: str) -> DataFrame:
    """[P15] The fields a model takes, renamed."""
    return table(spark, d, "corpus_records").select("rec_id", "loaded_at", F.col("sentences").alias("text"), F.col("labels").alias("relation"), F.col("paths").alias("short_text"), F.length("sentences").alias("text_length"))


def feature_union(spark: SparkSession, d: str) -> DataFrame:
    """[U1, U3, U5] Distinct relations of open and hidden cells, with the part they are from."""
    c = table(spark, d, "cells")
    part = lambda name, cond: c.filter(cond).select(F.lit(name).alias("part"), "relation").distinct()
    return part("train", ~F.col("hide")).unionByName(part("test", F.col("hide")))


def unseen_relations(spark: SparkSession, d: str) -> DataFrame:
    """[U2] Relations of hidden cells that no open cell has."""
    u = feature_union(spark, d)
    return u.filter("part = 'test'").join(u.filter("part = 'train'"), "relation", "left_anti").select("relation")


def mentions_of_people(spark: SparkSession, d: str) -> DataFrame:
    """[S19] Mention labels of each person entity."""
    people = table(spark, d, "kb_entities").filter("ent_type = 'PERSON'").select(F.col("guid").alias("entity"))
    m = ids_in(table(spark, d, "entity_mentions").filter("label is not null").select("entity", "label"), "entity", people)
    return grouped_by(m.distinct(), "entity", "label").select("entity", F.array_join("values", "|").alias("labels"))


def indexed_mentions(spark: SparkSession, d: str) -> DataFrame:
    """[S19, O7] Mentions indexed by entity and by document: those of three entities, and the second ten of one of them by key."""
    path = scratch(spark, "mentions")
    index(table(spark, d, "entity_mentions").select("mention_key", "docid", "entity"), path, ["entity", "docid"])
    some = ["/m/0000001", "/m/0000002", "/m/0000003"]
    one = find(spark, path, "entity", some).select(F.lit("entities").alias("part"), "mention_key", "docid")
    return one.unionByName(find(spark, path, "entity", some[:1], "mention_key", 10, 10).select(F.lit("page").alias("part"), "mention_key", "docid"))


def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    """[M19] Per pair of names: sentences and their features, a numbered line each, in order. The lines of one pair are never gathered into a row."""
    c = table(spark, d, "corpus_records").filter("sentences is not null").select("entas", "entbs", F.concat_ws("\t", "sentences", "paths", "lex").alias("line")).distinct()
    return ranking.ranked_by_range(c, ["entas", "entbs"], [F.col("line")], "line_no")


def relation_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Labels as words."""
    return table(spark, d, "cells").filter(F.col("relation").startswith("REL$")).select("relation", text.relation_phrase(F.col("relation")).alias("phrase")).distinct()


def relation_sentences(spark: SparkSession, d: str) -> DataFrame:
    """KB relations as sentences between the names of their ends; relation names that the table of phrases knows read by it."""
    known = sorted(text.RELATION_PHRASES)
    r = table(spark, d, "kb_relations").filter("reltype is not null").select("rel_key", "sourceguid", "destguid", F.concat(F.lit("REL$"), "reltype").alias("r"))
    # the invented relation names of the data are mixed with known ones, so that the table of phrases is met
    pick = F.get(F.array(*[F.lit(x) for x in known]), F.pmod("rel_key", F.lit(2 * len(known))).cast("int"))
    return r.select("rel_key", text.relation_sentence(F.col("sourceguid"), F.coalesce(pick, "r"), F.col("destguid")).alias("sentence"))


def parsed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores and labels from joined strings."""
    joined = F.concat_ws(":", F.round("predicted", 3).cast("string"), "relation")
    score, label = text.score_label(F.col("s"))
    return table(spark, d, "cells").filter("predicted is not null and not isnan(predicted)").select("cell_id", joined.alias("s")).select("cell_id", score.alias("score"), label.alias("label"))


def group_terms(spark: SparkSession, d: str) -> DataFrame:
    """[M5] Each label's mean prediction against its share of true cells."""
    c = table(spark, d, "cells").filter(F.col("relation").startswith("REL$") & F.col("predicted").isNotNull() & ~F.isnan("predicted"))
    g = c.groupBy("relation").agg(F.avg("predicted").alias("m"), F.avg((F.col("gold") > 0.5).cast("double")).alias("t"))
    return g.select("relation", F.round(scoring.mean_target_term(F.col("t"), F.col("m")), 6).alias("term"))


def projected_scores(spark: SparkSession, d: str) -> DataFrame:
    """[M4] Scores of tuples with several labels, at most one of which is expected to hold (iterative)."""
    c = table(spark, d, "cells").filter(F.col("relation").startswith("REL$") & F.col("arg2").isNotNull() & F.col("predicted").isNotNull() & ~F.isnan("predicted"))
    s = c.select("cell_id", "arg1", "arg2", ((F.col("predicted") - 0.5) * 8).alias("x"))
    return factor.at_most(s, ["arg1", "arg2"], "x", 1.0).select("cell_id", "multiplier", "projected")


def surface_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Where each mention's label stands nearest to the first mention of its sentence (walks up trees)."""
    docs = latest_per_key(table(spark, d, "parsed_docs").select("filename", "received_at", "sentences"), "filename", F.col("received_at"))
    s = docs.select("filename", F.posexplode("sentences").alias("sent_no", "s")).filter("s.tokens is not null and size(s.mentions) > 1")
    m = s.select("filename", "sent_no", "s", F.col("s.mentions")[0].alias("slot"), F.posexplode("s.mentions").alias("no", "m")).filter("no > 0")
    x = paths.surface_udf("m.label", "s.tokens.word", "s.tokens.ner", "s.deptree.head", "slot.tok_from", "slot.tok_to")
    return m.select("filename", "sent_no", "no", x.alias("x")).select("filename", "sent_no", "no", "x.start", "x.end")


QUERIES = {f.__name__: f for f in (model_fields, feature_union, unseen_relations, mentions_of_people, indexed_mentions, pair_evidence, relation_phrases, relation_sentences, parsed_scores, group_terms, projected_scores, surface_mentions)}

ORACLE = {
    "model_fields": "SELECT rec_id, loaded_at, sentences AS \"text\", labels relation, paths short_text, length(sentences)::INTEGER text_length FROM corpus_records",
    "feature_union": "SELECT DISTINCT CASE WHEN hide THEN 'test' ELSE 'train' END part, relation FROM cells WHERE hide IS NOT NULL",
    "unseen_relations": "SELECT relation FROM cells WHERE hide EXCEPT SELECT relation FROM cells WHERE NOT hide",
    "mentions_of_people": """SELECT entity, array_to_string(list_sort(list(DISTINCT label)), '|') AS labels FROM entity_mentions WHERE label IS NOT NULL AND entity IN (SELECT guid FROM kb_entities WHERE ent_type = 'PERSON') GROUP BY 1""",
    "indexed_mentions": """SELECT 'entities' part, mention_key, docid FROM entity_mentions WHERE entity IN ('/m/0000001', '/m/0000002', '/m/0000003')
        UNION ALL SELECT * FROM (SELECT 'page', mention_key, docid FROM entity_mentions WHERE entity = '/m/0000001' ORDER BY mention_key LIMIT 10 OFFSET 10)""",
    "pair_evidence": """WITH l AS (SELECT DISTINCT entas, entbs, concat_ws(chr(9), sentences, paths, lex) line FROM corpus_records WHERE sentences IS NOT NULL)
        SELECT entas, entbs, line, row_number() OVER (PARTITION BY entas, entbs ORDER BY line)::INTEGER line_no FROM l""",
    "relation_sentences": f"""WITH k AS (SELECT i::INTEGER - 1 i, p FROM (SELECT unnest(range(1, {len(text.RELATION_PHRASES) + 1})) i, unnest([{", ".join("'" + text.RELATION_PHRASES[x].replace("'", "''") + "'" for x in sorted(text.RELATION_PHRASES))}]) p)),
        r AS (SELECT rel_key, sourceguid, destguid, coalesce(p, replace(string_split(reltype, '/')[-1], '_', ' ')) p FROM kb_relations LEFT JOIN k ON i = rel_key % {2 * len(text.RELATION_PHRASES)} WHERE reltype IS NOT NULL)
        SELECT rel_key, sourceguid || CASE WHEN starts_with(p, chr(39) || 's') THEN '' ELSE ' ' END || p || ' ' || destguid sentence FROM r""",
    "relation_phrases": "SELECT DISTINCT relation, replace(string_split(relation, '/')[-1], '_', ' ') phrase FROM cells WHERE starts_with(relation, 'REL$')",
    "parsed_scores": "SELECT cell_id, round(predicted, 3) score, relation AS \"label\" FROM cells WHERE NOT isnan(predicted)",
    "group_terms": """WITH g AS (SELECT relation, avg(predicted) m, avg((gold > 0.5)::INTEGER) t FROM cells WHERE starts_with(relation, 'REL$') AND NOT isnan(predicted) GROUP BY 1)
        SELECT relation, round(CASE WHEN t > 0 THEN t * ln(m / t) ELSE 0 END + CASE WHEN t < 1 THEN (1 - t) * ln((1 - m) / (1 - t)) ELSE 0 END, 6) term FROM g""",
}
