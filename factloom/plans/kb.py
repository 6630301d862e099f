"""Queries of supervision, graph joins, entities and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import cells as C
from ..operators import entities as E
from ..operators import nested, supervision
from ..operators.deliveries import latest_per_key, once_per_key
from ..sources.tables import table


def _triples(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "kb_relations").filter("reltype is not null and reltype <> 'NA'")
    return r.select("rel_key", F.col("sourceguid").alias("source"), F.col("destguid").alias("dest"), F.col("reltype").alias("relation"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cells").filter("arg2 is not null")
    return c.select(F.col("arg1").alias("src"), F.col("arg2").alias("dst"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_entities").filter("ent_name is not null").select("guid", F.col("ent_name").alias("name"))


def distant_labels(spark: SparkSession, d: str) -> DataFrame:
    """[J2] Pairs of the matrix labelled by the KB; NA relations are the pairs known without a label."""
    kb = table(spark, d, "kb_relations")
    known = kb.filter("reltype = 'NA'").select(F.col("sourceguid").alias("src"), F.col("destguid").alias("dst"))
    ents = table(spark, d, "kb_entities").filter("ent_type = 'PERSON'").select(F.col("guid").alias("entity"))
    return supervision.distant_labels(_pairs(spark, d), _triples(spark, d), ents, known)


def missing_triples(spark: SparkSession, d: str) -> DataFrame:
    """[J2, U2] KB pairs that no cell has in either direction."""
    return supervision.unmatched_triples(_pairs(spark, d), _triples(spark, d))


def named_triples(spark: SparkSession, d: str) -> DataFrame:
    """[J3] KB triples with the names of both ends."""
    return supervision.named_ends(_triples(spark, d), _names(spark, d)).select("rel_key", "relation", "source_name", "dest_name")


def unnamed_ends(spark: SparkSession, d: str) -> DataFrame:
    """[J3, J13] Ends that aren't known by a person's name."""
    people = table(spark, d, "kb_entities").filter("ent_type = 'PERSON'").select("guid", F.col("ent_name").alias("name"))
    return supervision.unknown_ends(_triples(spark, d), people)


def relations_of_people(spark: SparkSession, d: str) -> DataFrame:
    """[J13] Relations both of whose ends are people."""
    people = table(spark, d, "kb_entities").filter("ent_type = 'PERSON'")
    return E.linked_relations(_triples(spark, d), people, "source", "dest", "guid")


def entity_relations(spark: SparkSession, d: str) -> DataFrame:
    """[J4, J7] Entities with the relations they are the source of."""
    r = _triples(spark, d).select(F.col("source").alias("guid"), "relation")
    out = supervision.attached(table(spark, d, "kb_entities").select("guid", "ent_name"), r, ["guid"], "relation")
    return out.select("guid", "ent_name", F.array_join("relation_list", ",").alias("relations"))


def type_map(spark: SparkSession, d: str) -> DataFrame:
    """[J5, J6] Types of linked entities sent through a map of spellings."""
    mapping = spark.createDataFrame([("PERSON", "per"), ("person", "per"), ("PER", "per"), ("ORGANIZATION", "org"), ("ORG", "org"), ("organization", "org"), ("LOCATION", "loc"), ("LOC", "loc"), ("location", "loc")], "kind string, target string")
    m = table(spark, d, "entity_mentions").filter("entity is not null")
    return supervision.mapped_types(m, "entity", "ner_tag", mapping).select("entity", F.array_join("types", ",").alias("types"))


def grouped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """[A4] Per pair of names the strongest tag, with each of its features."""
    c = table(spark, d, "corpus_records")
    feats = F.array_compact(F.array(F.concat(F.lit("path#"), "paths"), F.concat(F.lit("lex#"), "lex"), F.concat(F.lit("ner#"), "ners"), F.concat(F.lit("sen#"), "sentences")))
    return supervision.grouped_pairs(c.select(F.col("entas").alias("src"), F.col("entbs").alias("dst"), F.col("labels").alias("tag"), feats.alias("features")), "features")


def predictions_beside_gold(spark: SparkSession, d: str) -> DataFrame:
    """[J23] Scores of label cells in order of their ids beside the KB's relations in order of their keys, row by row."""
    c = table(spark, d, "cells").filter(F.col("relation").startswith("REL$")).select("cell_id", "predicted")
    g = table(spark, d, "kb_relations").select("rel_key", F.col("reltype").alias("gold"), "loaded_at")
    out = supervision.by_position(c, g, [F.col("cell_id")], [F.col("rel_key"), F.col("loaded_at")])
    return out.select(F.col("line_no").cast("long").alias("line_no"), "cell_id", "rel_key", "gold")


def pair_topics(spark: SparkSession, d: str) -> DataFrame:
    """[A5, A6, S21] Sources of each pair of names."""
    return supervision.pair_sets(table(spark, d, "corpus_records"), "entas", "entbs", "source").select("src", "dst", F.array_join("values", ",").alias("topics"))


def two_hop(spark: SparkSession, d: str) -> DataFrame:
    """[J8] Compositions of two relations, the second leg the last of its source."""
    return supervision.two_hops(_triples(spark, d), "rel_key")


def second_order(spark: SparkSession, d: str) -> DataFrame:
    """[J9] Third entities beside pairs of one relation."""
    t = supervision.second_order(_triples(spark, d), "/trade/member/wrote")
    return t.select("a", "b", "c", F.array_join("rels_ac", ",").alias("rels_ac"), F.array_join("rels_cb", ",").alias("rels_cb"))


def label_alignment(spark: SparkSession, d: str) -> DataFrame:
    """[J27] Whether a pair's best-scored label is among its gold labels."""
    gold = supervision.pair_sets(_triples(spark, d), "source", "dest", "relation").select("src", "dst", F.array_join("values", ",").alias("labels"))
    c = table(spark, d, "cells").filter(F.col("relation").startswith("REL$") & F.col("predicted").isNotNull() & ~F.isnan("predicted"))
    best = c.groupBy(F.col("arg1").alias("src"), F.col("arg2").alias("dst")).agg(F.substring(F.max_by("relation", F.struct("predicted", "relation")), 5, 1000).alias("predicted"))
    return supervision.aligned(gold, best)


def last_scores(spark: SparkSession, d: str) -> DataFrame:
    """[S14] Of repeated tuples the last score counts."""
    c = table(spark, d, "cells").filter("predicted is not null and not isnan(predicted)")
    return supervision.last_wins(c, ["relation", "arg1", "arg2"], "predicted", "cell_id")


def _mention_table(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.flatten(latest_per_key(table(spark, d, "parsed_docs"), "filename", F.col("received_at")), ["filename"], "documents")


def same_sentence_pairs(spark: SparkSession, d: str) -> DataFrame:
    """[J10] Ordered pairs of mentions of one sentence."""
    m = _mention_table(spark, d)["sentences.mentions"].select("filename", F.col("sentences_no").alias("sent_no"), F.col("mentions_no").alias("no"), "label", "tok_from", "tok_to")
    p = E.sentence_pairs(m, ["filename", "sent_no"], "tok_from", "tok_to", "label")
    return p.select("filename", "sent_no", "no_1", "no_2", "label_1", "label_2")


def span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """[J11] Mentions whose characters overlap in a document."""
    m = table(spark, d, "entity_mentions").select("mention_key", "docid", "charbegin", "charend")
    return E.overlapping_spans(m, m, "docid", "charbegin", "charend").filter("mention_key < mention_key_o").select("mention_key", F.col("mention_key_o").alias("other"))


def first_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """[J11] For each unlinked mention the first linked one that it overlaps."""
    m = table(spark, d, "entity_mentions").select("mention_key", "docid", "charbegin", "charend", "entity")
    linked = m.filter("entity is not null").withColumnRenamed("mention_key", "linked_key")
    return E.first_overlap(m.filter("entity is null"), linked, "mention_key", "docid", "charbegin", "charend", "linked_key")


def entity_link(spark: SparkSession, d: str) -> DataFrame:
    """[J12, S26] Mentions linked to entities of that very name, others to new ones."""
    m = table(spark, d, "entity_mentions").select("mention_key", "label")
    return E.link_exact(m, table(spark, d, "kb_entities"), "label", "ent_name", "guid").select("mention_key", "linked", "is_new")


def mentions_in_text(spark: SparkSession, d: str) -> DataFrame:
    """[J14] Names of a document's mentions found in its sentences."""
    t = _mention_table(spark, d)["sentences.tokens"]
    s = t.groupBy(F.col("filename").alias("docid"), F.col("sentences_no").alias("sent_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tokens_no", F.coalesce("word", F.lit("")).alias("word")))), lambda x: x["word"]), " ").alias("sent"))
    c = table(spark, d, "entity_mentions").filter("label is not null").select("docid", "label").distinct()
    return E.mentioned_in(s, c, "docid", "sent", "label").select("docid", "sent_no", "label", "how")


def canonical_companies(spark: SparkSession, d: str) -> DataFrame:
    """[J15] Names with a title take the entity name that is a run of their words."""
    m = table(spark, d, "entity_mentions").filter("label is not null").select("label").distinct()
    return E.canonical_by_part(m, table(spark, d, "kb_entities").filter("ent_name is not null"), "label", "ent_name", ["Dr.", "Mr.", "Ms.", "Sen.", "Prof.", "The"])


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """[J21] Best cell of each tuple and the first file that mentions it."""
    c = table(spark, d, "cells").filter("not hide and predicted is not null and not isnan(predicted)")
    m = table(spark, d, "kb_relations").select(F.col("sourceguid").alias("arg1"), F.col("destguid").alias("arg2"), F.explode("mention.filename").alias("f")).filter("f is not null")
    return E.best_evidence(c, m, ["arg1", "arg2"], "predicted", "f")


def mention_coverage(spark: SparkSession, d: str) -> DataFrame:
    """[J25] KB relations whose ends have linked mentions."""
    return E.coverage(_triples(spark, d), table(spark, d, "entity_mentions"), "source", "dest", "entity")


def mention_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """[J25] How far linked mentions can answer gold relations: a stand-in takes every mention marked as gold as the second argument of a relation
    whose first argument is the entity named before it in its document."""
    m = table(spark, d, "entity_mentions").filter("docid is not null").select("mention_key", "docid", "charbegin", "charend", "tokenbegin", "entity", "tacmention")
    gold = m.filter("tacmention and entity is not null").select(F.col("mention_key").alias("gold"), "docid", "charbegin", "charend", F.col("entity").alias("arg1"))
    linked = m.filter("not tacmention and entity is not null").select("mention_key", "docid", "charbegin", "charend", "entity", F.floor(F.col("charbegin") / 200).alias("sentence"))
    feats = linked.filter(F.pmod("mention_key", F.lit(3)) > 0).select("mention_key")
    return E.evaluated_mentions(gold, linked, feats)


def slot_pairs(spark: SparkSession, d: str) -> DataFrame:
    """[J28] Pairs with the split of their entities and the slot that joins them."""
    pairs = _pairs(spark, d).select(F.col("src").alias("arg1"), F.col("dst").alias("arg2")).distinct()
    slots = _triples(spark, d).select(F.col("source").alias("arg1"), F.col("dest").alias("arg2"), F.col("relation").alias("slot"))
    split = table(spark, d, "kb_entities").filter("ent_type is not null").select(F.col("guid").alias("entity"), F.when(F.pmod("ent_key", F.lit(5)) == 0, "test").otherwise("train").alias("split"))
    return E.labelled_pairs(pairs, slots, split)


def slot_misses(spark: SparkSession, d: str) -> DataFrame:
    """[J28] Gold slots that no pair of the matrix matches in either direction."""
    slots = _triples(spark, d).select(F.col("source").alias("arg1"), F.col("dest").alias("arg2"), F.col("relation").alias("slot"))
    return E.unmatched_slots(_pairs(spark, d).select(F.col("src").alias("arg1"), F.col("dst").alias("arg2")), slots)


def mention_texts(spark: SparkSession, d: str) -> DataFrame:
    """[J29] Words of each mention's span."""
    t = _mention_table(spark, d)
    m = t["sentences.mentions"].select("filename", "sentences_no", "mentions_no", "tok_from", "tok_to")
    return E.span_text(m, t["sentences.tokens"], ["filename", "sentences_no"], "tok_from", "tok_to", "tokens_no", "word").select("filename", F.col("sentences_no").alias("sent_no"), F.col("mentions_no").alias("mention_no"), "text")


def ner_spans(spark: SparkSession, d: str) -> DataFrame:
    """Runs of entity tags in sentences."""
    t = _mention_table(spark, d)["sentences.tokens"]
    return E.token_spans(t, ["filename", "sentences_no"], "tokens_no", "ner", "word").select("filename", F.col("sentences_no").alias("sent_no"), "start", "end", "label", "text")


def new_documents(spark: SparkSession, d: str) -> DataFrame:
    """[S27, S25] Documents that mentions ask for and that aren't parsed yet."""
    docs = table(spark, d, "entity_mentions").filter("docid is not null").select(F.col("docid").alias("filename")).distinct()
    kb = table(spark, d, "kb_relations").select(F.explode("mention.filename").alias("filename"))
    return E.new_deliveries(docs, kb, table(spark, d, "parsed_docs"), "filename")


def initial_entities(spark: SparkSession, d: str) -> DataFrame:
    """[S26] Entities of two query sets and of the KB."""
    e = table(spark, d, "kb_entities").select("guid", F.col("ent_name").alias("name"), "ent_key")
    asked = table(spark, d, "entity_mentions").filter("entity is not null").select(F.col("entity").alias("guid"), F.col("label").alias("name"), "mention_key", "tacmention")
    train, dev = asked.filter("tacmention and mention_key % 2 = 0"), asked.filter("tacmention and mention_key % 3 = 0")
    return E.initial_entities(train, dev, e, "guid")


def initial_slots(spark: SparkSession, d: str) -> DataFrame:
    """[S26] KB relations of the entities that queries ask for."""
    return E.initial_slots(_triples(spark, d), initial_entities(spark, d), "source", "relation", "dest")


def ingested_pairs(spark: SparkSession, d: str) -> DataFrame:
    """[S27, F26, J10] Mention pairs of the documents that linked mentions ask for and that weren't there before 2008."""
    docs = latest_per_key(table(spark, d, "parsed_docs").select("filename", "received_at", "sentences"), "filename", F.col("received_at"))
    wanted = table(spark, d, "entity_mentions").filter("entity is not null").select(F.col("docid").alias("filename"))
    stored = docs.filter("year(received_at) < 2008")
    _, pairs = E.ingested(docs, wanted, stored, "filename")
    return pairs.select("filename", F.col("sentences_no").alias("sent_no"), "start_1", "text_1", "label_1", "start_2", "text_2", "label_2")


def word_tag_strings(spark: SparkSession, d: str) -> DataFrame:
    """Word, tag and entity tag of the tokens of each sentence."""
    s = table(spark, d, "parsed_docs").select("filename", "received_at", F.posexplode("sentences").alias("sent_no", "s")).filter("s.tokens is not null")
    return s.select("filename", "received_at", "sent_no", text.word_tags(F.col("s.tokens")).alias("tags"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """[F25, F28, P14] Context of ordered mention pairs fewer than 11 tokens apart, of sentences of fewer than 100 tokens."""
    docs = latest_per_key(table(spark, d, "parsed_docs"), "filename", F.col("received_at"))
    s = docs.select("filename", F.posexplode("sentences").alias("sent_no", "s")).filter("s is not null and size(s.tokens) between 1 and 99")
    a = s.select("filename", "sent_no", "s", F.posexplode("s.mentions").alias("no_1", "m1"))
    p = a.select("filename", "sent_no", "s", "no_1", "m1", F.posexplode("s.mentions").alias("no_2", "m2")).filter("m1.label <> m2.label and m1.tok_to <= m2.tok_from and m2.tok_from - m1.tok_to < 11")
    lex, full, tags = paths.between_context(F.col("s.tokens"), F.col("m1.tok_to"), F.col("m2.tok_from"))
    left, right = paths.neighbour_context(F.col("s.tokens"), F.col("m1.tok_from"), F.col("m2.tok_to"))
    return p.select("filename", "sent_no", "no_1", "no_2", lex.alias("lex"), full.alias("words"), tags.alias("tags"), left.alias("lc"), right.alias("rc"))


def _tree_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ordered mention pairs of a sentence with their heads and the path between them."""
    docs = latest_per_key(table(spark, d, "parsed_docs").select("filename", "received_at", "sentences"), "filename", F.col("received_at"))
    s = docs.select("filename", F.posexplode("sentences").alias("sent_no", "s")).filter("s.deptree.head is not null")
    h = paths.span_head_udf
    a = s.select("filename", "sent_no", "s", F.posexplode("s.mentions").alias("no_1", "m1"))
    p = a.select("filename", "sent_no", "s", "no_1", "m1", F.posexplode("s.mentions").alias("no_2", "m2")).filter("m1.tok_to <= m2.tok_from")
    p = p.withColumns({"h1": h("s.deptree.head", "m1.tok_from", "m1.tok_to"), "h2": h("s.deptree.head", "m2.tok_from", "m2.tok_to")})
    x = paths.path_udf("s.deptree.head", "s.deptree.reltype", "s.tokens.word", "s.tokens.tag", "s.tokens.ner", "h1", "h2")
    return p.withColumn("x", x)


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """[F23, F24, P13] Path between the heads of ordered mention pairs."""
    return _tree_pairs(spark, d).select("filename", "sent_no", "no_1", "no_2", "h1", "h2", "x.path", "x.root", "x.length", "x.junk")


def _features(spark: SparkSession, d: str, linking: bool) -> DataFrame:
    p = _tree_pairs(spark, d).filter("s.tokens is not null and h1 is not null and h2 is not null")
    between = paths.between_context(F.col("s.tokens"), F.col("m1.tok_to"), F.col("m2.tok_from"))
    gap, apart = F.col("m2.tok_from") - F.col("m1.tok_to"), F.abs(F.col("h2") - F.col("h1"))
    ner = lambda h: F.get("s.tokens.ner", F.col(h))
    path = F.col("x.path"), F.col("x.junk"), F.col("x.length")
    if linking:
        f = paths.link_features(*path, gap, (ner("h1"), ner("h2")), between)
    else:
        f = paths.pair_features(*path, gap, apart, (ner("h1"), ner("h2")), between)
    return p.select("filename", "sent_no", "no_1", "no_2", F.explode(f).alias("feature"))


def mention_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of mention pairs for training, one row each."""
    return _features(spark, d, False)


def link_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of mention pairs for linking, one row each."""
    return _features(spark, d, True)


def distant_rows(spark: SparkSession, d: str) -> DataFrame:
    """[J2] The mention rows of KB pairs, labelled by the right open cells; rows of a reversed cell are turned round."""
    kb = table(spark, d, "kb_relations").select("rel_key", F.col("sourceguid").alias("src"), F.col("destguid").alias("dst"), F.explode("mention").alias("m"))
    f = F.array_compact("m.feature")
    kb = kb.select("rel_key", "src", "dst", F.get(F.filter(f, lambda x: x.startswith("path#")), F.lit(0)).alias("path"), F.filter(f, lambda x: ~x.startswith("path#")).alias("features"))
    ents = table(spark, d, "kb_entities").select(F.col("guid").alias("entity"), F.coalesce("ent_type", F.lit("O")).alias("ner"))
    c = table(spark, d, "cells").filter(F.col("relation").startswith("REL$") & F.col("arg2").isNotNull())
    triples = c.filter("not hide and gold > 0.5").select(F.col("arg1").alias("source"), F.col("arg2").alias("dest"), "relation")
    known = c.filter("hide").select(F.col("arg1").alias("src"), F.col("arg2").alias("dst"))
    for end in ("src", "dst"):
        kb = kb.join(ents.withColumnsRenamed({"entity": end, "ner": f"{end}_ner"}), end, "left")
    people = ents.filter("ner = 'PERSON'").select("entity")
    out = supervision.labelled_rows(kb, supervision.distant_labels(kb, triples, people, known))
    return out.select("rel_key", "tag", "src", "dst", "relation", "ner", "path", F.array_join("features", " ").alias("features"))


def coref_clusters(spark: SparkSession, d: str) -> DataFrame:
    """[M24] Clusters of entities joined by one relation, named by their smallest guid."""
    t = _triples(spark, d).filter("relation = '/church/district/born_near'")
    return E.components(t, "source", "dest")


def coref_antecedents(spark: SparkSession, d: str) -> DataFrame:
    """[M24] For each mention the nearest earlier one of its document that has its name, of equal case first."""
    m = table(spark, d, "entity_mentions").filter("docid is not null and label is not null").select("docid", "mention_key", "label")
    return E.nearest_same_name(m, "docid", "mention_key", "label")


def triple_clusters(spark: SparkSession, d: str) -> DataFrame:
    """[M24] Clusters of entities joined by any relation, named by their smallest guid (components of any depth; checked by brute force)."""
    return E.components(_triples(spark, d), "source", "dest")


def mention_clusters(spark: SparkSession, d: str) -> DataFrame:
    """[M24] Clusters of mentions joined by the links to their antecedents, named by their smallest key."""
    return E.components(coref_antecedents(spark, d), "mention_key", "earlier")


def longest_names(spark: SparkSession, d: str) -> DataFrame:
    """The longest name of each linked entity."""
    m = table(spark, d, "entity_mentions").filter("entity is not null and label is not null")
    return E.longest_canonical(m, "entity", "label")


def relation_cells(spark: SparkSession, d: str) -> DataFrame:
    """[S25, P4] Features of KB relations as cells of tuples that the matrix has, frequent ones only."""
    kb = once_per_key(table(spark, d, "kb_relations").select("rel_key", "sourceguid", "destguid", F.col("mention.feature").alias("f")), "rel_key")
    c = kb.select(F.col("sourceguid").alias("arg1"), F.col("destguid").alias("arg2"), F.explode(F.flatten(F.array_compact("f"))).alias("relation")).filter("relation is not null")
    kept = C.frequency_filter(c, 5, 1, ["path#"], below=1 << 30)
    return C.add_to_known(table(spark, d, "cells"), kept).select("relation", "arg1", "arg2").distinct()


QUERIES = {f.__name__: f for f in (
    distant_labels, missing_triples, named_triples, unnamed_ends, relations_of_people, entity_relations, type_map, grouped_pairs, predictions_beside_gold, pair_topics, two_hop, second_order, label_alignment, last_scores,
    same_sentence_pairs, span_overlaps, first_overlaps, entity_link, mentions_in_text, canonical_companies, provenance, mention_coverage, slot_pairs, mention_texts, ner_spans, new_documents,
    initial_entities, initial_slots, ingested_pairs, word_tag_strings, contexts, tree_paths, mention_features, link_features, distant_rows, mention_evaluation, slot_misses, coref_clusters, coref_antecedents, triple_clusters, mention_clusters, longest_names, relation_cells,
)}

_T = "t AS (SELECT rel_key, sourceguid source, destguid dest, reltype relation FROM kb_relations WHERE reltype <> 'NA')"
_P = "p AS (SELECT DISTINCT arg1 src, arg2 dst FROM cells WHERE arg2 IS NOT NULL)"
_D = """d AS (SELECT * FROM parsed_docs QUALIFY row_number() OVER (PARTITION BY filename ORDER BY received_at DESC) = 1),
    s AS (SELECT filename, unnest(range(len(sentences)))::INTEGER sent_no, unnest(sentences) s FROM d),
    tk AS (SELECT filename, sent_no, unnest(range(len(s.tokens)))::INTEGER tok_no, unnest(s.tokens) t FROM s),
    mn AS (SELECT filename, sent_no, unnest(range(len(s.mentions)))::INTEGER no, unnest(s.mentions) m FROM s)"""
_ABBR = r"""CASE WHEN len(regexp_split_to_array(label, '[-\s]')) < 3 OR (len(regexp_split_to_array(label, '[-\s]')) = 3 AND length(regexp_split_to_array(label, '[-\s]')[2]) < 3) THEN NULL
    ELSE array_to_string(list_filter(list_transform(regexp_split_to_array(label, '[-\s]'), lambda x: x[1]), lambda c: regexp_matches(c, '\p{Lu}')), '') END"""

_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"
# trees are walked by recursion: `up` has the ancestors of every token, `hd` the heads of spans, `pt` the paths of pairs of mentions
_TREE = f"""{_D}, st AS MATERIALIZED (SELECT row_number() OVER () sid, * FROM s WHERE s.deptree.head IS NOT NULL),
    tr AS MATERIALIZED (SELECT sid, unnest(range(len(s.deptree.head)))::INTEGER i, unnest(s.deptree.head) h, len(s.deptree.head) n FROM st),
    up AS (SELECT sid, i beg, i tok, 0 d, [i] seen FROM tr UNION ALL SELECT u.sid, u.beg, t.h, u.d + 1, list_append(u.seen, t.h) FROM up u JOIN tr t ON t.sid = u.sid AND t.i = u.tok
        WHERE t.h >= 0 AND t.h < t.n AND NOT list_contains(u.seen, t.h)),
    mm AS (SELECT sid, unnest(range(len(s.mentions)))::INTEGER no, unnest(s.mentions) m FROM st),
    pp AS (SELECT a.sid, a.no no_1, b.no no_2, a.m m1, b.m m2 FROM mm a JOIN mm b ON a.sid = b.sid AND a.m.tok_to <= b.m.tok_from),
    sp AS (SELECT DISTINCT sid, m.tok_from f, m.tok_to t FROM mm WHERE m.tok_from < m.tok_to),
    ol AS (SELECT sp.sid, f, t, u.beg, coalesce(min(u.d) FILTER (u.tok < f OR u.tok >= t) - 1, max(u.d)) d FROM sp JOIN up u ON u.sid = sp.sid AND u.beg >= f AND u.beg < t GROUP BY ALL),
    fi AS (SELECT ol.sid, f, t, max(u.tok) top FROM ol JOIN up u ON u.sid = ol.sid AND u.beg = ol.beg AND u.d = ol.d GROUP BY ALL),
    hd AS (SELECT sp.sid, sp.f, sp.t, greatest(sp.f, fi.top, CASE WHEN sp.t > len(st.s.deptree.head) THEN sp.t - 1 END)::INTEGER h FROM sp JOIN st USING (sid) LEFT JOIN fi USING (sid, f, t)),
    ph AS MATERIALIZED (SELECT pp.*, a.h h1, b.h h2 FROM pp LEFT JOIN hd a ON a.sid = pp.sid AND a.f = m1.tok_from AND a.t = m1.tok_to LEFT JOIN hd b ON b.sid = pp.sid AND b.f = m2.tok_from AND b.t = m2.tok_to),
    hp AS (SELECT DISTINCT sid, h1, h2 FROM ph JOIN st USING (sid) WHERE h1 <> h2 AND st.s.tokens IS NOT NULL),
    ca AS (SELECT hp.sid, h1, h2, arg_min(a.tok, a.d) common, min(a.d) da, arg_min(b.d, a.d) db FROM hp JOIN up a ON a.sid = hp.sid AND a.beg = h1 JOIN up b ON b.sid = hp.sid AND b.beg = h2 AND b.tok = a.tok GROUP BY ALL),
    sx AS (SELECT ca.*, 0 k, u.d o, u.tok FROM ca JOIN up u ON u.sid = ca.sid AND u.beg = h1 AND u.d < da UNION ALL SELECT *, 1, 0, common FROM ca
        UNION ALL SELECT ca.*, 2, -u.d, u.tok FROM ca JOIN up u ON u.sid = ca.sid AND u.beg = h2 AND u.d < db),
    sy AS (SELECT sx.*, coalesce(st.s.tokens[tok + 1].word, '') w, coalesce(st.s.tokens[tok + 1].tag, '') g, coalesce(nullif(st.s.tokens[tok + 1].ner, ''), 'O') e, coalesce(st.s.deptree.reltype[tok + 1], '') l FROM sx JOIN st USING (sid)),
    sz AS (SELECT *, CASE WHEN e <> 'O' THEN e WHEN w IN {_IN(paths.NAME_SUFFIXES)} THEN 'O' ELSE w END r FROM sy),
    pt AS MATERIALIZED (SELECT sid, h1, h2, any_value(da + db + 1)::INTEGER "length", any_value(common) common,
        lower(string_agg(CASE k WHEN 0 THEN CASE WHEN tok = h1 THEN '' ELSE r END || '<-' || l || '<-' WHEN 1 THEN CASE WHEN tok IN (h1, h2) THEN '' ELSE r END ELSE '->' || l || '->' || CASE WHEN tok = h2 THEN '' ELSE r END END, '' ORDER BY k, o)) AS path,
        bool_or(k <> 1 AND (g NOT IN {_IN(paths.FEASIBLE_TAGS)} OR lower(l) IN {_IN(paths.JUNK_LABELS)})) OR bool_or(k = 1 AND lower(w) IN {_IN(paths.JUNK_ROOTS)}) OR count(*) FILTER (g IN {_IN(paths.CONTENT_TAGS)}) < 2
        OR bool_or(w IN ('?', '"', '[')) OR coalesce(max(lower(l)) FILTER (k = 0 AND tok = h1) = 'adv' OR any_value(common) = h1 AND false, false)
        OR coalesce(max(lower(l)) FILTER (k = 0 AND tok = h1) = max(lower(l)) FILTER (k = 2 AND tok = h2) AND max(lower(l)) FILTER (k = 0 AND tok = h1) IN ('name', 'sbj'), false) junk FROM sz GROUP BY sid, h1, h2),
    pf AS MATERIALIZED (SELECT st.filename, st.sent_no, ph.*, pt.path, pt.junk, pt."length", st.s.tokens[pt.common + 1].word root, st.s.tokens k FROM ph JOIN st USING (sid) LEFT JOIN pt USING (sid, h1, h2))"""
_FEATS = f"""{_TREE}, bt AS (SELECT *, k[m1.tok_to + 1 : m2.tok_from] b, m2.tok_from - m1.tok_to gap, k[h1 + 1].ner n1, k[h2 + 1].ner n2 FROM pf WHERE k IS NOT NULL AND h1 IS NOT NULL AND h2 IS NOT NULL),
    bx AS (SELECT *, array_to_string(list_transform(list_filter(b, lambda t: coalesce(t.ner, 'O') = 'O'), lambda t: t.word), ' ') lex, array_to_string(list_transform(b, lambda t: t.word), ' ') words, array_to_string(list_transform(b, lambda t: t.tag), ' ') tags FROM bt)"""
_L = "coalesce(NOT junk AND \"length\" < 10, false)"

_INIT = """q AS (SELECT entity id, label AS name, mention_key % 2 = 0 train, mention_key % 3 = 0 dev FROM entity_mentions WHERE entity IS NOT NULL AND tacmention AND (mention_key % 2 = 0 OR mention_key % 3 = 0)),
    a AS (SELECT id, min(name) AS name, bool_or(train) train, bool_or(dev) dev FROM q GROUP BY 1), ie AS (SELECT * FROM a UNION ALL SELECT guid, ent_name, false, false FROM kb_entities WHERE guid IS NOT NULL AND guid NOT IN (SELECT id FROM a))"""

ORACLE = {
    "initial_entities": f"WITH {_INIT} SELECT * FROM ie",
    "initial_slots": f"WITH {_T}, {_INIT} SELECT DISTINCT source arg1, relation slot, dest arg2, train, dev FROM t JOIN ie ON id = source WHERE train OR dev",
    "ingested_pairs": f"""WITH {_D}, n AS (SELECT filename FROM d WHERE filename IN (SELECT docid FROM entity_mentions WHERE entity IS NOT NULL) AND NOT coalesce(year(received_at) < 2008, false)),
        x AS (SELECT filename, sent_no, tok_no, t.word w, coalesce(t.ner, 'O') n FROM tk WHERE filename IN (FROM n)), y AS (SELECT *, (n IS DISTINCT FROM lag(n) OVER w)::INTEGER c FROM x WINDOW w AS (PARTITION BY filename, sent_no ORDER BY tok_no)),
        r AS (SELECT *, sum(c) OVER (PARTITION BY filename, sent_no ORDER BY tok_no) run FROM y),
        sp AS (SELECT filename, sent_no, min(tok_no)::INTEGER s, (max(tok_no) + 1)::INTEGER e, any_value(n) l, string_agg(coalesce(w, ''), ' ' ORDER BY tok_no) t FROM r WHERE n <> 'O' GROUP BY filename, sent_no, run)
        SELECT a.filename, a.sent_no, a.s start_1, a.t text_1, a.l label_1, b.s start_2, b.t text_2, b.l label_2 FROM sp a JOIN sp b ON a.filename = b.filename AND a.sent_no = b.sent_no AND a.t <> b.t AND a.e <= b.s""",
    "tree_paths": f"WITH RECURSIVE {_TREE} SELECT filename, sent_no, no_1, no_2, h1, h2, path, root, \"length\", junk FROM pf",
    "mention_features": f"""WITH RECURSIVE {_FEATS}, ft AS (SELECT *, {_L} good, gap < 11 AND (lex <> '' OR words <> '') near, coalesce(n1, 'O') a, coalesce(n2, 'O') z FROM bx),
        fl AS (SELECT filename, sent_no, no_1, no_2, unnest(CASE WHEN NOT good AND abs(h2 - h1) > 10 THEN [] ELSE [CASE WHEN good AND path <> '' THEN 'path#' || path END, 'type#' || a || '->' || z, CASE WHEN near AND lex <> '' THEN 'lex#' || lex END,
            CASE WHEN near AND words <> '' THEN 'lex#' || words END, CASE WHEN near AND tags <> '' THEN 'pos#' || tags END, CASE WHEN near THEN 'lex-ner#' || a || '|' || lex || '|' || z END, CASE WHEN near THEN 'pos-ner#' || a || '|' || tags || '|' || z END] END) feature FROM ft)
        SELECT * FROM fl WHERE feature IS NOT NULL AND NOT contains(feature, 'javascript')""",
    "link_features": f"""WITH RECURSIVE {_FEATS}, ft AS (SELECT *, {_L.replace('10', '6')} good FROM bx),
        fl AS (SELECT filename, sent_no, no_1, no_2, unnest([CASE WHEN gap < 20 THEN '->' || lex || ' ' || words END, CASE WHEN good THEN path END, CASE WHEN good THEN coalesce(n1, 'NA') || '->' || coalesce(n2, 'NA') END]) f FROM ft)
        SELECT filename, sent_no, no_1, no_2, f || '/2' feature FROM fl WHERE length(f) > 0 AND NOT contains(f, 'javascript')""",
    "distant_rows": """WITH c AS (SELECT * FROM cells WHERE starts_with(relation, 'REL$') AND arg2 IS NOT NULL), t AS (SELECT DISTINCT arg1, arg2, relation FROM c WHERE NOT hide AND gold > 0.5), n AS (SELECT arg1, arg2 FROM c WHERE hide UNION SELECT arg2, arg1 FROM c WHERE hide),
        m AS (SELECT rel_key, sourceguid src, destguid dst, unnest(mention) x FROM kb_relations), f AS (SELECT rel_key, src, dst, coalesce(list_filter(x.feature, lambda f: f IS NOT NULL), NULL) f FROM m),
        k AS (SELECT rel_key, src, dst, list_filter(f, lambda f: starts_with(f, 'path#'))[1] path, list_filter(f, lambda f: NOT starts_with(f, 'path#')) fs, coalesce(a.ent_type, 'O') sn, coalesce(b.ent_type, 'O') dn FROM f LEFT JOIN kb_entities a ON a.guid = src LEFT JOIN kb_entities b ON b.guid = dst),
        fw AS (SELECT DISTINCT arg1, arg2 FROM t), q AS (SELECT k.*, (src, dst) IN (SELECT (arg1, arg2) FROM fw) fwd, (dst, src) IN (SELECT (arg1, arg2) FROM fw) bwd, (src, dst) IN (SELECT (arg1, arg2) FROM n) kn FROM k)
        SELECT rel_key, 'POSITIVE' tag, src, dst, relation, sn || '->' || dn ner, path, array_to_string(fs, ' ') features FROM q JOIN t ON t.arg1 = src AND t.arg2 = dst
        UNION ALL SELECT rel_key, 'POSITIVE', dst, src, relation, dn || '->' || sn, path || ':INV', array_to_string(list_transform(fs, lambda f: f || ':INV'), ' ') FROM q JOIN t ON t.arg1 = dst AND t.arg2 = src WHERE NOT fwd
        UNION ALL SELECT rel_key, CASE WHEN src IN (SELECT guid FROM kb_entities WHERE ent_type = 'PERSON') AND dst IN (SELECT guid FROM kb_entities WHERE ent_type = 'PERSON') THEN 'NEGATIVE' ELSE 'UNLABELED' END, src, dst, 'REL$NA', sn || '->' || dn, path, array_to_string(fs, ' ')
            FROM q WHERE NOT fwd AND NOT bwd AND NOT kn""",
    "mention_evaluation": """WITH m AS (SELECT * FROM entity_mentions WHERE docid IS NOT NULL AND entity IS NOT NULL AND charbegin IS NOT NULL), g AS (SELECT mention_key gold, docid, charbegin, charend, entity arg1 FROM entity_mentions WHERE docid IS NOT NULL AND entity IS NOT NULL AND tacmention),
        l AS (SELECT mention_key, docid, charbegin, charend, entity, charbegin // 200 sen FROM m WHERE NOT tacmention),
        o AS (SELECT gold, arg1, g.docid, count(l.mention_key) n, arg_min(l.entity, (l.charbegin, l.mention_key)) ent, arg_min(l.sen, (l.charbegin, l.mention_key)) sen FROM g LEFT JOIN l ON l.docid = g.docid AND l.charbegin <= l.charend AND g.charbegin <= g.charend AND l.charbegin <= g.charend AND g.charbegin <= l.charend GROUP BY ALL),
        a AS (SELECT gold, n, o.ent, o.arg1, count(l.mention_key) k, arg_min(l.mention_key, (l.charbegin, l.mention_key)) mk FROM o LEFT JOIN l ON l.docid = o.docid AND l.sen = o.sen AND l.entity = o.arg1 GROUP BY ALL)
        SELECT count(*) n, count(*) FILTER (n = 0) missed_arg2, count(*) FILTER (n > 1) multiple_overlap, count(*) FILTER (n > 0 AND k = 0) missed_arg1, count(*) FILTER (k > 0 AND mk % 3 = 0) no_features, count(*) FILTER (k > 0 AND arg1 = ent) same_entity FROM a""",
    "slot_misses": f"WITH {_T}, {_P} SELECT DISTINCT source arg1, dest arg2, relation slot FROM t WHERE (source, dest) NOT IN (SELECT (src, dst) FROM p) AND (dest, source) NOT IN (SELECT (src, dst) FROM p)",
    "distant_labels": f"""WITH {_T}, {_P}, k AS (SELECT DISTINCT source, dest, relation FROM t), n AS (SELECT sourceguid src, destguid dst FROM kb_relations WHERE reltype = 'NA' UNION SELECT destguid, sourceguid FROM kb_relations WHERE reltype = 'NA'),
        e AS (SELECT guid FROM kb_entities WHERE ent_type = 'PERSON'), r AS (SELECT * FROM p WHERE (src, dst) NOT IN (SELECT (source, dest) FROM k))
        SELECT src, dst, relation, 'POSITIVE' tag, false inverse FROM p JOIN k ON source = src AND dest = dst
        UNION ALL SELECT dst, src, relation, 'POSITIVE', true FROM r JOIN k ON source = dst AND dest = src
        UNION ALL SELECT src, dst, 'REL$NA', CASE WHEN src IN (FROM e) AND dst IN (FROM e) THEN 'NEGATIVE' ELSE 'UNLABELED' END, false FROM r WHERE (dst, src) NOT IN (SELECT (source, dest) FROM k) AND (src, dst) NOT IN (SELECT (src, dst) FROM n)""",
    "missing_triples": f"WITH {_T}, {_P} SELECT DISTINCT source, dest FROM t WHERE (source, dest) NOT IN (SELECT (src, dst) FROM p) AND (dest, source) NOT IN (SELECT (src, dst) FROM p)",
    "named_triples": f"WITH {_T} SELECT rel_key, relation, a.ent_name source_name, b.ent_name dest_name FROM t JOIN kb_entities a ON a.guid = source JOIN kb_entities b ON b.guid = dest WHERE a.ent_name IS NOT NULL AND b.ent_name IS NOT NULL",
    "unnamed_ends": f"WITH {_T} SELECT guid FROM (SELECT source guid FROM t UNION SELECT dest FROM t) WHERE guid NOT IN (SELECT guid FROM kb_entities WHERE ent_type = 'PERSON')",
    "relations_of_people": f"WITH {_T}, e AS (SELECT guid FROM kb_entities WHERE ent_type = 'PERSON') SELECT * FROM t WHERE source IN (FROM e) AND dest IN (FROM e)",
    "entity_relations": f"WITH {_T}, l AS (SELECT source, array_to_string(list_sort(list_distinct(list(relation))), ',') r FROM t GROUP BY 1) SELECT guid, ent_name, coalesce(r, '') relations FROM kb_entities LEFT JOIN l ON source = guid",
    "type_map": """WITH m AS (SELECT entity, CASE WHEN ner_tag IN ('PERSON', 'person', 'PER') THEN 'per' WHEN ner_tag IN ('ORGANIZATION', 'ORG', 'organization') THEN 'org' WHEN ner_tag IN ('LOCATION', 'LOC', 'location') THEN 'loc' END t
        FROM entity_mentions WHERE entity IS NOT NULL) SELECT entity, array_to_string(list_sort(list(DISTINCT t)), ',') "types" FROM m WHERE t IS NOT NULL GROUP BY 1""",
    "grouped_pairs": """WITH g AS (SELECT entas src, entbs dst, upper(trim(labels)) t, paths, lex, ners FROM corpus_records),
        a AS (SELECT src, dst, max(CASE t WHEN 'POSITIVE' THEN 3 WHEN 'NEGATIVE' THEN 2 WHEN 'UNLABELED' THEN 1 ELSE 0 END) p, count(*) n_mentions FROM g GROUP BY 1, 2),
        f AS (SELECT src, dst, 'path#' || paths f FROM g UNION SELECT src, dst, 'lex#' || lex FROM g UNION SELECT src, dst, 'ner#' || ners FROM g),
        l AS (SELECT src, dst, f FROM f WHERE f IS NOT NULL)
        SELECT src, dst, CASE p WHEN 3 THEN 'POSITIVE' WHEN 2 THEN 'NEGATIVE' WHEN 1 THEN 'UNLABELED' END tag, n_mentions, f feature FROM a LEFT JOIN l USING (src, dst)""",
    "predictions_beside_gold": """WITH c AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) line_no FROM cells WHERE starts_with(relation, 'REL$')), g AS (SELECT rel_key, reltype gold, row_number() OVER (ORDER BY rel_key, loaded_at) line_no FROM kb_relations)
        SELECT line_no, cell_id, rel_key, gold FROM c FULL JOIN g USING (line_no)""",
    "pair_topics": "SELECT entas src, entbs dst, array_to_string(list_sort(list(DISTINCT source)), ',') topics FROM corpus_records WHERE source IS NOT NULL GROUP BY 1, 2",
    "two_hop": f"""WITH {_T}, l AS (SELECT source b, arg_max(relation, rel_key) r2, arg_max(dest, rel_key) c FROM t GROUP BY 1), g AS (SELECT source, dest, arg_max(relation, rel_key) direct FROM t GROUP BY 1, 2),
        h AS (SELECT source a, relation r1, b, r2, c FROM t JOIN l ON dest = b)
        SELECT a, r1, b, r2, c, coalesce(f.direct, r.direct) direct, CASE WHEN coalesce(f.direct, r.direct) IS NOT NULL THEN 'POS' END mark FROM h LEFT JOIN g f ON f.source = a AND f.dest = c LEFT JOIN g r ON r.source = c AND r.dest = a""",
    "second_order": f"""WITH {_T}, g AS (SELECT source, dest, array_to_string(list_sort(list(DISTINCT relation)), ',') rels FROM t GROUP BY 1, 2), w AS (SELECT DISTINCT source a, dest b FROM t WHERE relation = '/trade/member/wrote')
        SELECT a, b, x.dest c, x.rels rels_ac, y.rels rels_cb FROM w JOIN g x ON x.source = a JOIN g y ON y.source = x.dest AND y.dest = b""",
    "label_alignment": f"""WITH {_T}, g AS (SELECT source src, dest dst, array_to_string(list_sort(list(DISTINCT relation)), ',') AS labels FROM t GROUP BY 1, 2),
        b AS (SELECT arg1 src, arg2 dst, substr(relation, 5) predicted FROM cells WHERE starts_with(relation, 'REL$') AND NOT isnan(predicted) QUALIFY row_number() OVER (PARTITION BY arg1, arg2 ORDER BY cells.predicted DESC, relation DESC) = 1)
        SELECT src, dst, labels, predicted, coalesce(contains(labels, predicted), false) hit FROM g LEFT JOIN b USING (src, dst)""",
    "last_scores": "SELECT relation, arg1, arg2, arg_max(predicted, cell_id) predicted FROM cells WHERE NOT isnan(predicted) GROUP BY 1, 2, 3",
    "same_sentence_pairs": f"""WITH {_D} SELECT x.filename, x.sent_no, x.no no_1, y.no no_2, x.m.label label_1, y.m.label label_2 FROM mn x JOIN mn y ON x.filename = y.filename AND x.sent_no = y.sent_no
        WHERE x.m.label <> y.m.label AND x.m.tok_to <= y.m.tok_from""",
    "span_overlaps": """SELECT x.mention_key, y.mention_key other FROM entity_mentions x JOIN entity_mentions y ON x.docid = y.docid AND x.mention_key < y.mention_key AND x.charbegin <= y.charend AND y.charbegin <= x.charend
        AND x.charbegin <= x.charend AND y.charbegin <= y.charend""",
    "first_overlaps": """SELECT x.mention_key, arg_min(y.mention_key, (y.charbegin, y.mention_key)) "match" FROM (SELECT * FROM entity_mentions WHERE entity IS NULL) x
        LEFT JOIN (SELECT * FROM entity_mentions WHERE entity IS NOT NULL) y ON x.docid = y.docid AND x.charbegin <= y.charend AND y.charbegin <= x.charend GROUP BY 1""",
    "entity_link": """WITH k AS (SELECT ent_name, min(guid) g FROM kb_entities WHERE ent_name IS NOT NULL GROUP BY 1)
        SELECT mention_key, coalesce(g, 'new:' || md5(label)) linked, g IS NULL AND label IS NOT NULL is_new FROM entity_mentions LEFT JOIN k ON ent_name = label""",
    "mentions_in_text": f"""WITH {_D}, z AS (SELECT filename docid, sent_no, string_agg(coalesce(t.word, ''), ' ' ORDER BY tok_no) sent FROM tk GROUP BY 1, 2), c AS (SELECT DISTINCT docid, label FROM entity_mentions WHERE label <> ''),
        h AS (SELECT docid, sent_no, label, CASE WHEN contains(sent, replace(label, chr(10), ' ')) THEN 'exact' WHEN contains(lower(translate(sent, '-' || chr(10), '  ')), lower(translate(label, '-' || chr(10), '  '))) THEN 'folded'
            WHEN length({_ABBR}) > 1 AND list_contains(string_split(sent, ' '), {_ABBR}) THEN 'short' END how FROM z JOIN c USING (docid)) SELECT * FROM h WHERE how IS NOT NULL""",
    "canonical_companies": """WITH m AS (SELECT DISTINCT label FROM entity_mentions WHERE len(list_intersect(string_split(label, ' '), ['Dr.', 'Mr.', 'Ms.', 'Sen.', 'Prof.', 'The'])) > 0),
        w AS (SELECT DISTINCT label, unnest(string_split(label, ' ')) w FROM m), n AS (SELECT DISTINCT ent_name, string_split(ent_name, ' ')[1] w FROM kb_entities WHERE ent_name <> '')
        SELECT label, arg_max(ent_name, (length(ent_name), ent_name)) canonical FROM w JOIN n USING (w) WHERE contains(' ' || label || ' ', ' ' || ent_name || ' ') GROUP BY 1""",
    "provenance": """WITH b AS (SELECT arg1, arg2, relation, predicted FROM cells WHERE NOT hide AND NOT isnan(predicted) QUALIFY row_number() OVER (PARTITION BY arg1, arg2 ORDER BY predicted DESC, relation DESC) = 1),
        f AS (SELECT sourceguid arg1, destguid arg2, min(x.filename) mention FROM (SELECT sourceguid, destguid, unnest(mention) x FROM kb_relations) WHERE x.filename IS NOT NULL GROUP BY 1, 2)
        SELECT arg1, arg2, relation, predicted, mention FROM b JOIN f USING (arg1, arg2)""",
    "mention_coverage": f"""WITH {_T}, e AS (SELECT DISTINCT entity FROM entity_mentions WHERE entity IS NOT NULL), x AS (SELECT source IN (FROM e) s, dest IN (FROM e) d, source = dest q FROM t)
        SELECT count(*) n, count(*) FILTER (NOT s) missed_arg1, count(*) FILTER (NOT d) missed_arg2, count(*) FILTER (s AND d) covered, count(*) FILTER (q) same_entity FROM x""",
    "slot_pairs": f"""WITH {_T}, {_P}, f AS (SELECT source, dest, min(relation) slot FROM t GROUP BY 1, 2), e AS (SELECT guid, CASE WHEN ent_key % 5 = 0 THEN 'test' ELSE 'train' END split FROM kb_entities WHERE ent_type IS NOT NULL)
        SELECT src arg1, dst arg2, coalesce(a.split, b.split, 'other') split, coalesce(x.slot, y.slot) slot FROM p LEFT JOIN e a ON a.guid = src LEFT JOIN e b ON b.guid = dst
        LEFT JOIN f x ON x.source = src AND x.dest = dst LEFT JOIN f y ON y.source = dst AND y.dest = src""",
    "mention_texts": f"""WITH {_D} SELECT filename, sent_no, no mention_no, string_agg(coalesce(t.word, ''), ' ' ORDER BY tok_no) "text" FROM mn JOIN tk USING (filename, sent_no) WHERE tok_no >= m.tok_from AND tok_no < m.tok_to GROUP BY 1, 2, 3""",
    "ner_spans": f"""WITH {_D}, x AS (SELECT filename, sent_no, tok_no, t.word w, coalesce(t.ner, 'O') n FROM tk), y AS (SELECT *, (n IS DISTINCT FROM lag(n) OVER w)::INTEGER c FROM x WINDOW w AS (PARTITION BY filename, sent_no ORDER BY tok_no)),
        r AS (SELECT *, sum(c) OVER (PARTITION BY filename, sent_no ORDER BY tok_no) run FROM y)
        SELECT filename, sent_no, min(tok_no)::INTEGER AS "start", (max(tok_no) + 1)::INTEGER AS "end", any_value(n) AS label, string_agg(coalesce(w, ''), ' ' ORDER BY tok_no) AS "text" FROM r WHERE n <> 'O' GROUP BY filename, sent_no, run""",
    "new_documents": """SELECT DISTINCT docid filename FROM entity_mentions WHERE docid IN (SELECT x.filename FROM (SELECT unnest(mention) x FROM kb_relations)) AND docid NOT IN (SELECT filename FROM parsed_docs)""",
    "word_tag_strings": """WITH s AS (SELECT filename, received_at, unnest(range(len(sentences)))::INTEGER sent_no, unnest(sentences) s FROM parsed_docs)
        SELECT filename, received_at, sent_no, array_to_string(list_transform(s.tokens, lambda t: coalesce(t.word, '') || '/' || coalesce(t.tag, '') || '/' || coalesce(t.ner, '')), ' ') tags FROM s WHERE s.tokens IS NOT NULL""",
    "contexts": f"""WITH {_D}, x AS (SELECT a.filename, a.sent_no, a.no no_1, b.no no_2, a.m m1, b.m m2, s.s.tokens k FROM mn a JOIN mn b USING (filename, sent_no) JOIN s USING (filename, sent_no)
        WHERE len(s.s.tokens) BETWEEN 1 AND 99 AND a.m.label <> b.m.label AND a.m.tok_to <= b.m.tok_from AND b.m.tok_from - a.m.tok_to < 11),
        c AS (SELECT *, k[m1.tok_to + 1 : m2.tok_from] b, k[greatest(m1.tok_from - 2, 0) + 1 : m1.tok_from] l, k[m2.tok_to + 1 : m2.tok_to + 2] r FROM x)
        SELECT filename, sent_no, no_1, no_2, array_to_string(list_transform(list_filter(b, lambda t: coalesce(t.ner, 'O') = 'O'), lambda t: t.word), ' ') lex, array_to_string(list_transform(b, lambda t: t.word), ' ') words,
        array_to_string(list_transform(b, lambda t: t.tag), ' ') tags, array_to_string(list_transform(list_filter(l, lambda t: coalesce(t.ner, 'O') = 'O'), lambda t: t.word), ' ') lc,
        array_to_string(list_transform(list_filter(r, lambda t: coalesce(t.ner, 'O') = 'O'), lambda t: t.word), ' ') rc FROM c""",
    "coref_clusters": f"""WITH RECURSIVE {_T}, e AS (SELECT source u, dest v FROM t WHERE relation = '/church/district/born_near'), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        r(node, cluster) AS (SELECT u, u FROM b UNION SELECT b.v, r.cluster FROM r JOIN b ON b.u = r.node WHERE r.cluster < b.v) SELECT node, min(cluster) AS "cluster" FROM r GROUP BY 1""",
    "coref_antecedents": """WITH m AS (SELECT docid, mention_key, label FROM entity_mentions WHERE docid IS NOT NULL AND label IS NOT NULL)
        SELECT x.mention_key, arg_max(y.mention_key, (CASE WHEN x.label = y.label THEN 2.0 ELSE 1.0 END, y.mention_key)) earlier FROM m x JOIN m y ON x.docid = y.docid AND y.mention_key < x.mention_key AND lower(x.label) = lower(y.label) GROUP BY 1""",
    "mention_clusters": """WITH m AS (SELECT mention_key, min(mention_key) OVER w "cluster", count(*) OVER w n FROM entity_mentions WHERE docid IS NOT NULL AND label IS NOT NULL WINDOW w AS (PARTITION BY docid, lower(label)))
        SELECT mention_key node, "cluster" FROM m WHERE n > 1""",
    "longest_names": "SELECT entity, arg_max(label, (length(label), label)) canonical FROM entity_mentions WHERE entity IS NOT NULL AND label IS NOT NULL GROUP BY 1",
    "relation_cells": """WITH k AS (SELECT * FROM kb_relations QUALIFY row_number() OVER (PARTITION BY rel_key ORDER BY loaded_at) = 1), m AS (SELECT sourceguid arg1, destguid arg2, unnest(mention) x FROM k),
        c AS (SELECT arg1, arg2, relation FROM (SELECT arg1, arg2, unnest(x.feature) relation FROM m) WHERE relation IS NOT NULL), f AS (SELECT * FROM c WHERE relation IN (SELECT relation FROM c GROUP BY 1 HAVING count(*) >= 5)),
        g AS (SELECT * FROM f QUALIFY count(*) FILTER (starts_with(relation, 'path#')) OVER (PARTITION BY arg1, arg2) >= 1) SELECT DISTINCT relation, arg1, arg2 FROM g WHERE (arg1, arg2) IN (SELECT (arg1, arg2) FROM cells)""",
}
