"""Queries of the skew and nesting operators (problems 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, skew
from ..operators.deliveries import latest_per_key
from ..sources.tables import table

_FIELDS = (("labels", "corpus_records", "labels"), ("reltype", "kb_relations", "reltype"))


def _tasks(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of labels and reltype that hold at least 5 % of all rows of their table."""
    out = None
    for field, name, key in _FIELDS:
        one = skew.dominant_keys(table(spark, d, name), key, 0.05, _tasks(spark)).select(F.lit(field).alias("field"), F.col(key).alias("key_text"))
        out = one if out is None else out.unionByName(one)
    return out


def p3_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Per label: rows, longest sentence and first and last load, without one task holding a label."""
    df = table(spark, d, "corpus_records")
    aggs = {"n": (F.lit(1), "count"), "longest": (F.length("sentences"), "max"), "first_loaded": (F.col("loaded_at"), "min"), "last_loaded": (F.col("loaded_at"), "max")}
    return skew.balanced_aggregate(df, "labels", aggs, _tasks(spark))


def p3_typed_relations(spark: SparkSession, d: str) -> DataFrame:
    """Each KB relation with the size and the rank-free share of its reltype: a join on a key that few values dominate."""
    rel = table(spark, d, "kb_relations").select("rel_key", "reltype", "loaded_at")
    per = skew.balanced_aggregate(rel, "reltype", {"n_type": (F.lit(1), "count")}, _tasks(spark))
    return skew.balanced_join(rel, per, "reltype", _tasks(spark)).select("rel_key", "reltype", "loaded_at", "n_type")


def _latest_docs(spark: SparkSession, d: str, *paths: str) -> DataFrame:
    """The document deliveries received last, of which only the fields that ``paths`` name are read."""
    need = nested.pruned(table(spark, d, "parsed_docs").schema, ["filename", "received_at", *paths])
    return table(spark, d, "parsed_docs", need).select("filename", "received_at", "sentences")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Tokens inside mentions, with their heads. Only what is asked for travels to where deliveries meet: sizes, places and heads."""
    read = _latest_docs(spark, d, "sentences.tokens.tag", "sentences.mentions.id", "sentences.mentions.tok_from", "sentences.mentions.tok_to", "sentences.deptree.head")
    parts = read.withColumn("sentences", nested.sentence_parts(F.col("sentences")))
    return nested.mention_tokens(latest_per_key(parts, "filename", F.col("received_at")), "filename")


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The token table."""
    docs = latest_per_key(_latest_docs(spark, d, "sentences.tokens"), "filename", F.col("received_at"))
    t = nested.flatten(docs, ["filename"], "documents")["sentences.tokens"]
    return t.select("filename", F.col("sentences_no").alias("sent_no"), F.col("tokens_no").alias("tok_no"), "word", "tag", "ner")


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence table: sizes of its lists and the root of its tree."""
    docs = latest_per_key(table(spark, d, "parsed_docs").select("filename", "received_at", "sentences"), "filename", F.col("received_at"))
    t = nested.flatten(docs, ["filename"], "documents")["sentences"]
    return t.select("filename", F.col("sentences_no").alias("sent_no"), "tokens_size", "mentions_size", "deptree_root", "deptree_head_size", "deptree_reltype_size")


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of two shapes under one inferred schema: those of odd months lack the trees and have their mention ids as text. For each flat
    table its rows and how many have a mention id or a root."""
    docs = table(spark, d, "parsed_docs").select("filename", "received_at", "sentences")
    odd = F.coalesce(F.month("received_at") % 2 == 1, F.lit(False))
    mention = lambda m: F.struct(m["id"].cast("string").alias("id"), m["label"].alias("label"))
    one = lambda s: F.struct(s["tokens"].alias("tokens"), F.transform(s["mentions"], mention).alias("mentions"))
    old = docs.filter(odd).withColumn("sentences", F.transform("sentences", lambda s: F.when(s.isNotNull(), one(s))))
    tables = nested.flatten(nested.merged([old, docs.filter(~odd)]), ["filename", "received_at"], "documents")
    filled = {"sentences": "deptree_root", "sentences.mentions": "id"}
    out = None
    for path in ("documents", "sentences", "sentences.tokens", "sentences.mentions", "sentences.deptree.head"):
        n = F.count(filled[path]) if path in filled else F.lit(0).cast("bigint")
        one = tables[path].agg(F.count(F.lit(1)).alias("n"), n.alias("n_filled")).select(F.lit(path).alias("path"), "n", "n_filled")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (p3_found, p3_per_key, p3_typed_relations, p4_found, p4_tokens, p4_sentences, p4_merged)}

_LATEST = """WITH d AS (SELECT * FROM parsed_docs QUALIFY row_number() OVER (PARTITION BY filename ORDER BY received_at DESC NULLS LAST) = 1),
s AS (SELECT filename, unnest(range(len(sentences)))::INTEGER sent_no, unnest(sentences) s FROM d)"""

ORACLE = {
    "p3_found": """SELECT 'labels' field, labels key_text FROM corpus_records WHERE labels IS NOT NULL GROUP BY labels HAVING count(*) >= 0.05 * (SELECT count(*) FROM corpus_records)
        UNION ALL SELECT 'reltype', reltype FROM kb_relations WHERE reltype IS NOT NULL GROUP BY reltype HAVING count(*) >= 0.05 * (SELECT count(*) FROM kb_relations)""",
    "p3_per_key": "SELECT labels, count(*) n, max(length(sentences))::INTEGER longest, min(loaded_at) first_loaded, max(loaded_at) last_loaded FROM corpus_records GROUP BY labels",
    "p3_typed_relations": "SELECT rel_key, reltype, loaded_at, n_type FROM kb_relations JOIN (SELECT reltype, count(*) n_type FROM kb_relations GROUP BY 1) USING (reltype)",
    "p4_found": f"""{_LATEST}, m AS (SELECT filename, sent_no, s, unnest(s.mentions) m FROM s),
        t AS (SELECT filename, sent_no, m.id mention_id, s, unnest(range(greatest(m.tok_from, 0), least(m.tok_to, len(s.tokens))))::INTEGER tok_no FROM m WHERE s.tokens IS NOT NULL)
        SELECT filename, sent_no, mention_id, tok_no, coalesce(s.deptree.head[tok_no + 1], -1) head_no FROM t""",
    "p4_tokens": f"""{_LATEST}, t AS (SELECT filename, sent_no, unnest(range(len(s.tokens)))::INTEGER tok_no, unnest(s.tokens) t FROM s)
        SELECT filename, sent_no, tok_no, t.word word, t.tag tag, t.ner ner FROM t""",
    "p4_sentences": f"""{_LATEST} SELECT filename, sent_no, len(s.tokens)::INTEGER tokens_size, len(s.mentions)::INTEGER mentions_size, s.deptree.root deptree_root,
        len(s.deptree.head)::INTEGER deptree_head_size, len(s.deptree.reltype)::INTEGER deptree_reltype_size FROM s""",
    "p4_merged": """WITH d AS (SELECT coalesce(month(received_at) % 2 = 1, false) odd, sentences FROM parsed_docs), s AS (SELECT odd, unnest(sentences) s FROM d),
        m AS (SELECT unnest(s.mentions) m FROM s)
        SELECT 'documents' AS path, count(*) n, 0::BIGINT n_filled FROM d UNION ALL SELECT 'sentences', count(*), count(s.deptree.root) FILTER (NOT odd) FROM s
        UNION ALL SELECT 'sentences.tokens', coalesce(sum(len(s.tokens)), 0)::BIGINT, 0 FROM s UNION ALL SELECT 'sentences.mentions', count(*), count(m.id) FROM m
        UNION ALL SELECT 'sentences.deptree.head', coalesce(sum(len(s.deptree.head)) FILTER (NOT odd), 0)::BIGINT, 0 FROM s""",
}
