"""Round trips of the text formats: a table is written in a format to the shared folder by a writer, or line by line, and read by the reader.

The SQL of each query says what must come back from the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts
from ..operators import ranking as R
from ..session import scratch, settled
from ..sources import protobuf, sinks, textfiles, xmlfiles
from ..sources.tables import table


def _tabs(*cols: Column | str) -> Column:
    """One tab line; nulls are empty."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def _flat(c: str) -> Column:
    """Text of one line."""
    return F.translate(c, "\t\r\n", "   ")


def _lines(df: DataFrame, line: Column, *order: str) -> str:
    """Write a line for each row, in the order of the columns named; returns the folder."""
    path = scratch(df.sparkSession, "lines")
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.select(line.alias("value")).write.text(path)
    return path


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_entities").select("ent_key", "guid", _flat("ent_name").alias("ent_name"), "ent_type")


def _label_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").filter(F.col("relation").startswith("REL$") & F.col("arg2").isNotNull() & F.col("predicted").isNotNull() & ~F.isnan("predicted"))


def value_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S2] Entity names, one a line."""
    path = _lines(_names(spark, d).filter("ent_name is not null"), F.concat(F.lit(" "), "ent_name", F.lit(" ")), "ent_key")
    return textfiles.lines(spark, path, through=True).select(F.col("line_no"), F.trim("value").alias("value"))


def stripped_values(spark: SparkSession, d: str) -> DataFrame:
    """[S2] The distinct stripped names, and how many lines hold each."""
    path = _lines(_names(spark, d).filter("ent_name is not null"), F.concat(F.lit(" \t"), "ent_name", F.lit("  ")))
    return textfiles.value_list(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def column_files(spark: SparkSession, d: str) -> DataFrame:
    """[K1, S3] Entities written a file for each column and put together again."""
    path = scratch(spark, "columns")
    sinks.columns(_names(spark, d), path, ["ent_key"])
    return textfiles.zipped(spark, {c: f"{path}/{c}" for c in ("ent_key", "guid", "ent_name", "ent_type")})


def cached_table(spark: SparkSession, d: str) -> DataFrame:
    """[S4] A table that is built once and read afterwards."""
    path = scratch(spark, "cache")
    built = counts.label_counts(table(spark, d, "cells"), "relation")
    textfiles.load_or_build(spark, path, lambda: built)
    return textfiles.load_or_build(spark, path, lambda: built.limit(0))


def embedding_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S5] Embeddings as lines of a word and numbers."""
    e = table(spark, d, "embeddings")
    path = _lines(e, F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")))
    out = textfiles.embeddings(spark, path)
    return out.select("word", F.size("vec").alias("dims"), F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.element_at("vec", -1).cast("double"), 6).alias("last"))


def wide_cell_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S6, S12] Right and wrong cells as tagged lines."""
    c = table(spark, d, "cells").filter("arg2 is not null and gold is not null")
    tag = F.when(F.col("gold") > 0.5, "POSITIVE").otherwise("NEGATIVE")
    return textfiles.wide_cells(spark, _lines(c, _tabs(tag, "arg1", "arg2", "relation"))).select("tag", "arg1", "arg2", "relation")


def compact_cell_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S7] Scored cells as ``a1|a2`` and ``relation@score``."""
    c = _label_cells(spark, d)
    line = _tabs(F.concat_ws("|", "arg1", "arg2"), F.concat("relation", F.lit("@"), F.col("predicted").cast("string")))
    return textfiles.compact_cells(spark, _lines(c, line))


def tuple_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S8] Tuples with their relations and counts, of each of which one cell is hidden."""
    c = table(spark, d, "cells").filter("arg2 is not null").groupBy("arg1", "arg2", "relation").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("arg1", "arg2").agg(F.array_join(F.array_sort(F.collect_list(F.concat("relation", F.lit("#"), F.col("n").cast("string")))), "\t").alias("r"))
    path = _lines(g, F.concat_ws("\t", F.concat("arg1", F.lit("+"), "arg2"), F.concat_ws("|", "arg1", "arg2"), "r"))
    t = textfiles.tuple_file(spark, path, hide=1)
    return t.groupBy("id", "arg1", "arg2").agg(F.count(F.lit(1)).alias("n_relations"), F.sum("count").alias("n"), F.count_if("hidden").alias("n_hidden"))


def first_tuples(spark: SparkSession, d: str) -> DataFrame:
    """[S8] The first thousand tuples of a file."""
    c = table(spark, d, "cells").filter("arg2 is not null")
    path = _lines(c, _tabs(F.col("cell_id").cast("string"), F.concat_ws("|", "arg1", "arg2"), "relation"), "cell_id")
    return textfiles.tuple_file(spark, path, limit=1000).select(F.col("id").cast("bigint").alias("cell_id"), "arg1", "arg2", "relation")


def triple_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S9] KB relations as triples."""
    r = table(spark, d, "kb_relations").filter("reltype is not null and sourceguid is not null and destguid is not null")
    return textfiles.triples(spark, _lines(r, _tabs("sourceguid", "destguid", "reltype")), hidden=True)


def unary_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S11] Relations of one argument as lines."""
    c = table(spark, d, "cells").filter("arg2 is null")
    return textfiles.triples(spark, _lines(c, _tabs("arg1", "relation")), unary=True).select("arg1", "relation", "hidden")


def lookup_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S14] The last type of each entity name, and the distinct types, from lines."""
    e = _names(spark, d).filter("ent_name is not null and ent_type is not null")
    path = _lines(e, _tabs("ent_name", "ent_type"), "ent_key")
    last = textfiles.lookup(spark, path, [0], 1).withColumnRenamed("value", "last_type")
    return last.join(textfiles.multi_lookup(spark, path).select("k0", F.array_join("values", ",").alias("types")), "k0")


def protobuf_relations(spark: SparkSession, d: str) -> DataFrame:
    """[S13] KB relations as messages and back."""
    mention = lambda m: F.struct(m["filename"].alias("filename"), m["sourceid"].alias("sourceId"), m["destid"].alias("destId"), F.array_compact(m["feature"]).alias("feature"), m["sentence"].alias("sentence"))
    kb = table(spark, d, "kb_relations").select("rel_key", F.col("sourceguid").alias("sourceGuid"), F.col("destguid").alias("destGuid"), F.col("reltype").alias("relType"), F.transform("mention", mention).alias("mention"))
    back = protobuf.decoded(protobuf.encoded(kb, protobuf.RELATION, ["rel_key"]), protobuf.RELATION, ["rel_key"])
    feats = F.flatten("mention.feature")
    return back.select("rel_key", F.col("sourceGuid").alias("sourceguid"), F.col("destGuid").alias("destguid"), F.col("relType").alias("reltype"), F.size("mention").alias("n_mentions"), F.array_join(feats, "|").alias("features"))


def query_files(spark: SparkSession, d: str) -> DataFrame:
    """[S17] Entities as a file of slot queries, linked by name again."""
    e = table(spark, d, "kb_entities").filter("ent_type is not null and ent_name is not null").select("guid", F.trim(F.regexp_replace("ent_name", r"\s+", " ")).alias("name"), "ent_type", "ent_key")
    path = scratch(spark, "queries")
    e.select(F.concat(F.lit("Q"), "ent_key").alias("_id"), "name", F.col("ent_type").alias("enttype")).write.format("xml").option("rootTag", "kbpslotfill").option("rowTag", "query").save(path)
    return xmlfiles.slot_queries(spark, path, e).select("query_id", "name", "enttype", "guid")


def slot_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S18] Mentions as an annotation table."""
    m = table(spark, d, "entity_mentions").filter("label is not null and docid is not null").withColumn("label", _flat("label"))
    text = lambda c: F.col(c).cast("string")
    line = _tabs(text("mention_key"), F.coalesce("entity", F.lit("")), F.lit("2"), F.coalesce("ner_tag", F.lit("none")), "docid", text("charbegin"), text("charend"), "label", F.lit("8"), F.lit("9"), F.when(F.col("tacmention"), "1").otherwise("0"))
    # each file of the table begins with its own header line
    path = scratch(spark, "slots")
    m.select(line.alias("sf")).write.option("header", True).option("quote", "").option("sep", "\x01").csv(path)
    return textfiles.slot_annotations(spark, path)


def gold_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S20] Judgements of cells, the last of each fact."""
    c = table(spark, d, "cells").filter("arg2 is not null and gold is not null")
    path = _lines(c, _tabs(F.when(F.col("gold") > 0.5, "1").otherwise("0"), "relation", "arg1", "arg2"), "cell_id")
    return textfiles.gold_annotations(spark, path)


def sentence_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S21] The distinct sentences of each pair, from mention lines."""
    c = table(spark, d, "corpus_records").filter("sentences is not null and entas is not null and entbs is not null")
    path = _lines(c, _tabs(F.coalesce("labels", F.lit("none")), _flat("entas"), _flat("entbs"), F.lit("path#x"), _flat("sentences")))
    return textfiles.mention_sentences(spark, path).select("src", "dst", F.size("sentences").alias("n"), F.get("sentences", F.lit(0)).alias("first"))


def rank_lines(spark: SparkSession, d: str) -> DataFrame:
    """[K3, K4, S22] A ranked list, written and read with its places."""
    path = scratch(spark, "ranked")
    c = _label_cells(spark, d).filter("gold is not null").select("predicted", "arg1", "arg2", F.when(F.col("gold") > 0.5, "1").otherwise("0").alias("gold"), F.concat_ws(" ", "relation", F.col("cell_id").cast("string")).alias("fact"))
    sinks.ranked(c, path, "predicted", ["arg1", "arg2", "gold", "fact"])
    return textfiles.rank_file(spark, path).select("line_no", F.round("score", 9).alias("score"), "arg1", "arg2", "gold", "predicted")


def matrix_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S23] Embeddings as a dense matrix of numbers."""
    e = table(spark, d, "embeddings")
    path = _lines(e, F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "), "vec_id")
    return textfiles.dense_matrix(spark, path).select("i", "j", F.round(F.col("value").cast("float").cast("double"), 6).alias("value"))


def cooccurrence_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S24] Entities beside their relations, as headers with the counts below them."""
    c = table(spark, d, "cells").groupBy("arg1", "relation").agg(F.count(F.lit(1)).alias("n"))
    head = c.select("arg1").distinct().select("arg1", F.lit("").alias("relation"), F.col("arg1").alias("line"))
    body = c.select("arg1", "relation", F.concat(F.col("n").cast("string"), F.lit("\t"), "relation").alias("line"))
    return textfiles.cooccurrence_file(spark, _lines(head.unionByName(body), F.col("line"), "arg1", "relation"))


def slot_filler_lines(spark: SparkSession, d: str) -> DataFrame:
    """[K5] KB relations as numbered slot fillers of each entity, read again."""
    path = scratch(spark, "fillers")
    kb = table(spark, d, "kb_relations").filter("reltype is not null and sourceguid is not null and destguid is not null").select("sourceguid", "reltype", "destguid", F.lit("doc").alias("doc"), (F.col("rel_key") % 100).alias("score"))
    sinks.tac(kb, path, "sourceguid", "reltype", "destguid", "doc", "score")
    f = F.split("value", "\t")
    return spark.read.text(path).select(*[F.get(f, F.lit(i)).alias(c) for i, c in ((1, "query"), (2, "slot"), (3, "filler"), (5, "score"))], F.get(f, F.lit(0)).cast("int").alias("no"))


def metric_files(spark: SparkSession, d: str) -> DataFrame:
    """[K6] Measures of the labels as a CSV file, read again."""
    path = scratch(spark, "metrics")
    c = table(spark, d, "corpus_records").select(F.upper(F.trim("labels")).alias("truth"), F.when(F.pmod("rec_id", F.lit(7)) == 0, F.lit("NEGATIVE")).otherwise(F.upper(F.trim("labels"))).alias("predicted"))
    sinks.metrics(R.class_metrics(c.filter("truth <> ''"), "truth", "predicted"), path)
    out = spark.read.option("header", True).schema("cls string, actual bigint, predicted bigint, correct bigint, precision double, recall double, f1 double").csv(path)
    return out.select("cls", "actual", "predicted", "correct", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def list_files(spark: SparkSession, d: str) -> DataFrame:
    """[K7] Labels, patterns and tuples as lists of their own, read again."""
    path = scratch(spark, "lists")
    c = table(spark, d, "cells")
    lists = {"labels": c.filter(F.col("relation").startswith("REL$")).select("relation"), "patterns": c.filter(F.col("relation").startswith("path#")).select("relation"), "tuples": c.filter("arg2 is not null").select("arg1", "arg2")}
    sinks.distinct_lists(lists, path)
    out = None
    for name, df in lists.items():
        one = spark.read.option("sep", "\t").schema(", ".join(f"{x} string" for x in df.columns)).csv(f"{path}/{name}").select(F.lit(name).alias("list"), F.concat_ws("|", *df.columns).alias("entry"))
        out = one if out is None else out.unionByName(one)
    return out


def dictionary_files(spark: SparkSession, d: str) -> DataFrame:
    """[K8] Ids of rows and features of the matrix, written and read."""
    path = scratch(spark, "dictionaries")
    c = table(spark, d, "cells")
    sinks.dictionaries({"features": counts.dictionary(c, "relation"), "rows": counts.dictionary(c, "arg1")}, path)
    read = lambda name, col: spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("part"), F.col(col).alias("entry"), "id")
    return read("features", "relation").unionByName(read("rows", "arg1"))


def mention_blocks(spark: SparkSession, d: str) -> DataFrame:
    """[K9] Pairs of KB relations with their mentions as blocks of lines; per kind of line and its first field how many there are."""
    path = scratch(spark, "blocks")
    kb = table(spark, d, "kb_relations").filter("reltype is not null")
    feats = F.transform(F.filter("mention", lambda m: m["filename"].isNotNull()), lambda m: F.concat_ws(" ", m["filename"], F.array_join(F.array_compact(m["feature"]), " ")))
    sinks.miml(kb.select(F.col("sourceguid").alias("src"), F.col("destguid").alias("dst"), F.col("reltype").alias("labels"), F.coalesce(feats, F.array().cast("array<string>")).alias("mentions")), path)
    f = F.split("value", "\t")
    return textfiles.lines(spark, path).select(F.get(f, F.lit(0)).alias("kind"), F.split(F.get(f, F.lit(1)), " ")[0].alias("what")).groupBy("kind", "what").agg(F.count(F.lit(1)).alias("n"))


def relation_folders(spark: SparkSession, d: str) -> DataFrame:
    """[K13] A ranked list split by relation, one of them read again by its folder alone."""
    path = scratch(spark, "by-relation")
    c = _label_cells(spark, d).select("cell_id", "predicted", F.coalesce(F.regexp_extract("relation", r"^REL\$/([a-z]+)", 1), F.lit("")).alias("field"))
    sinks.by_relation(c, path, "field")
    return spark.read.parquet(path).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("predicted"), 6).alias("best"))


def typed_mention_rows(spark: SparkSession, d: str) -> DataFrame:
    """[K14] Mention pairs of KB relations one of whose ends is a person, a row for each feature."""
    path = scratch(spark, "pairs")
    kind = table(spark, d, "kb_entities").select("guid", "ent_type")
    kb = table(spark, d, "kb_relations").select("rel_key", "sourceguid", "destguid", F.explode("mention").alias("m")).select("rel_key", "sourceguid", "destguid", F.col("m.filename").alias("doc"), F.array_compact("m.feature").alias("features"))
    for end, name in (("sourceguid", "label_1"), ("destguid", "label_2")):
        kb = kb.join(kind.withColumnsRenamed({"guid": end, "ent_type": name}), end, "left")
    sinks.relation_mentions(kb, path, "doc", ["PERSON"])
    return spark.read.parquet(path).select("rel_key", "doc", "feature")


def debug_tables(spark: SparkSession, d: str) -> DataFrame:
    """[K10, K15] A debug table with a line in the log."""
    path = scratch(spark, "debug")
    sinks.dump(table(spark, d, "cells").groupBy("hide").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("relation").alias("n_relations")), path, "cells")
    return spark.read.parquet(path)


def encoded_lines(spark: SparkSession, d: str) -> DataFrame:
    """[S6] Lines of another encoding, read by the numbers of their places."""
    e = _names(spark, d).filter("ent_name is not null").select("ent_key", F.decode(F.encode("ent_name", "UTF-8"), "ISO-8859-1").alias("name"))
    rows = settled(e, "names")
    return textfiles.lines(spark, _lines(rows, F.decode(F.encode("name", "ISO-8859-1"), "UTF-8"), "ent_key"), "ISO-8859-1", through=True).select("line_no", F.decode(F.encode("value", "ISO-8859-1"), "UTF-8").alias("name"))


QUERIES = {f.__name__: f for f in (
    value_lines, stripped_values, column_files, cached_table, embedding_lines, wide_cell_lines, compact_cell_lines, tuple_lines, first_tuples, triple_lines, unary_lines, lookup_lines, protobuf_relations, query_files, slot_lines,
    gold_lines, sentence_lines, rank_lines, matrix_lines, cooccurrence_lines, slot_filler_lines, metric_files, list_files, dictionary_files, mention_blocks, relation_folders, typed_mention_rows, debug_tables, encoded_lines,
)}

_E = r"e AS (SELECT ent_key, guid, translate(ent_name, chr(9) || chr(10) || chr(13), '   ') ent_name, ent_type FROM kb_entities)"
_LC = "lc AS (SELECT * FROM cells WHERE starts_with(relation, 'REL$') AND arg2 IS NOT NULL AND NOT isnan(predicted))"

ORACLE = {
    "value_lines": f"WITH {_E} SELECT row_number() OVER (ORDER BY ent_key) line_no, trim(ent_name) AS \"value\" FROM e WHERE ent_name IS NOT NULL",
    "stripped_values": f"WITH {_E} SELECT trim(ent_name) AS \"value\", count(*) n FROM e WHERE ent_name IS NOT NULL GROUP BY 1",
    "column_files": f"WITH {_E} SELECT row_number() OVER (ORDER BY ent_key) line_no, ent_key::VARCHAR ent_key, coalesce(guid, '') guid, coalesce(ent_name, '') ent_name, coalesce(ent_type, '') ent_type FROM e",
    "cached_table": "SELECT relation, count(*) n FROM cells GROUP BY 1",
    "embedding_lines": "SELECT 'w' || vec_id word, len(embedding)::INTEGER dims, round(embedding[1]::DOUBLE, 6) AS \"first\", round(embedding[-1]::DOUBLE, 6) AS \"last\" FROM embeddings",
    "wide_cell_lines": "SELECT CASE WHEN gold > 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END tag, arg1, arg2, relation FROM cells WHERE arg2 IS NOT NULL AND gold IS NOT NULL",
    "compact_cell_lines": f"WITH {_LC} SELECT arg1, arg2, relation, predicted AS \"value\" FROM lc",
    "tuple_lines": "SELECT arg1 || '+' || arg2 id, arg1, arg2, count(DISTINCT relation) n_relations, count(*) n, 1::BIGINT n_hidden FROM cells WHERE arg2 IS NOT NULL GROUP BY ALL",
    "first_tuples": "SELECT cell_id, arg1, arg2, relation FROM cells WHERE arg2 IS NOT NULL ORDER BY cell_id LIMIT 1000",
    "triple_lines": "SELECT sourceguid arg1, destguid arg2, reltype relation, true hidden FROM kb_relations WHERE reltype IS NOT NULL AND sourceguid IS NOT NULL AND destguid IS NOT NULL",
    "unary_lines": "SELECT arg1, relation, false hidden FROM cells WHERE arg2 IS NULL",
    "lookup_lines": f"WITH {_E} SELECT ent_name k0, arg_max(ent_type, ent_key) last_type, array_to_string(list_sort(list(DISTINCT ent_type)), ',') types FROM e WHERE ent_name IS NOT NULL AND ent_type IS NOT NULL GROUP BY 1",
    "protobuf_relations": """WITH k AS (SELECT rel_key, sourceguid, destguid, reltype, coalesce(mention, []) m FROM kb_relations)
        SELECT rel_key, sourceguid, destguid, reltype, len(m)::INTEGER n_mentions, array_to_string(list_filter(flatten(list_transform(m, lambda x: coalesce(x.feature, []))), lambda f: f IS NOT NULL), '|') features FROM k""",
    "query_files": r"""WITH e AS (SELECT ent_key, guid, ent_type, trim(regexp_replace(ent_name, '\s+', ' ', 'g')) AS name FROM kb_entities WHERE ent_type IS NOT NULL AND ent_name IS NOT NULL), g AS (SELECT name, min(guid) guid FROM e GROUP BY 1)
        SELECT 'Q' || ent_key query_id, name, ent_type enttype, g.guid FROM e JOIN g USING (name)""",
    "slot_lines": r"""SELECT coalesce(entity, '') slot_id, coalesce(ner_tag, 'none') AS "label", docid doc, charbegin AS "begin", charend AS "end", translate(label, chr(9) || chr(10) || chr(13), '   ') phrase, coalesce(tacmention, false) state
        FROM entity_mentions WHERE label IS NOT NULL AND docid IS NOT NULL""",
    "gold_lines": "SELECT relation AS \"label\", arg1, arg2, arg_max(gold > 0.5, cell_id) correct FROM cells WHERE arg2 IS NOT NULL AND gold IS NOT NULL GROUP BY 1, 2, 3",
    "sentence_lines": r"""WITH c AS (SELECT DISTINCT translate(entas, chr(9) || chr(10) || chr(13), '   ') src, translate(entbs, chr(9) || chr(10) || chr(13), '   ') dst, translate(sentences, chr(9) || chr(10) || chr(13), '   ') s FROM corpus_records
            WHERE sentences IS NOT NULL AND entas IS NOT NULL AND entbs IS NOT NULL)
        SELECT src, dst, count(*)::INTEGER n, min(s) AS "first" FROM c GROUP BY 1, 2""",
    "rank_lines": f"""WITH {_LC}, f AS (SELECT predicted p, arg1, arg2, CASE WHEN gold > 0.5 THEN '1' ELSE '0' END gold, relation || ' ' || cell_id fact FROM lc WHERE gold IS NOT NULL)
        SELECT row_number() OVER (ORDER BY p DESC, arg1, arg2, gold, fact) line_no, round(p, 9) score, arg1, arg2, gold, fact predicted FROM f""",
    "matrix_lines": "WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 i, embedding e FROM embeddings) SELECT i, unnest(range(len(e)))::INTEGER j, round(unnest(e)::DOUBLE, 6) AS \"value\" FROM e",
    "cooccurrence_lines": "SELECT arg1 target, relation source, count(*) n FROM cells GROUP BY 1, 2",
    "slot_filler_lines": """WITH k AS (SELECT sourceguid q, reltype slot, destguid filler, rel_key % 100 score FROM kb_relations WHERE reltype IS NOT NULL AND sourceguid IS NOT NULL AND destguid IS NOT NULL)
        SELECT q AS query, slot, filler, score::VARCHAR score, row_number() OVER (PARTITION BY q ORDER BY concat_ws(chr(9), q, slot, filler, 'doc', score::VARCHAR))::INTEGER no FROM k""",
    "metric_files": """WITH c AS (SELECT upper(trim(labels)) t, CASE WHEN rec_id % 7 = 0 THEN 'NEGATIVE' ELSE upper(trim(labels)) END p FROM corpus_records WHERE upper(trim(labels)) <> ''),
        l AS (SELECT t cls, 1 a, 0 p, (t = p)::INTEGER c FROM c UNION ALL SELECT p, 0, 1, 0 FROM c), g AS (SELECT cls, sum(a)::BIGINT actual, sum(p)::BIGINT predicted, sum(c)::BIGINT correct FROM l WHERE cls IS NOT NULL GROUP BY 1)
        SELECT cls, actual, predicted, correct, round(coalesce(correct / nullif(predicted, 0), 0), 6) AS "precision", round(coalesce(correct / nullif(actual, 0), 0), 6) recall FROM g""",
    "list_files": """SELECT DISTINCT 'labels' AS list, relation entry FROM cells WHERE starts_with(relation, 'REL$') UNION ALL SELECT DISTINCT 'patterns', relation FROM cells WHERE starts_with(relation, 'path#')
        UNION ALL SELECT DISTINCT 'tuples', arg1 || '|' || arg2 FROM cells WHERE arg2 IS NOT NULL""",
    "dictionary_files": """SELECT 'features' part, relation entry, row_number() OVER (ORDER BY relation) - 1 id FROM (SELECT DISTINCT relation FROM cells WHERE relation IS NOT NULL)
        UNION ALL SELECT 'rows', arg1, row_number() OVER (ORDER BY arg1) - 1 FROM (SELECT DISTINCT arg1 FROM cells WHERE arg1 IS NOT NULL)""",
    "mention_blocks": """WITH k AS (SELECT * FROM kb_relations WHERE reltype IS NOT NULL), m AS (SELECT unnest(mention) m FROM k)
        SELECT 'RELATION' kind, sourceguid what, count(*) n FROM k GROUP BY 1, 2 UNION ALL SELECT 'MENTION', m.filename, count(*) FROM m WHERE m.filename IS NOT NULL GROUP BY 1, 2""",
    "relation_folders": rf"WITH {_LC} SELECT regexp_extract(relation, '^REL\$/([a-z]+)', 1) field, count(*) n, round(max(predicted), 6) best FROM lc GROUP BY 1",
    "typed_mention_rows": """WITH p AS (SELECT guid FROM kb_entities WHERE ent_type = 'PERSON'), m AS (SELECT rel_key, sourceguid, destguid, unnest(mention) m FROM kb_relations), f AS (SELECT rel_key, m.filename doc, unnest(m.feature) feature FROM m WHERE sourceguid IN (FROM p) OR destguid IN (FROM p))
        SELECT * FROM f WHERE feature IS NOT NULL""",
    "debug_tables": "SELECT hide, count(*) n, count(DISTINCT relation) n_relations FROM cells GROUP BY 1",
    "encoded_lines": f"WITH {_E} SELECT row_number() OVER (ORDER BY ent_key) line_no, ent_name AS name FROM e WHERE ent_name IS NOT NULL",
}
