"""Queries of text preparation, vocabularies, attribute counts, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import counts, ranking, sampling
from ..sources import textfiles
from ..sources.tables import table


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_records")


def _three_way() -> Column:
    return F.upper(F.trim("labels"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """[A1] Records of each label."""
    return counts.label_counts(_corpus(spark, d), "labels")


def filter_positive(spark: SparkSession, d: str) -> DataFrame:
    """[P2] Positive and negative records."""
    df = _corpus(spark, d).select("rec_id", "loaded_at", _three_way().alias("label"))
    return sampling.keep_labels(df, "label", unlabeled=False, negative=True)


def balanced_labels(spark: SparkSession, d: str) -> DataFrame:
    """[P2, R2] As many positive as negative records, unlabelled ones whole."""
    df = _corpus(spark, d).select("rec_id", _three_way().alias("label")).distinct()
    return sampling.balanced(df, "label", "POSITIVE", "NEGATIVE", sampling.linear_draw(F.col("rec_id"), 3, 1_000_003), "rec_id")


def class_sample(spark: SparkSession, d: str) -> DataFrame:
    """[R1, R2] Twenty records of each source."""
    df = _corpus(spark, d).select("rec_id", "source").distinct()
    return sampling.sample_per_class(df, "source", 20, sampling.linear_draw(F.col("rec_id"), 5, 1_000_003), "rec_id")


def _masked() -> Column:
    return text.stem(text.mask_entities(F.col("sentences"), F.col("entas"), F.col("entbs")))


def stemmed_text(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with masked names, stemmed."""
    return _corpus(spark, d).select("rec_id", "loaded_at", text.mask_entities(F.col("sentences"), F.col("entas"), F.col("entbs")).alias("masked"), _masked().alias("stemmed"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """[A2, F3] Token counts of the prepared sentences."""
    return counts.token_counts(_corpus(spark, d).select(_masked().alias("s")), text.tokens(F.col("s")))


def _vocab(spark: SparkSession, d: str, size: int = 10_000) -> DataFrame:
    return counts.vocabulary(token_counts(spark, d), size)


def vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    """[A2] Vocabulary of 10 000 ids."""
    return _vocab(spark, d)


def vectorized(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the sentences, padded to 40, with lengths, weights and decoded again."""
    vocab = [(r.token, r.id) for r in _vocab(spark, d).select("token", "id").collect()]  # 10 000 entries, the vocabulary's bound
    words = [w for w, _ in sorted(vocab, key=lambda p: p[1])]
    df = _corpus(spark, d).filter("sentences is not null").select("rec_id", "loaded_at", text.tokens(_masked()).alias("t"))
    df = df.select("rec_id", "loaded_at", text.vectorizer(vocab, eos=True)("t").alias("ids"))
    p = text.pad(F.col("ids"), 40)
    return df.select("rec_id", "loaded_at", F.size("ids").alias("n_ids"), F.array_join(p, " ").alias("padded"), F.aggregate(text.weights(p), F.lit(0.0), lambda s, x: s + x).alias("weight"), text.decoder(words)("ids").alias("decoded"))


def relation_vocab(spark: SparkSession, d: str) -> DataFrame:
    """[A3] Relations by frequency, `_unk` first."""
    n = counts.label_counts(_corpus(spark, d).filter("relations is not null"), "relations").withColumnRenamed("relations", "token")
    return counts.vocabulary(n, 100, ["_unk"])


def spans_between(spark: SparkSession, d: str) -> DataFrame:
    """[F8] Text between the names."""
    return _corpus(spark, d).select("rec_id", "loaded_at", text.between_names(F.col("sentences"), F.col("entas"), F.col("entbs")).alias("between"))


def one_hot_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits as one-hot arrays."""
    y = F.when(F.col("split_name") == "train", 0).when(F.col("split_name") == "validation", 1).when(F.col("split_name") == "test", 2)
    return _corpus(spark, d).select("rec_id", "loaded_at", F.array_join(text.one_hot(y, 3), "").alias("hot"))


def dumped_records(spark: SparkSession, d: str) -> DataFrame:
    """[S1, F13] Corpus lines found in documents: fields by prefix."""
    lines = table(spark, d, "documents").filter(F.contains("text", F.lit("\tpath#"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return textfiles.corpus_records(lines, ["doc_id", "line_no"]).select("doc_id", "line_no", "label", "ent_a", "ent_b", "path", "sentence", "ner")


def cleaned_lex(spark: SparkSession, d: str) -> DataFrame:
    """Context words without stop words, and as features."""
    lex = text.clean_lex(F.col("lex"))
    feats = F.array_join(F.array_compact(F.array(F.concat(F.lit("path#"), "paths"), F.concat(F.lit("l:"), "lc"), F.concat(F.lit("r:"), "rc"))), " ")
    return _corpus(spark, d).select("rec_id", "loaded_at", lex.alias("lex"), feats.alias("features"))


def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """Abbreviations of entity names."""
    return table(spark, d, "kb_entities").filter("ent_name is not null").select("ent_key", text.abbreviation(F.col("ent_name")).alias("abbr"))


def bracketed(spark: SparkSession, d: str) -> DataFrame:
    """The first name in brackets."""
    return _corpus(spark, d).filter("sentences is not null").select("rec_id", "loaded_at", text.bracketed(F.col("sentences"), F.col("entas")).alias("s"))


def keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    """[P12, F32] Documents that hold a keyword, line breaks as blanks."""
    t = text.one_line(F.col("text"))
    hit = F.contains(t, F.lit("accord in")) | F.contains(t, F.lit("the senate"))
    return table(spark, d, "documents").filter(hit).select("doc_id")


def gated_documents(spark: SparkSession, d: str) -> DataFrame:
    """[P11, S15] Documents of 2000 to 2007 by their path; very long ones without a post left out, posts cut after their first."""
    df = table(spark, d, "documents").select("doc_id", "filename", "text")
    return textfiles.trimmed_documents(df.filter(F.col("filename").rlike("/200[0-7]/")), "text", 1500).select("doc_id", F.length("text").alias("n"))


def document_regions(spark: SparkSession, d: str) -> DataFrame:
    """[S16] Headline, paragraph and post regions of marked-up documents, cut at empty lines."""
    return textfiles.regions(table(spark, d, "documents"), "doc_id", "text")


def entity_attributes(spark: SparkSession, d: str) -> DataFrame:
    """[A7, A8, O3, P10] The attributes each first argument holds most."""
    c = table(spark, d, "cells").filter(~text.noisy_attribute(F.col("relation")))
    return counts.top_attributes(c, "arg1", "relation", 20, 1, 5)


def frequent_features(spark: SparkSession, d: str) -> DataFrame:
    """[A8] Cells of attributes that occur more than 50 times."""
    return counts.frequent_attributes(table(spark, d, "cells").select("cell_id", "relation"), "relation", 50)


def idf_types(spark: SparkSession, d: str) -> DataFrame:
    """[A9] Features of more than 20 and fewer than 8 in 10 of the KB relations."""
    kb = table(spark, d, "kb_relations").select("rel_key", F.explode_outer(F.flatten(F.array_compact("mention.feature"))).alias("f"))
    return counts.informative_types(kb, "rel_key", "f", 20, 0.8)


def relation_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """[A20, F33] Ids of relations."""
    return counts.dictionary(table(spark, d, "cells"), "relation")


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """[A20] Features of KB pairs with cut-offs on both sides."""
    kb = table(spark, d, "kb_relations").select(F.concat_ws("|", "sourceguid", "destguid").alias("pair"), F.explode(F.flatten(F.array_compact("mention.feature"))).alias("f"))
    return counts.feature_matrix(kb, "pair", "f", 5, 3)


def record_label_sets(spark: SparkSession, d: str) -> DataFrame:
    """[A25] Path features of each KB relation as one string."""
    kb = table(spark, d, "kb_relations").select("rel_key", "loaded_at", F.array_compact(F.array_distinct(F.flatten(F.array_compact("mention.feature")))).alias("f"))
    return counts.label_sets(kb.select(F.struct("rel_key", "loaded_at").alias("row"), "f"), "row", "f", "path#").select("row.rel_key", "row.loaded_at", "labels")


def seq_split(spark: SparkSession, d: str) -> DataFrame:
    """[O11, O12] The last 100 documents for test, the 50 before them for validation."""
    return sampling.split_by_counts(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 100)


def page_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """[O7] The third page of twenty documents."""
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").offset(40).limit(20)


def one_per_entity(spark: SparkSession, d: str) -> DataFrame:
    """[R6] At most one cell of each first argument, then of each second."""
    c = table(spark, d, "cells").filter("arg2 is not null").select("cell_id", "arg1", "arg2")
    return sampling.one_per(c, ["arg1", "arg2"], sampling.linear_draw(F.col("cell_id"), 7, 1_000_003), "cell_id").select("cell_id")


def embed_join(spark: SparkSession, d: str) -> DataFrame:
    """[J1, A23] Document ids with the embeddings that there are, and the mean deviation used for the others."""
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    ids = table(spark, d, "documents").select("doc_id")
    sd = sampling.mean_deviation(emb, "embedding").select(F.round("sd", 6).alias("sd"))
    known = ids.join(emb, "doc_id", "left").select("doc_id", F.col("embedding").isNotNull().alias("known"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))
    return known.crossJoin(F.broadcast(sd))


def filled_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """[R7] Every document with a vector, drawn where none is given (not in SQL: draws)."""
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return sampling.filled_embeddings(table(spark, d, "documents").select("doc_id"), emb, "doc_id", "embedding")


def filled_sizes(spark: SparkSession, d: str) -> DataFrame:
    """[R7] The filled vectors: which are given, how long they are, and the first number of the given ones."""
    f = filled_embeddings(spark, d)
    return f.select("doc_id", "known", F.size("embedding").alias("dims"), F.when(F.col("known"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6)).alias("first"))


def negative_features(spark: SparkSession, d: str) -> DataFrame:
    """[R4, A20] How many negative features each KB pair gets, and how many of them it has itself (none). Which ones is drawn."""
    kb = table(spark, d, "kb_relations").select(F.concat_ws("|", "sourceguid", "destguid").alias("pair"), F.explode(F.flatten(F.array_compact("mention.feature"))).alias("f"))
    neg = sampling.negative_pool(kb, "pair", "f")
    have = kb.filter("f is not null").distinct().withColumn("_h", F.lit(1))
    return neg.join(have, ["pair", "f"], "left").groupBy("pair").agg(F.countDistinct("f").alias("n"), F.count("_h").alias("n_own"))


def seq_split_first(spark: SparkSession, d: str) -> DataFrame:
    """[O12] The first 50 documents for validation, the 100 behind them for test."""
    docs = table(spark, d, "documents").select("doc_id")
    return sampling.split_by_counts(docs, "doc_id", 50, 100, last=False, size=docs.count())


def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """[R1, R5] Batch of each record in an epoch's order."""
    df = _corpus(spark, d).select("rec_id").distinct().withColumn("draw", sampling.linear_draw(F.col("rec_id"), 11, 1_000_003))
    return ranking.global_ranks(df, [F.col("draw"), F.col("rec_id")]).select("rec_id", F.floor((F.col("rnk") - 1) / 100).alias("batch"))


def rendered_paths(spark: SparkSession, d: str) -> DataFrame:
    """Dependency paths as phrases (checked against hand-made fixtures; not in SQL)."""
    p = _corpus(spark, d).select("rec_id", "loaded_at", "paths", "entas", "entbs")
    return p.select("rec_id", "loaded_at", paths.render_udf("paths", "entas", "entbs").alias("phrase"))


QUERIES = {f.__name__: f for f in (
    label_counts, filter_positive, balanced_labels, class_sample, stemmed_text, token_counts, vocab_topk, vectorized, relation_vocab, spans_between, one_hot_splits, dumped_records, cleaned_lex,
    abbreviations, bracketed, keyword_documents, gated_documents, document_regions, entity_attributes, frequent_features, idf_types, relation_dictionary, feature_matrix, record_label_sets,
    seq_split, page_of_documents, one_per_entity, embed_join, filled_embeddings, filled_sizes, negative_features, seq_split_first, epoch_order, rendered_paths,
)}

_MASK = "replace(replace(sentences, entas, '_enta'), entbs, '_entb')"
_STEM = rf"lower(regexp_replace({_MASK}, '\d', '0', 'g'))"
_TOK = rf"list_filter(regexp_split_to_array({_STEM}, '\s+'), lambda x: x <> '')"
_COUNTS = f"WITH t AS (SELECT token, count(*) n FROM (SELECT unnest({_TOK}) token FROM corpus_records) GROUP BY 1)"
_VOCAB = f"""{_COUNTS}, v AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 3)::INTEGER id, n FROM t WHERE token NOT IN ('_pad', '_unk', '_go', '_eos') QUALIFY id < 10000),
    vocab AS (SELECT * FROM v UNION ALL SELECT * FROM (VALUES ('_pad', 0, 0), ('_unk', 1, 0), ('_go', 2, 0), ('_eos', 3, 0)) s(token, id, n))"""
_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"
_BAR = "chr(10)"

ORACLE = {
    "label_counts": "SELECT labels, count(*) n FROM corpus_records GROUP BY 1",
    "filter_positive": "SELECT rec_id, loaded_at, upper(trim(labels)) AS label FROM corpus_records WHERE upper(trim(labels)) IN ('POSITIVE', 'NEGATIVE')",
    "balanced_labels": """WITH r AS (SELECT DISTINCT rec_id, upper(trim(labels)) AS label FROM corpus_records), n AS (SELECT label, count(*) c FROM r WHERE label IN ('POSITIVE', 'NEGATIVE') GROUP BY 1),
        k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (rec_id * 7919 + 3 * 104729) % 1000003, rec_id) i FROM r)
        SELECT rec_id, label FROM k WHERE label IS NULL OR label NOT IN ('POSITIVE', 'NEGATIVE') AND label IS NOT NULL OR i <= (SELECT min(c) FROM n)""".replace("label IS NULL OR ", ""),
    "class_sample": "SELECT rec_id, source FROM (SELECT DISTINCT rec_id, source FROM corpus_records) QUALIFY row_number() OVER (PARTITION BY source ORDER BY (rec_id * 7919 + 5 * 104729) % 1000003, rec_id) <= 20",
    "stemmed_text": f"SELECT rec_id, loaded_at, {_MASK} masked, {_STEM} stemmed FROM corpus_records",
    "token_counts": f"{_COUNTS} SELECT * FROM t",
    "vocab_topk": f"{_VOCAB} SELECT token, id, n FROM vocab",
    "vectorized": f"""{_VOCAB}, m AS MATERIALIZED (SELECT map(list(token), list(id)) ids, map(list(id), list(token)) words FROM vocab),
        x AS (SELECT rec_id, loaded_at, words, list_append(list_transform({_TOK}, lambda w: coalesce(ids[w], 1)), 3) l FROM corpus_records, m WHERE sentences IS NOT NULL),
        p AS (SELECT *, list_concat(l, list_resize([]::INTEGER[], greatest(0, 40 - len(l)), 0)) q FROM x)
        SELECT rec_id, loaded_at, len(l)::INTEGER n_ids, array_to_string(q, ' ') padded, len(list_filter(q, lambda i: i <> 0))::DOUBLE weight, array_to_string(list_transform(l, lambda i: words[i]), ' ') decoded FROM p""",
    "relation_vocab": """SELECT relations AS token, row_number() OVER (ORDER BY n DESC, relations)::INTEGER id, n FROM (SELECT relations, count(*) n FROM corpus_records WHERE relations IS NOT NULL GROUP BY 1) QUALIFY id < 100
        UNION ALL SELECT '_unk', 0, 0""",
    "spans_between": """WITH p AS (SELECT *, instr(sentences, entas) s, instr(sentences, entbs) e FROM corpus_records)
        SELECT rec_id, loaded_at, CASE WHEN s > 0 AND e > 0 AND e - 2 - s - length(entas) >= 0 THEN substr(sentences, s + length(entas) + 1, e - 2 - s - length(entas)) END "between" FROM p""",
    "one_hot_splits": "SELECT rec_id, loaded_at, CASE split_name WHEN 'train' THEN '100' WHEN 'validation' THEN '010' WHEN 'test' THEN '001' ELSE '000' END hot FROM corpus_records",
    "dumped_records": r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER line_no, unnest(string_split(text, chr(10))) v FROM documents WHERE contains(text, chr(9) || 'path#')),
        f AS (SELECT doc_id, line_no, string_split(v, chr(9)) f FROM l WHERE NOT starts_with(v, '#Document') AND len(string_split(v, chr(9))) >= 3)
        SELECT doc_id, line_no, f[1] AS label, f[2] ent_a, f[3] ent_b, substr(list_filter(f, lambda x: starts_with(x, 'path#'))[1], 6) path, substr(list_filter(f, lambda x: starts_with(x, 'sen#'))[1], 5) sentence,
            substr(list_filter(f, lambda x: starts_with(x, 'ner#'))[1], 5) ner FROM f""",
    "cleaned_lex": f"""SELECT rec_id, loaded_at, array_to_string(list_filter(string_split(lex, ' '), lambda w: length(w) > 1 AND lower(w) NOT IN {_STOP}), ' ') lex,
        concat_ws(' ', 'path#' || paths, 'l:' || lc, 'r:' || rc) features FROM corpus_records""",
    "abbreviations": r"""WITH w AS (SELECT ent_key, regexp_split_to_array(ent_name, '[-\s]') w FROM kb_entities WHERE ent_name IS NOT NULL)
        SELECT ent_key, CASE WHEN len(w) < 3 OR (len(w) = 3 AND length(w[2]) < 3) THEN '#None#' ELSE array_to_string(list_filter(list_transform(w, lambda x: x[1]), lambda c: regexp_matches(c, '\p{Lu}')), '') END abbr FROM w""",
    "bracketed": """SELECT rec_id, loaded_at, CASE WHEN contains(sentences, entas) THEN replace(sentences, entas, '[' || entas || ']') WHEN contains(sentences, upper(entas)) THEN replace(sentences, upper(entas), '[' || upper(entas) || ']')
        WHEN contains(sentences, lower(entas)) THEN replace(sentences, lower(entas), '[' || lower(entas) || ']') ELSE sentences END s FROM corpus_records WHERE sentences IS NOT NULL""",
    "keyword_documents": "SELECT doc_id FROM documents WHERE contains(replace(text, chr(10), ' '), 'accord in') OR contains(replace(text, chr(10), ' '), 'the senate')",
    "gated_documents": """SELECT doc_id, length(CASE WHEN length(text) > 1500 THEN substr(text, 1, instr(text, '</POST>') + 6) ELSE text END)::INTEGER n FROM documents
        WHERE regexp_matches(filename, '/200[0-7]/') AND (length(text) <= 1500 OR text IS NULL OR contains(text, '<POST>') AND contains(text, '</POST>'))""",
    "document_regions": r"""WITH r AS (SELECT doc_id, k kind, unnest(range(len(regexp_extract_all(text, '(?s)<' || k || '>(.*?)</' || k || '>', 1))))::INTEGER region_no, unnest(regexp_extract_all(text, '(?s)<' || k || '>(.*?)</' || k || '>', 1)) t
            FROM documents, (VALUES ('HEADLINE'), ('P'), ('POST'), ('TURN')) s(k)),
        b AS (SELECT doc_id, kind, region_no, unnest(range(len(regexp_split_to_array(t, '\n\n+'))))::INTEGER block_no, trim(unnest(regexp_split_to_array(t, '\n\n+')), chr(10) || chr(9) || chr(13) || ' ') AS block FROM r)
        SELECT * FROM b WHERE block <> ''""",
    "entity_attributes": """WITH c AS (SELECT * FROM cells WHERE NOT (starts_with(relation, 'sen#') OR contains(relation, 'say') OR contains(relation, '-be-') OR ends_with(relation, '-be'))),
        l AS (SELECT arg1, relation, count(*) n_local FROM c GROUP BY 1, 2), g AS (SELECT relation, sum(n_local)::BIGINT n_global FROM l GROUP BY 1 HAVING sum(n_local) > 20)
        SELECT arg1, relation, n_local, n_global, (row_number() OVER (PARTITION BY arg1 ORDER BY n_local DESC, relation))::INTEGER rnk FROM l JOIN g USING (relation) WHERE n_local > 1 QUALIFY rnk <= 5""",
    "frequent_features": "SELECT cell_id, relation FROM cells WHERE relation IN (SELECT relation FROM cells GROUP BY 1 HAVING count(*) > 50)",
    "idf_types": """WITH m AS (SELECT rel_key, unnest(mention) x FROM kb_relations), f AS (SELECT rel_key, unnest(x.feature) f FROM m)
        SELECT f, count(DISTINCT rel_key) n FROM f WHERE f IS NOT NULL GROUP BY 1 HAVING n > 20 AND n < 0.8 * (SELECT count(DISTINCT rel_key) FROM kb_relations)""",
    "relation_dictionary": "SELECT relation, row_number() OVER (ORDER BY relation) - 1 id FROM (SELECT DISTINCT relation FROM cells WHERE relation IS NOT NULL)",
    "feature_matrix": """WITH m AS (SELECT sourceguid || '|' || destguid pair, unnest(mention) x FROM kb_relations), f AS (SELECT DISTINCT pair, f FROM (SELECT pair, unnest(x.feature) f FROM m) WHERE f IS NOT NULL),
        c AS (SELECT * FROM f WHERE f IN (SELECT f FROM f GROUP BY 1 HAVING count(*) >= 5)) SELECT pair, f FROM c WHERE pair IN (SELECT pair FROM c GROUP BY 1 HAVING count(*) >= 3)""",
    "record_label_sets": """SELECT rel_key, loaded_at, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(mention, lambda m: coalesce(m.feature, []))), lambda f: starts_with(f, 'path#')))), ',') AS labels FROM kb_relations""",
    "seq_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= 100 THEN 'test' WHEN row_number() OVER (ORDER BY doc_id DESC) <= 150 THEN 'validation' ELSE 'train' END part FROM documents",
    "filled_sizes": """WITH n AS (SELECT max(len(embedding)) dims FROM embeddings)
        SELECT doc_id, vec_id IS NOT NULL known, coalesce(len(embedding), dims)::INTEGER dims, round(embedding[1]::DOUBLE, 6) AS "first" FROM documents LEFT JOIN embeddings ON vec_id = doc_id, n""",
    "negative_features": """WITH m AS (SELECT sourceguid || '|' || destguid pair, unnest(mention) x FROM kb_relations), f AS (SELECT DISTINCT pair, f FROM (SELECT pair, unnest(x.feature) f FROM m) WHERE f IS NOT NULL),
        n AS (SELECT count(DISTINCT f) n FROM f), p AS (SELECT pair, count(*) s FROM f GROUP BY 1), h AS (SELECT pair, n - s most, list_transform(range(0, 30), lambda k: (5 * s) // (1 << k::INTEGER)) hs FROM p, n)
        SELECT pair, list_filter(hs, lambda x: x <= most)[1]::BIGINT n, 0::BIGINT n_own FROM h WHERE list_filter(hs, lambda x: x <= most)[1] > 0""",
    "seq_split_first": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 50 THEN 'validation' WHEN row_number() OVER (ORDER BY doc_id) <= 150 THEN 'test' ELSE 'train' END part FROM documents",
    "page_of_documents": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40",
    "one_per_entity": """WITH a AS (SELECT cell_id, arg2 FROM cells WHERE arg2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arg1 ORDER BY (cell_id * 7919 + 7 * 104729) % 1000003, cell_id) = 1)
        SELECT cell_id FROM a QUALIFY row_number() OVER (PARTITION BY arg2 ORDER BY (cell_id * 7919 + 7 * 104729) % 1000003, cell_id) = 1""",
    "embed_join": """WITH e AS (SELECT unnest(range(len(embedding))) i, unnest(embedding)::DOUBLE x FROM embeddings), s AS (SELECT round(avg(s), 6) sd FROM (SELECT i, stddev_samp(x) s FROM e GROUP BY 1))
        SELECT doc_id, embedding IS NOT NULL known, round(embedding[1]::DOUBLE, 6) AS "first", sd FROM documents LEFT JOIN embeddings ON vec_id = doc_id, s""",
    "epoch_order": "SELECT rec_id, (row_number() OVER (ORDER BY (rec_id * 7919 + 11 * 104729) % 1000003, rec_id) - 1) // 100 batch FROM (SELECT DISTINCT rec_id FROM corpus_records)",
}
