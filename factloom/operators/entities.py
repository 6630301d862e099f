"""Mentions and entities: spans, pairs within sentences, linking, provenance, clusters."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, settled
from .nested import flatten

#: Width of the cells that spans are dealt to before they are compared.
SPAN_CELL = 64


def overlapping_spans(a: DataFrame, b: DataFrame, doc: str, begin: str, end: str, cell: int = SPAN_CELL) -> DataFrame:
    """[J11] (a.*, b.* with suffix _o) of spans of one document that overlap; touching ends count, both ends belong to the span.

    Each span goes to the cells it covers, and spans are compared within a cell only, so a document with very many mentions is
    spread over tasks; the first common cell reports the pair. Null documents or ends match nothing.
    """
    cells = lambda df: df.filter(F.col(begin) <= F.col(end)).withColumn("_c", F.explode(F.sequence(F.floor(F.col(begin) / cell), F.floor(F.col(end) / cell))))
    left = cells(a)
    right = cells(b).withColumnsRenamed({c: f"{c}_o" for c in b.columns} | {"_c": "_co"})
    cond = (F.col(doc) == F.col(f"{doc}_o")) & (F.col("_c") == F.col("_co")) & (F.col(begin) <= F.col(f"{end}_o")) & (F.col(f"{begin}_o") <= F.col(end))
    first = F.floor(F.greatest(begin, f"{begin}_o") / cell)
    return left.join(right, cond).filter(F.col("_c") == first).drop("_c", "_co")


def first_overlap(a: DataFrame, b: DataFrame, key: str, doc: str, begin: str, end: str, pick: str) -> DataFrame:
    """[J11] For each span of ``a`` the overlapping one of ``b`` that begins first (ties by ``pick``), or null."""
    hits = overlapping_spans(a.select(key, doc, begin, end), b.select(pick, doc, begin, end) if pick != key else b.select(key, doc, begin, end), doc, begin, end)
    best = hits.groupBy(key).agg(F.min_by(f"{pick}_o", F.struct(f"{begin}_o", f"{pick}_o")).alias("match"))
    return a.select(key).join(best, key, "left")


def sentence_pairs(mentions: DataFrame, keys: list[str], start: str, end: str, label: str, ordered: bool = True) -> DataFrame:
    """[J10] Pairs of mentions of one sentence with different labels, columns with suffixes _1 and _2; ``ordered``: the first ends before
    the second begins."""
    l = mentions.withColumnsRenamed({c: f"{c}_1" for c in mentions.columns if c not in keys})
    r = mentions.withColumnsRenamed({c: f"{c}_2" for c in mentions.columns if c not in keys})
    out = l.join(r, keys).filter(F.col(f"{label}_1") != F.col(f"{label}_2"))
    return out.filter(F.col(f"{end}_1") <= F.col(f"{start}_2")) if ordered else out


def link_exact(mentions: DataFrame, entities: DataFrame, phrase: str, name: str, guid: str) -> DataFrame:
    """[J12] Mentions with ``linked``: the smallest guid of the entity of that very name, else a new id made of the phrase, the same for
    every mention of it. ``is_new`` tells them apart. Null phrases stay unlinked."""
    known = entities.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias(phrase)).agg(F.min(guid).alias("_g"))
    out = mentions.join(known, phrase, "left")
    new = F.concat(F.lit("new:"), F.md5(phrase))
    return out.withColumns({"linked": F.coalesce("_g", new), "is_new": F.col("_g").isNull() & F.col(phrase).isNotNull()}).drop("_g")


def linked_relations(rel: DataFrame, entities: DataFrame, source: str, dest: str, guid: str) -> DataFrame:
    """[J13] Relations both of whose ends are entities."""
    ids = entities.select(F.col(guid).alias("_g")).distinct()
    return rel.join(ids, rel[source] == ids["_g"], "left_semi").join(ids, rel[dest] == ids["_g"], "left_semi")


def mentioned_in(sentences: DataFrame, candidates: DataFrame, doc: str, text: str, phrase: str) -> DataFrame:
    """[J14] Candidate phrases found in the sentences of their document, with how: exact, folded (lower case, hyphens as blanks) or short
    (the initials of a phrase of three or more words). The first way that fits counts. An equi-join on the document."""
    from ..functions.text import abbreviation

    loose = lambda c: F.lower(F.translate(c, "-\n", "  "))
    j = sentences.join(candidates.filter(F.length(phrase) > 0), doc)
    short = abbreviation(F.col(phrase))
    how = (
        F.when(F.contains(text, F.translate(phrase, "\n", " ")), "exact")
        .when(F.contains(loose(F.col(text)), loose(F.col(phrase))), "folded")
        .when((short != "#None#") & (F.length(short) > 1) & F.array_contains(F.split(text, " "), short), "short")
    )
    return j.withColumn("how", how).filter("how is not null")


def canonical_by_part(phrases: DataFrame, canonicals: DataFrame, phrase: str, canonical: str, marks: list[str]) -> DataFrame:
    """[J15] Phrases with a title or company mark take the longest canonical name that is a run of their words (ties by name).

    Phrase and canonical meet on the canonical's first word, so no phrase is compared with all names.
    """
    marked = phrases.filter(F.exists(F.split(phrase, " "), lambda w: w.isin(marks)))
    words = marked.withColumn("_w", F.explode(F.array_distinct(F.split(phrase, " "))))
    names = canonicals.select(canonical).filter(F.length(canonical) > 0).distinct().withColumn("_w", F.get(F.split(canonical, " "), F.lit(0)))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    hit = words.join(names, "_w").filter(F.contains(padded(F.col(phrase)), padded(F.col(canonical))))
    return hit.groupBy(phrase).agg(F.max_by(canonical, F.struct(F.length(canonical), F.col(canonical))).alias("canonical"))


def best_evidence(cells: DataFrame, mentions: DataFrame, keys: list[str], score: str, mention: str) -> DataFrame:
    """[J21] For each tuple its best observed cell's relation and score, with the first mention of the tuple."""
    best = cells.groupBy(*keys).agg(F.max_by(F.struct("relation", score), F.struct(F.col(score), F.col("relation"))).alias("_b"))
    first = mentions.groupBy(*keys).agg(F.min(mention).alias("mention"))
    return best.join(first, keys).select(*keys, "_b.relation", F.col("_b").getField(score).alias(score), "mention")


def coverage(gold: DataFrame, linked: DataFrame, source: str, dest: str, guid: str) -> DataFrame:
    """[J25] One row: gold relations, and those whose first or second argument has no linked mention, or whose ends are the same."""
    ids = linked.select(F.col(guid).alias("_g")).filter("_g is not null").distinct().withColumn("_y", F.lit(True))
    g = gold.join(ids.withColumnsRenamed({"_g": source, "_y": "_s"}), source, "left").join(ids.withColumnsRenamed({"_g": dest, "_y": "_d"}), dest, "left")
    no = lambda c: F.count_if(F.col(c).isNull())
    return g.agg(F.count(F.lit(1)).alias("n"), no("_s").alias("missed_arg1"), no("_d").alias("missed_arg2"), F.count_if(F.col("_s").isNotNull() & F.col("_d").isNotNull()).alias("covered"), F.count_if(F.col(source) == F.col(dest)).alias("same_entity"))


def evaluated_mentions(gold: DataFrame, linked: DataFrame, featured: DataFrame) -> DataFrame:
    """[J25] One row of counts over gold relations (gold, docid, charbegin, charend, arg1: the place of the second argument, and the first one's id):
    all; without a linked mention there; with several; whose sentence has no mention of the first argument; whose first such mention has no
    features; and whose two mentions are of one entity. ``linked`` has (mention_key, docid, charbegin, charend, entity, sentence), ``featured`` the
    mention_keys with features. The first mention, by place and key, counts, as where several overlap."""
    hits = overlapping_spans(gold, linked, "docid", "charbegin", "charend")
    order = F.struct("charbegin_o", "mention_key_o")
    per = hits.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col("entity_o").alias("e"), F.col("sentence_o").alias("s")), order).alias("_b"))
    at = gold.select("gold", "docid", "arg1").join(per, "gold", "left").select("gold", "docid", "arg1", F.coalesce("n", F.lit(0)).alias("n"), F.col("_b.e").alias("ent"), F.col("_b.s").alias("sentence"))
    first = linked.groupBy("docid", "sentence", F.col("entity").alias("arg1")).agg(F.min_by("mention_key", F.struct("charbegin", "mention_key")).alias("mention_key"))
    at = at.join(first, ["docid", "sentence", "arg1"], "left").join(featured.select("mention_key", F.lit(True).alias("_f")), "mention_key", "left")
    has = F.col("mention_key").isNotNull()
    return at.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") == 0).alias("missed_arg2"), F.count_if(F.col("n") > 1).alias("multiple_overlap"), F.count_if((F.col("n") > 0) & ~has).alias("missed_arg1"),
        F.count_if(has & F.col("_f").isNull()).alias("no_features"), F.count_if(has & (F.col("ent") == F.col("arg1"))).alias("same_entity"),
    )


def unmatched_slots(pairs: DataFrame, slots: DataFrame) -> DataFrame:
    """[J28] The gold slots (arg1, arg2, slot) whose arguments no pair joins, either way round."""
    p = pairs.select("arg1", "arg2")
    both = p.unionByName(p.select(F.col("arg2").alias("arg1"), F.col("arg1").alias("arg2"))).distinct()
    return slots.select("arg1", "arg2", "slot").distinct().join(both, ["arg1", "arg2"], "left_anti")


def labelled_pairs(pairs: DataFrame, slots: DataFrame, split_of: DataFrame) -> DataFrame:
    """[J28] Pairs (arg1, arg2) with ``split`` from arg1, else from arg2, else other, and ``slot`` where a slot joins them either way."""
    s1 = split_of.select(F.col("entity").alias("arg1"), F.col("split").alias("_s1"))
    s2 = split_of.select(F.col("entity").alias("arg2"), F.col("split").alias("_s2"))
    f = slots.groupBy("arg1", "arg2").agg(F.min("slot").alias("_f"))
    r = f.select(F.col("arg1").alias("arg2"), F.col("arg2").alias("arg1"), F.col("_f").alias("_r"))
    out = pairs.join(s1, "arg1", "left").join(s2, "arg2", "left").join(f, ["arg1", "arg2"], "left").join(r, ["arg1", "arg2"], "left")
    return out.withColumns({"split": F.coalesce("_s1", "_s2", F.lit("other")), "slot": F.coalesce("_f", "_r")}).drop("_s1", "_s2", "_f", "_r")


def token_spans(tokens: DataFrame, keys: list[str], pos: str, tag: str, word: str) -> DataFrame:
    """Runs of equal entity tags (other than O and null) within a sentence: (keys, start, end, label, text), end one past the last.
    The run that ends a sentence counts too. Gaps and islands on one window per sentence."""
    w = Window.partitionBy(*keys).orderBy(pos)
    t = tokens.withColumn("_t", F.coalesce(tag, F.lit("O")))
    t = t.withColumn("_new", (F.col("_t") != F.lag("_t", 1, "").over(w)).cast("int")).withColumn("_run", F.sum("_new").over(w)).filter("_t <> 'O'")
    g = t.groupBy(*keys, "_run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).cast("int").alias("end"), F.first("_t").alias("label"), F.array_sort(F.collect_list(F.struct(pos, word))).alias("_w"))
    return g.select(*keys, "start", "end", "label", F.array_join(F.transform("_w", lambda x: F.coalesce(x[word], F.lit(""))), " ").alias("text"))


def span_text(spans: DataFrame, tokens: DataFrame, keys: list[str], start: str, end: str, pos: str, word: str) -> DataFrame:
    """[J29] Text of each span from the token table: places are listed first, so it's an equi-join."""
    cols = spans.columns
    places = spans.filter(F.col(start) < F.col(end)).withColumn(pos, F.explode(F.sequence(start, F.col(end) - 1)))
    hit = places.join(tokens.select(*keys, pos, word), [*keys, pos])
    g = hit.groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct(pos, word))).alias("_w"))
    return g.select(*cols, F.array_join(F.transform("_w", lambda x: F.coalesce(x[word], F.lit(""))), " ").alias("text"))


def new_deliveries(incoming: DataFrame, wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """[S26, S27] Incoming rows that are wanted and not stored yet."""
    return incoming.join(wanted.select(key).distinct(), key, "left_semi").join(stored.select(key).distinct(), key, "left_anti")


def initial_entities(train: DataFrame, dev: DataFrame, known: DataFrame, ids: str) -> DataFrame:
    """[S26] (id, name, train, dev): the entities that queries ask for, flagged by the sets that do, and behind them those of the KB whose id none has.
    All have (``ids``, name); of several names of an id the smallest counts."""
    flagged = lambda df, t, d: df.select(F.col(ids).alias("id"), "name", F.lit(t).alias("train"), F.lit(d).alias("dev"))
    asked = flagged(train, True, False).unionByName(flagged(dev, False, True)).filter("id is not null")
    asked = asked.groupBy("id").agg(F.min("name").alias("name"), F.max("train").alias("train"), F.max("dev").alias("dev"))
    rest = flagged(known, False, False).filter("id is not null").join(asked.select("id"), "id", "left_anti")
    return asked.unionByName(rest.groupBy("id").agg(F.min("name").alias("name"), F.max("train").alias("train"), F.max("dev").alias("dev")))


def initial_slots(slots: DataFrame, entities: DataFrame, source: str, relation: str, dest: str) -> DataFrame:
    """[S26] Slots of asked entities: the distinct (arg1, slot, arg2) whose first argument is flagged, with its flags."""
    e = entities.filter("train or dev").select(F.col("id").alias("arg1"), "train", "dev")
    return slots.select(F.col(source).alias("arg1"), F.col(relation).alias("slot"), F.col(dest).alias("arg2")).distinct().join(e, "arg1")


def ingested(incoming: DataFrame, wanted: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """[S27] Documents (``key``, sentences with tokens) that are wanted and not stored yet, as two tables of what is taken out of them: the mentions
    (runs of entity tags) and the ordered pairs of mentions of one sentence."""
    new = new_deliveries(incoming, wanted, stored, key)
    tokens = flatten(new.select(key, "sentences"), [key], "documents")["sentences.tokens"]
    keys = [key, "sentences_no"]
    found = settled(token_spans(tokens, keys, "tokens_no", "ner", "word"), "mentions")
    return found, sentence_pairs(found, keys, "start", "end", "text")


def components(edges: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """[M24] (node, cluster): connected components, each named by its smallest node.

    Alternating large-star and small-star steps: in each, a node's neighbours are pointed at the smallest of them, which needs O(log n)
    rounds; edges are written between rounds, so lineage stays short, and a count on the written table ends the loop. It goes on
    until nothing changes; where a bound of ``rounds`` is given and isn't enough, it raises.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = settled(e.select("u").union(e.select("v")).distinct(), "nodes")
    e = settled(e.filter("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct(), "edges")
    for done in itertools.count(1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = settled(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        changed = nxt.join(e, ["u", "v"], "left_anti").limit(1).count() or e.join(nxt, ["u", "v"], "left_anti").limit(1).count()
        discard(e)
        e = nxt
        if not changed:
            break
        if done == rounds:
            raise RuntimeError(f"components: not converged after {rounds} rounds")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("_c")), "u", "left").select(F.col("u").alias("node"), F.coalesce("_c", "u").alias("cluster"))


def best_antecedent(scored: DataFrame, mention: str, earlier: str, score: str, least: float) -> DataFrame:
    """[M24] For each mention the earlier one of the highest score of at least ``least``, ties to the nearer."""
    ok = scored.filter((F.col(earlier) < F.col(mention)) & (F.col(score) >= least))
    return ok.groupBy(mention).agg(F.max_by(earlier, F.struct(score, earlier)).alias(earlier))


def nearest_same_name(mentions: DataFrame, doc: str, mention: str, label: str) -> DataFrame:
    """[M24] For each mention the nearest earlier one of its document with the same name, else with the same name in another case. Two windows;
    mentions are not paired."""
    w = Window.partitionBy(doc, label).orderBy(mention)
    v = Window.partitionBy(doc, "_low").orderBy(mention)
    out = mentions.withColumn("_low", F.lower(label)).withColumn("earlier", F.coalesce(F.lag(mention).over(w), F.lag(mention).over(v)))
    return out.filter("earlier is not null").select(mention, "earlier")


def longest_canonical(mentions: DataFrame, cluster: str, phrase: str) -> DataFrame:
    """The longest phrase of each cluster, ties by the phrase."""
    return mentions.groupBy(cluster).agg(F.max_by(phrase, F.struct(F.length(phrase), phrase)).alias("canonical"))


def order_columns(*cols: str) -> list[Column]:
    """Descending, nulls last."""
    return [F.col(c).desc_nulls_last() for c in cols]
