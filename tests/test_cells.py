"""Cell, supervision, counting and entity operators on hand-made rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import cells as C
from factloom.operators import counts, deliveries, entities, sampling, supervision
from factloom.plans import kb

CELL = "relation string, arg1 string, arg2 string"


def test_frequency_filter(spark, rows):
    t = {"t1": ["path#a", "path#b", "lex#z"], "t2": ["path#a", "path#b"], "t3": ["path#a", "REL$NA", "lex#z"], "t4": ["path#c"]}
    df = spark.createDataFrame([(r, k, "x") for k, v in t.items() for r in v], CELL)
    got = rows(C.frequency_filter(df, 2, 2, ["path#", "REL$"]), "arg1", "relation")
    assert got == [("t1", "lex#z"), ("t1", "path#a"), ("t1", "path#b"), ("t2", "path#a"), ("t2", "path#b")]
    # the worked example keeps t1 without its lex cell where only predictable cells are wanted
    assert rows(C.frequency_filter(df.limit(0), 2, 2, ["path#"])) == []


def test_frequency_filter_upper_bound(spark):
    df = spark.createDataFrame([(f"path#{i % 2}", "t", str(i // 100)) for i in range(200)], CELL)
    assert C.frequency_filter(df, 2, 2, ["path#"], below=50).count() == 0
    assert C.frequency_filter(df, 2, 2, ["path#"], below=101).count() == 200


def test_null_tuples_are_equal(spark, rows):
    a = spark.createDataFrame([("r", "x", None), ("s", "x", None), (None, None, None)], CELL)
    assert rows(C.insert_absent(a, spark.createDataFrame([("r", "x", None), ("q", "x", None)], CELL)), "relation") == [(None,), ("q",), ("r",), ("s",)]
    assert rows(C.missing_tuples(spark.createDataFrame([("r", "x", None), ("r", "y", None)], CELL), a)) == [("y", None)]
    assert C.filled(a.select("arg1", "arg2"), a.filter("relation is not null"), a).count() == 2


def test_duplication(spark, rows):
    c = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y"), ("a", "u", "v")], CELL)
    got = rows(C.duplicated_rows(c, spark.createDataFrame([("n", "x", "y"), ("n", "q", "q")], CELL)), "relation", "arg1", "target")
    assert got == [("a", "x [n]", 1.0), ("b", "x [n]", 1.0), ("n", "x [n]", 0.0)]


def test_distant_supervision(spark, rows):
    kb = spark.createDataFrame([("x", "y", "r")], "source string, dest string, relation string")
    ents = spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "entity string")
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "z"), ("x", "q"), (None, "x")], "src string, dst string")
    known = spark.createDataFrame([("x", "y")], "src string, dst string")
    got = rows(supervision.distant_labels(pairs.filter("src is not null"), kb, ents, known), "src", "dst", "relation", "tag", "inverse")
    assert got == [("x", "q", "REL$NA", "UNLABELED", False), ("x", "y", "r", "POSITIVE", False), ("x", "y", "r", "POSITIVE", True), ("x", "z", "REL$NA", "NEGATIVE", False)]
    more = known.union(spark.createDataFrame([("z", "x")], "src string, dst string"))
    assert ("x", "z") not in [r[:2] for r in rows(supervision.distant_labels(pairs, kb, ents, more), "src", "dst")]
    assert supervision.distant_labels(pairs, kb, ents, None).count() == 2
    assert supervision.distant_labels(pairs.limit(0), kb, ents, known).count() == 0


def test_pair_grouping(spark):
    m = spark.createDataFrame([("x", "y", "NEGATIVE", ["f1", None]), ("x", "y", "POSITIVE", ["f2", "sen#s", "POSITIVE"]), ("x", "y", " positive ", None), ("a", "b", None, None)], "src string, dst string, tag string, features array<string>")
    got = sorted(((r.src, r.tag, r.n_mentions, r.feature) for r in supervision.grouped_pairs(m, "features").collect()), key=str)
    assert got == [("a", None, 1, None), ("x", "POSITIVE", 3, "f1"), ("x", "POSITIVE", 3, "f2")]


def test_two_hops(spark, rows):
    t = spark.createDataFrame([(1, "a", "b", "r1"), (2, "b", "c", "r2"), (3, "b", "d", "r3")], "no int, source string, dest string, relation string")
    assert rows(supervision.two_hops(t, "no")) == [("a", "r1", "b", "r3", "d", None, None)]
    closed = t.union(spark.createDataFrame([(4, "d", "a", "r4")], t.schema))
    assert ("a", "r1", "b", "r3", "d", "r4", "POS") in rows(supervision.two_hops(closed, "no"))


def test_second_order_from_either_end(spark, rows):
    """Pairs with a hub at one end: the result is that of joining all legs."""
    t = [("hub", f"c{i}", "r") for i in range(40)] + [(f"c{i}", "end", "s") for i in range(0, 40, 8)] + [("hub", "end", "goal")] + [("one", "c1", "q"), ("c1", "sink", "w"), ("one", "sink", "goal")] + [(f"d{i}", "sink", "v") for i in range(30)]
    got = rows(supervision.second_order(spark.createDataFrame(t, "source string, dest string, relation string"), "goal"))
    want = sorted((a, b, c, [r], [q]) for a, b, x in t if x == "goal" for s, c, r in t if s == a for c2, e, q in t if c2 == c and e == b)
    assert sorted(got) == want and len(want) == 6


def test_cooccurrence(spark, rows):
    c = spark.createDataFrame([(1, "a", "x", "y"), (2, "b", "x", "y"), (3, "a", "x", "y"), (4, "b", "u", None)], "no int, " + CELL)
    assert rows(supervision.cooccurrence(c, "no")) == [("a", "a", 1), ("a", "b", 1), ("b", "a", 1)]
    assert rows(supervision.symmetric_cooccurrence(c)) == [("a", "b", 1), ("b", "a", 1)]


def test_span_overlap(spark, rows):
    s = spark.createDataFrame([(1, "d", 10, 20), (2, "d", 15, 30), (3, "d", 21, 25), (4, "d", 20, 25), (5, "e", 10, 20), (6, None, 10, 20), (7, "d", None, 3), (8, "d", 0, 100000)], "k int, doc string, b int, e int")
    got = {(r.k, r.k_o) for r in entities.overlapping_spans(s, s, "doc", "b", "e").filter("k < k_o").collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (1, 8), (2, 8), (3, 8), (4, 8)}
    assert {r.k: r.match for r in entities.first_overlap(s.filter("k = 3"), s.filter("k < 3").withColumnRenamed("k", "o"), "k", "doc", "b", "e", "o").collect()} == {3: 2}


def test_entity_runs(spark, rows):
    t = spark.createDataFrame([("s", 0, "PER", "Al"), ("s", 1, "PER", "Gore"), ("s", 2, "LOC", "Rome"), ("s", 3, None, "x"), ("s", 4, "PER", "Bob")], "s string, p int, n string, w string")
    assert rows(entities.token_spans(t, ["s"], "p", "n", "w")) == [("s", 0, 2, "PER", "Al Gore"), ("s", 2, 3, "LOC", "Rome"), ("s", 4, 5, "PER", "Bob")]


def test_components(spark, rows):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a int, b int")
    got = dict(rows(entities.components(e, "a", "b")))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert entities.components(e.limit(0), "a", "b").count() == 0


def test_triple_clusters_take_every_relation(spark, rows, tmp_path):
    r = random.Random(4)
    made = [(i, f"e{r.randrange(150):03}", f"e{r.randrange(150):03}", r.choice(["/a/b", "/c/d", "/e/f"])) for i in range(90)]
    extra = [(90, "x", None, "/a/b"), (91, "e000", "y", "NA"), (92, "e001", "z", None)]
    spark.createDataFrame(made + extra, "rel_key bigint, sourceguid string, destguid string, reltype string").write.parquet(str(tmp_path / "kb_relations.parquet"))
    near = {}
    for _, a, b, _ in made:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert len({c for c in want.values()}) > 5
    assert rows(kb.triple_clusters(spark, str(tmp_path)), "node", "cluster") == sorted(want.items())


def test_components_never_stop_early(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    with pytest.raises(RuntimeError, match="not converged"):
        entities.components(e, "a", "b", 2)


def test_linking(spark, rows):
    m = spark.createDataFrame([(1, "Al"), (2, "Bo"), (3, "Bo"), (4, None)], "k int, label string")
    e = spark.createDataFrame([("g2", "Al"), ("g1", "Al"), ("g3", None)], "guid string, name string")
    got = {r.k: (r.linked, r.is_new) for r in entities.link_exact(m, e, "label", "name", "guid").collect()}
    assert got[1] == ("g1", False) and got[2] == got[3] and got[2][1] and got[4] == (None, False)


def test_deliveries(spark, rows):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n"), (None, 1, "n")], "k string, t int, v string")
    assert rows(deliveries.latest_per_key(d, "k", F.col("t"))) == [(None, 1, "n"), (None, 1, "n"), ("a", 2, "y"), ("b", None, "z")]
    assert deliveries.once_per_key(d.select("k", F.lit(1).alias("c")), "k").count() == 4


def test_split(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "k")
    got = {r.k: r.part for r in sampling.split_by_counts(df, "k", 2, 3).collect()}
    assert [got[i] for i in range(1, 11)] == ["train"] * 5 + ["validation"] * 2 + ["test"] * 3
    assert set(r.part for r in sampling.split_by_counts(df, "k", 0, 0).collect()) == {"train"}


def test_negatives_never_exist(spark):
    c = spark.createDataFrame([(f"r{i % 5}", f"a{i}", "b") for i in range(50)] + [(f"r{i}", "full", "b") for i in range(5)], CELL)
    rels = spark.createDataFrame([(f"r{i}", i) for i in range(5)], "rel string, idx bigint")
    neg = sampling.negatives(c, rels, 4, F.pmod(F.xxhash64("arg1"), F.lit(1000)))
    assert neg.count() > 50 and neg.join(c, ["relation", "arg1", "arg2"]).count() == 0 and neg.filter("arg1 = 'full'").count() == 0


def test_fill_keeps_known(spark):
    ids = spark.range(6).withColumnRenamed("id", "k")
    emb = spark.createDataFrame([(1, [1.0, 2.0]), (3, [3.0, 5.0])], "k bigint, v array<float>")
    got = {r.k: (r.v, r.known) for r in sampling.filled_embeddings(ids, emb, "k", "v", 2).collect()}
    assert got[1] == ([1.0, 2.0], True) and not got[0][1] and len(got[0][0]) == 2
    assert got == {r.k: (r.v, r.known) for r in sampling.filled_embeddings(ids, emb, "k", "v", 2).collect()}


def test_dictionary(spark, rows):
    df = spark.createDataFrame([(f"v{i % 100:03d}",) for i in range(1000)] + [(None,)], "v string")
    assert rows(counts.dictionary(df, "v")) == [(f"v{i:03d}", i) for i in range(100)]
    assert counts.dictionary(df.limit(0), "v").count() == 0


def test_canonical_part(spark, rows):
    p = spark.createDataFrame([("Mr. Al Gore Jr",), ("Al Gore",), ("Dr. Who",)], "label string")
    n = spark.createDataFrame([("Al",), ("Al Gore",), ("Gore",), ("",)], "name string")
    assert rows(entities.canonical_by_part(p, n, "label", "name", ["Mr.", "Dr."])) == [("Mr. Al Gore Jr", "Al Gore")]
