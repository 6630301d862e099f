"""Skewed keys and nested records."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import nested, skew
from factloom.plans import hygiene


@pytest.fixture
def hot(spark):
    r = random.Random(1)
    keys = ["hot"] * 600 + [None] * 100 + [f"k{r.randrange(150)}" for _ in range(300)]
    return spark.createDataFrame([(k, i, i % 7) for i, k in enumerate(keys)], "k string, no int, _bin int").repartition(5)


def test_plan_is_bounded_and_balanced(hot):
    p = skew.plan(hot, "k", 8)
    assert len(p.rows) <= skew.PARTS * 8 and p.total == 1000
    shards = dict(p.rows)
    assert len(shards["hot"]) == 5 and len(set(shards["hot"])) == 5


def test_fragments_are_even(hot):
    p = skew.plan(hot, "k", 8)
    f = skew.fragment(hot, "k", p, "b", "s")
    sizes = [r["count"] for r in f.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 200
    assert f.select("b", F.spark_partition_id().alias("at")).distinct().groupBy("b").count().filter("count > 1").count() == 0


def test_aggregate(hot, rows):
    a = skew.balanced_aggregate(hot, "k", {"n": (F.lit(1), "count"), "lo": (F.col("no"), "min"), "hi": (F.col("no"), "max"), "t": (F.col("no"), "sum")}, 8)
    want = hot.groupBy("k").agg(F.count("*").alias("n"), F.min("no").alias("lo"), F.max("no").alias("hi"), F.sum("no").alias("t"))
    assert rows(a) == rows(want)
    assert skew.balanced_aggregate(hot.limit(0), "k", {"n": (F.lit(1), "count")}, 4).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join(spark, hot, rows, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4), ("zz", 5)], "k string, no int")
    got = skew.balanced_join(hot, right, "k", 8, how)
    assert got.columns == ["k", "no", "_bin", "no_r"]
    want = hot.join(right.withColumnRenamed("no", "no_r"), "k", how).select("k", "no", "_bin", "no_r")
    assert rows(got) == rows(want)
    with pytest.raises(ValueError):
        skew.balanced_join(hot, right, "k", 8, "full")


def test_dominant(spark, hot, rows):
    assert rows(skew.dominant_keys(hot, "k", 0.05, 8), "k", "n") == [("hot", 600)]
    assert skew.dominant_keys(hot.limit(0), "k", 0.05, 8).count() == 0
    one = spark.createDataFrame([("x",)] * 50, "n string")
    assert rows(skew.dominant_keys(one, "n", 0.05, 4), "n", "n_") == [("x", 50)]


def test_flatten(spark, rows):
    s = "id string, extra int, a array<struct<x:int,b:array<int>,c:struct<d:string,e:array<struct<f:int>>>>>"
    df = spark.createDataFrame([("p", 1, [(1, [7, None], ("d", [(5,), None])), None, (2, None, None)]), ("q", 2, []), ("r", 3, None)], s)
    t = nested.flatten(df, ["id"], "root")
    assert set(t) == {"root", "a", "a.b", "a.c.e"}
    assert rows(t["root"]) == [("p", 1, 3), ("q", 2, 0), ("r", 3, None)]
    assert rows(t["a"], "id", "a_no", "x", "b_size", "c_d", "c_e_size") == [("p", 0, 1, 2, "d", 2), ("p", 1, None, None, None, None), ("p", 2, 2, None, None, None)]
    assert rows(t["a.b"]) == [("p", 0, 0, 7), ("p", 0, 1, None)]
    assert rows(t["a.c.e"]) == [("p", 0, 0, 5), ("p", 0, 1, None)]


def test_nested_arrays_and_clashes(spark, rows):
    df = spark.createDataFrame([(1, 9, [[1, 2], [3]])], "m_no int, m_size int, m array<array<int>>")
    t = nested.flatten(df, ["m_no"], "root")
    assert rows(t["m.items"]) == [(1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 0, 3)]
    assert t["root"].columns == ["m_no", "m_size", "m_size_"]


def test_merged_schema(spark, rows):
    a = spark.createDataFrame([(1, (1, "x"), [(1,)])], "k int, s struct<p:int,q:string>, l array<struct<u:int>>")
    b = spark.createDataFrame([(2.5, (2, 0.5), [(7, "v")], "new")], "k double, s struct<p:bigint,r:double>, l array<struct<u:bigint,w:string>>, z string")
    m = nested.merged([a, b])
    assert m.schema["s"].dataType.fieldNames() == ["p", "q", "r"] and m.schema["k"].dataType == T.DoubleType()
    assert rows(m, "k", "s.p", "s.q", "s.r", "z") == [(1.0, 1, "x", None, None), (2.5, 2, None, 0.5, "new")]
    assert nested.merge_types(T.StringType(), T.LongType()) == T.StringType()
    assert nested.merged([a, spark.createDataFrame([(None, None, None)], a.schema)]).filter("s is null").count() == 1


def test_mention_tokens(spark, rows):
    tree = "struct<root:int,head:array<int>,reltype:array<string>>"
    s = f"filename string, sentences array<struct<tokens:array<struct<word:string,tag:string,ner:string>>,mentions:array<struct<id:int,entityguid:string,tok_from:int,tok_to:int,label:string>>,deptree:{tree}>>"
    tok = [("w", None, None)] * 3
    m = lambda i, a, b: (i, None, a, b, None)
    df = spark.createDataFrame(
        [("d", [(tok, [m(1, 1, 9), m(1, 2, 2), m(2, -5, 1), m(3, None, 2)], (0, [5, None], None)), None, (None, [m(4, 0, 2)], None), (tok, None, None), (tok, [m(5, 0, 2), m(5, 1, 2)], None)]), ("e", None), ("f", [])], s
    )
    df = df.withColumn("sentences", nested.sentence_parts(F.col("sentences")))
    got = rows(nested.mention_tokens(df, "filename"))
    assert got == [("d", 0, 1, 1, -1), ("d", 0, 1, 2, -1), ("d", 0, 2, 0, 5), ("d", 4, 5, 0, -1), ("d", 4, 5, 1, -1), ("d", 4, 5, 1, -1)]
    assert nested.mention_tokens(df.limit(0), "filename").count() == 0


def test_documents_without_a_name(spark, rows, tmp_path):
    tree = "struct<root:int,head:array<int>,reltype:array<string>>"
    s = f"filename string, received_at timestamp, sentences array<struct<tokens:array<struct<word:string,tag:string,ner:string>>,mentions:array<struct<id:int,entityguid:string,tok_from:int,tok_to:int,label:string>>,deptree:{tree}>>"
    doc = lambda i, n: [([("w", None, None)] * n, [(i, None, 0, 9, None)], (0, [i] * n, None))]
    df = spark.createDataFrame([(None, None, doc(1, 2)), (None, None, doc(2, 1)), ("d", None, doc(3, 1))], s)
    df.write.parquet(str(tmp_path / "parsed_docs.parquet"))
    assert rows(hygiene.p4_found(spark, str(tmp_path))) == [(None, 0, 1, 0, 1), (None, 0, 1, 1, 1), (None, 0, 2, 0, 2), ("d", 0, 3, 0, 3)]


def test_pruned(spark):
    s = T.StructType.fromDDL("k string, a array<struct<x:int,y:struct<z:int,w:string>>>, b int")
    assert nested.pruned(s, ["k", "a.y.z"]).simpleString() == "struct<k:string,a:array<struct<y:struct<z:int>>>>"
    assert nested.pruned(s, ["a", "a.x"]).simpleString() == "struct<a:array<struct<x:int,y:struct<z:int,w:string>>>>"


def test_partial_results_of_many_keys(spark, rows, monkeypatch):
    """A task that meets more keys than it holds passes results on early; the sums stay right."""
    df = spark.range(30000, numPartitions=2).select((F.col("id") % 9000).alias("k"), F.col("id").cast("double").alias("x"), F.timestamp_seconds("id").alias("at"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("s"))
    aggs = {"n": (F.col("s"), "count"), "t": (F.col("x"), "sum"), "a": (F.col("at"), "max"), "b": (F.col("s"), "min")}
    want = df.groupBy("k").agg(F.count("s").alias("n"), F.sum("x").alias("t"), F.max("at").alias("a"), F.min("s").alias("b"))
    assert rows(skew.balanced_aggregate(df, "k", aggs, 8)) == rows(want)


def test_partials_go_to_their_bins(hot):
    """The exchange of an aggregate is the one by bin: nothing is shuffled between it and the sums of a bin."""
    text = skew.balanced_aggregate(hot, "k", {"n": (F.lit(1), "count")}, 8)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange shufflepartitionid") == 1 and text.count("Exchange hashpartitioning") == 1, text


def test_keys_of_other_kinds(spark, rows):
    """Keys that are all null, numbers, times and very long texts."""
    none = spark.createDataFrame([(None, 1)] * 30, "k string, k_ int")
    assert skew.dominant_keys(none, "k", 0.05, 4).count() == 0
    assert rows(skew.balanced_aggregate(none, "k", {"n": (F.lit(1), "count")}, 4)) == [(None, 30)]
    some = spark.range(60).select(F.when(F.col("id") < 40, 7).otherwise(F.col("id")).alias("i"), F.timestamp_seconds(F.col("id") % 2).alias("t"), F.repeat(F.lit("x"), 20_000).alias("s"), (F.col("id") % 2 == 0).alias("b"))
    assert rows(skew.dominant_keys(some, "i", 0.5, 4), "i", "n") == [(7, 40)]
    assert rows(skew.dominant_keys(some, "t", 0.5, 4), "n") == [(30,), (30,)] and rows(skew.dominant_keys(some, "b", 0.5, 4), "n") == [(30,), (30,)]
    assert rows(skew.dominant_keys(some, "s", 0.5, 4), "n") == [(60,)]


def test_mentions_of_odd_documents(spark, rows):
    """Null and empty documents, sentences and trees; a very long sentence; extra columns."""
    tree = "struct<root:int,head:array<int>,reltype:array<string>>"
    s = f"filename string, _n int, sentences array<struct<tokens:array<struct<word:string,tag:string,ner:string>>,mentions:array<struct<id:int,entityguid:string,tok_from:int,tok_to:int,label:string>>,deptree:{tree}>>"
    tok = ("w", None, None)
    df = spark.createDataFrame(
        [("a", 1, []), ("b", 2, None), (None, 3, [None, ([], [(1, None, 0, 2, None)], None)]), ("c", 4, [([tok] * 5000, [(1, None, 0, 9999, None), None, (2, None, 4999, 5000, None)], (0, [1] * 4999, None))])], s
    )
    out = nested.mention_tokens(df.withColumn("sentences", nested.sentence_parts(F.col("sentences"))), "filename")
    assert out.count() == 5001 and rows(out.filter("head_no = -1"), "mention_id", "tok_no") == [(1, 4999), (2, 4999)]
