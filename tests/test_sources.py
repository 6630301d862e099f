"""Readers and writers on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.sources import protobuf as pb
from factloom.sources import sinks, textfiles, xmlfiles
from factloom.streaming import cellstream


def _put(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text.encode(encoding))
    return str(p)


@pytest.fixture
def small_splits(spark):
    """Files are read in many splits, as large ones are."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    want = [f"line {i} " + "é" * (i % 9) if i % 10 else "" for i in range(1, 1001)]
    for encoding, name in (("utf-8", "UTF-8"), ("latin-1", "ISO-8859-1")):
        p = _put(tmp_path, f"{name}/b.txt", "\n".join(want) + "\n", encoding)
        df = textfiles.lines(spark, p, name)
        assert df.select(F.spark_partition_id()).distinct().count() > 5
        assert [(r.line_no, r.value) for r in df.orderBy("line_no").collect()] == list(enumerate(want, 1))
        _put(tmp_path, f"{name}/a.txt", "x\ny", encoding)
        _put(tmp_path, f"{name}/c.txt", "", encoding)
        both = textfiles.lines(spark, str(tmp_path / name), name, through=True).orderBy("line_no").collect()
        assert [(r.line_no, r.value) for r in both] == list(enumerate(["x", "y", *want], 1))
        per = textfiles.lines(spark, str(tmp_path / name), name).groupBy("file").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.countDistinct("line_no").alias("n")).collect()
        assert sorted((r.a, r.b, r.n) for r in per) == [(1, 2, 2), (1, 1000, 1000)]


def test_formats_over_splits(spark, tmp_path, rows, small_splits):
    n = 2000
    files = {c: _put(tmp_path, f"{c}.txt", "".join(f"{c}{i}" + "." * (i % (5 if c == "a" else 11)) + "\n" for i in range(n))) for c in "ab"}
    got = textfiles.zipped(spark, files).orderBy("line_no").collect()
    assert len(got) == n and all(r.a.strip(".")[1:] == r.b.strip(".")[1:] == str(r.line_no - 1) for r in got)
    m = textfiles.dense_matrix(spark, _put(tmp_path, "m.txt", "".join(f"{i} {i * 2}\n" for i in range(n))))
    assert m.filter("value = i * (j + 1)").count() == m.count() == 2 * n
    t = textfiles.tuple_file(spark, _put(tmp_path, "t.tsv", "".join(f"{i}\ta|b\tr#2\n" for i in range(n))), limit=100)
    assert sorted(int(r.id) for r in t.collect()) == list(range(100))
    lines = []
    for i in range(60):
        lines += [f"target{i}", *[f"{j}\tsource{i}" for j in range(i % 50)]]
    c = textfiles.cooccurrence_file(spark, _put(tmp_path, "c.txt", "\n".join(lines) + "\n"))
    assert rows(c) == sorted([(f"target{i}", f"source{i}", j) for i in range(60) for j in range(i % 50)], key=lambda r: tuple((True, str(x)) for x in r))
    r = textfiles.rank_file(spark, _put(tmp_path, "r.tsv", "".join(f"{i}\ta\tb\tg\tp\n" for i in range(n))))
    assert r.filter("line_no = score + 1").count() == n
    a = textfiles.slot_annotations(spark, _put(tmp_path, "s.tab", "h\n" + ("\t".join("0 sf 2 lab doc 5 9 phrase 8 9 1".split()) + "\n") * 200))
    assert a.count() == 200


def test_corpus(spark, tmp_path):
    p = _put(tmp_path, "c.tsv", "#Document x\nPOSITIVE\ta\tb\tpath#p\tsen#s one\tREL$r\tREL$q \r\nshort\tline\n\nNEGATIVE\tc\td\n")
    got = textfiles.corpus_tsv(spark, p).orderBy("line_no").collect()
    assert [(r.label, r.ent_a, r.path, r.relation, r.ner) for r in got] == [("POSITIVE", "a", "p", "r", None), ("NEGATIVE", "c", None, None, None)]
    cut = textfiles.corpus_tsv(spark, _put(tmp_path, "d.tsv", "P\ta\tb123\n"), drop_last=3).first()
    assert cut.ent_b == "b"


def test_lists_and_zip(spark, tmp_path):
    a, b = _put(tmp_path, "a.txt", " x \ny\n"), _put(tmp_path, "b.txt", "1\n2\n3\n")
    assert [r.value for r in textfiles.value_list(spark, a).orderBy("line_no").collect()] == ["x", "y"]
    assert [(r.a, r.b) for r in textfiles.zipped(spark, {"a": a, "b": b}).orderBy("line_no").collect()] == [(" x ", "1"), ("y", "2"), (None, "3")]


def test_cells(spark, tmp_path, rows):
    p = _put(tmp_path, "w.tsv", "POSITIVE\tJosé\tb\tr1\tr2\nx\ty\tr3\nz\tq\n", "latin-1")
    assert rows(textfiles.wide_cells(spark, p), "tag", "arg1", "arg2", "relation") == [(None, "x", "y", "r3"), ("POSITIVE", "José", "b", "r1"), ("POSITIVE", "José", "b", "r2")]
    c = textfiles.compact_cells(spark, _put(tmp_path, "k.tsv", "a|b\tr@0.5\ts\tq@1.5E-4\n"))
    assert rows(c) == [("a", "b", "q", 0.00015), ("a", "b", "r", 0.5), ("a", "b", "s", 1.0)]
    t = textfiles.tuple_file(spark, _put(tmp_path, "t.tsv", "7\ta|b\tr#2\ts#1\tu\n"), hide=1)
    assert t.count() == 3 and t.filter("hidden").count() == 1 and rows(t, "relation", "count") == [("r", 2), ("s", 1), ("u", 1)]
    assert rows(textfiles.triples(spark, _put(tmp_path, "u.tsv", "a\tp\tq\n"), unary=True)) == [("a", None, "p", False), ("a", None, "q", False)]


def test_lookups(spark, tmp_path, rows):
    p = _put(tmp_path, "l.tsv", "r\ta\tb\nq\ta\tb\nr\tC\td\n")
    assert rows(textfiles.lookup(spark, p, [1, 2], 0)) == [("C", "d", "r"), ("a", "b", "q")]
    assert rows(textfiles.lookup(spark, p, [1], None, lower=True)) == [("a",), ("c",)]
    assert rows(textfiles.multi_lookup(spark, p)) == [("q", ["a", "b"]), ("r", ["C", "a", "b", "d"])]


def test_more_formats(spark, tmp_path, rows):
    e = textfiles.embeddings(spark, _put(tmp_path, "e.txt", "the 0.5 1\nof 2 3\n"))
    assert rows(e) == [("of", [2.0, 3.0]), ("the", [0.5, 1.0])]
    g = textfiles.gold_annotations(spark, _put(tmp_path, "g.tsv", "1\tr\ta\tb\n0\tr\ta\tb\n1\tr\tc\td\n"))
    assert rows(g) == [("r", "a", "b", False), ("r", "c", "d", True)]
    r = textfiles.rank_file(spark, _put(tmp_path, "r.tsv", "0.9\ta|b\tg\tp\n0.8\tc\td\tg\tp\nbad\n"))
    assert rows(r, "score", "arg1", "arg2", "gold") == [(0.8, "c", "d", "g"), (0.9, "a", "b", "g")]
    m = textfiles.dense_matrix(spark, _put(tmp_path, "m.txt", "1 2\n3 x\n"))
    assert rows(m) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, None)]
    c = textfiles.cooccurrence_file(spark, _put(tmp_path, "o.txt", "t1\n3\ta\n2\tb\nt2\n1\tc\n"))
    assert rows(c) == [("t1", "a", 3), ("t1", "b", 2), ("t2", "c", 1)]
    s = textfiles.mention_sentences(spark, _put(tmp_path, "s.tsv", "#Document q\nT\ta\tb\ts1\nT\ta\tb\tf\ts2\nT\ta\tb\ts1\n"))
    assert rows(s) == [("a", "b", ["s1", "s2"])]
    a = textfiles.slot_annotations(spark, _put(tmp_path, "a.tab", "head\n" + "\t".join("0 sf 2 lab doc 5 9 phrase 8 9 1".split()) + "\n"), "lab")
    assert rows(a) == [("sf", "lab", "doc", 5, 9, "phrase", True)]


def test_documents(spark, tmp_path):
    _put(tmp_path, "docs/a/1.txt", "short")
    _put(tmp_path, "docs/b/2.txt", "x" * 50 + "<POST>y</POST>" + "z" * 50)
    _put(tmp_path, "docs/b/3.txt", "x" * 100)
    got = sorted(r.text for r in textfiles.documents(spark, str(tmp_path / "docs"), 60).collect())
    assert got == ["short", "x" * 50 + "<POST>y</POST>"]
    df = spark.createDataFrame([(1, "<P>\na\n\nb\n</P><POST>c</POST>"), (2, None), (3, "")], "k int, t string")
    assert sorted((r.kind, r.block) for r in textfiles.regions(df, "k", "t").collect()) == [("P", "a"), ("P", "b"), ("POST", "c")]


def test_cache(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert textfiles.load_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert made == [1]


def test_protobuf_round_trip(spark, tmp_path):
    rel = [{"sourceGuid": f"g{i}", "destGuid": "h", "relType": None if i == 3 else "r", "mention": [{"filename": "f", "sourceId": -1, "destId": 300, "feature": ["a", "é"], "sentence": None}] * (i % 3)} for i in range(2500)]
    (tmp_path / "x.pb").write_bytes(pb.delimited(rel, pb.RELATION))
    got = pb.read(spark, str(tmp_path / "x.pb"), pb.RELATION).orderBy("no").collect()
    assert len(got) == 2500 and got[3].relType is None and got[2].mention[1].asDict() == {"filename": "f", "sourceId": -1, "destId": 300, "feature": ["a", "é"], "sentence": None}
    doc = {"filename": "d", "sentences": [{"tokens": [{"word": "w", "tag": "T", "ner": None}], "mentions": [], "depTree": {"root": 0, "head": [-1], "relType": ["root"]}}]}
    assert pb.decode(pb.encode(doc, pb.DOCUMENT), pb.DOCUMENT) == doc
    (tmp_path / "empty.pb").write_bytes(b"")
    assert pb.read(spark, str(tmp_path / "empty.pb"), pb.ENTITY).count() == 0


def test_xml(spark, tmp_path, rows):
    p = _put(tmp_path, "q.xml", '<kbpslotfill><query id="S1"><name>Al</name><enttype>PER</enttype><docid>d</docid></query><query id="S2"><name>Bo</name></query></kbpslotfill>')
    kb = spark.createDataFrame([("Al", "g2"), ("Al", "g1")], "name string, guid string")
    assert rows(xmlfiles.slot_queries(spark, p, kb), "query_id", "enttype", "guid") == [("S1", "PER", "g1"), ("S2", None, None)]


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.9), (3, None, 0.1)], "k int, r string, s double")
    sinks.columns(df, str(tmp_path / "cols"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "cols" / "r")).collect()] == ["a", "b", ""]
    sinks.ranked(df, str(tmp_path / "rank"), "s", ["k"])
    assert [r._c1 for r in spark.read.option("sep", "\t").csv(str(tmp_path / "rank")).orderBy(F.col("_c0").cast("double").desc()).collect()] == ["2", "1", "3"]
    t = sinks.tac(df.select(F.lit("q").alias("q"), "r", F.lit("f").alias("f"), F.lit("d").alias("d"), "s"), str(tmp_path / "tac"), "q", "r", "f", "d", "s")
    assert sorted(r.no for r in t.collect()) == [1, 2, 3]
    sinks.metrics(df, str(tmp_path / "m"))
    sinks.by_relation(df, str(tmp_path / "by"), "r")
    assert spark.read.parquet(str(tmp_path / "by")).count() == 3
    b = sinks.miml(spark.createDataFrame([("a", "b", "r", ["m1", "m2"])], "src string, dst string, labels string, mentions array<string>"), str(tmp_path / "miml"))
    assert b.first().value == "RELATION\ta\tb\tr\nMENTION\tm1\nMENTION\tm2"
    sinks.distinct_lists({"r": df.select("r")}, str(tmp_path / "d"))
    sinks.dictionaries({"k": df}, str(tmp_path / "dict"))
    sinks.dump(df, str(tmp_path / "dump"), "rows")
    p = spark.createDataFrame([("d", "PER", "ORG", ["f", "g"]), ("d", "LOC", "LOC", ["h"])], "doc string, label_1 string, label_2 string, features array<string>")
    sinks.relation_mentions(p, str(tmp_path / "rm"), "doc", ["PER"])
    assert spark.read.parquet(str(tmp_path / "rm")).count() == 2


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("r", "a", "b", "2020-01-01"), ("r", "a", "b", "2020-01-01"), ("s", "a", None, "2020-01-09")], "relation string, arg1 string, arg2 string, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    s = cellstream.once(cellstream.arriving(spark, str(tmp_path / "in"), df.schema), "t")
    q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    w = cellstream.windowed_counts(cellstream.arriving(spark, str(tmp_path / "in"), df.schema), "t")
    q = w.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start(str(tmp_path / "out2"))
    q.awaitTermination(60)
    assert ("r", 2) in {(r.relation, r.n) for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
