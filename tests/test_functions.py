"""Text, path and scoring functions on small hand-made inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from factloom.functions import paths, scoring, text
from factloom.functions.folding import folded_words
from factloom.operators import counts

# Paths as they are written in the data, and the phrases they must give.
RENDERED = [
    ("path#nsubjpass|<-nsubjpass<-challenge->prep->by->pobj->|pobj", "_enta was challenge by _entb"),
    ("path#rcmod|->rcmod->be->nsubj->|nsubj:INV", "_entb who is _enta"),
    ("path#appos|->appos->nominee->amod->|amod", "_enta , _entb nominee"),
    ("path#appos|<-appos<-president->appos->|appos", "president _enta , _entb"),
    ("path#appos|->appos->president->poss->|poss", "_enta , _entb 's president"),
    ("path#nsubj|<-nsubj<-be->prep->in->pobj->|pobj", "_enta is in _entb"),
    ("path#pobj|<-pobj<-in<-prep<-meeting->prep->with->pobj->|pobj", "meeting in _enta with _entb"),
    ("poss|<-poss<-company->nn->|nn", "_enta 's _entb company"),
    ("path#nsubj|<-nsubj<-award->iobj->|iobj", "_enta award _entb something"),
    ("path#advmod|->advmod->back->dep->to->pobj->|pobj", "_enta , back to _entb"),
    (None, None),
    ("", None),
    ("a|b", None),
]


@pytest.mark.parametrize("path,expected", RENDERED)
def test_render(path, expected):
    assert paths.render(path) == expected


def test_render_column(spark):
    df = spark.createDataFrame([(p, None, None) for p, _ in RENDERED], "p string, a string, b string")
    assert [r[0] for r in df.select(paths.render_udf("p", "a", "b")).collect()] == [e for _, e in RENDERED]


def test_long_path():
    assert paths.render("x|" + "->dobj->word" * 5000 + "|x").count("word") == 5000


TREE = [1, -1, 1, 2, 3]  # 0 <- 1 (root) -> 2 -> 3 -> 4
LABELS = ["nsubj", "root", "dobj", "prep", "pobj"]
WORDS = ["Bob", "met", "Al", "in", "Rome"]
TAGS = ["NNP", "VBD", "NNP", "IN", "NNP"]


def test_tree_path():
    assert paths.tree_path(TREE, LABELS, WORDS, 0, 4) == ("<-nsubj<-met->dobj->al->prep->in->pobj->", 1, [0, 1, 2, 3, 4])
    assert paths.tree_path(TREE, LABELS, WORDS, 2, 4)[0] == "->prep->in->pobj->"
    assert paths.tree_path([None, None], ["a", "b"], ["x", "y"], 0, 1) is None
    assert paths.tree_path([1, 0], ["a", "b"], ["x", "y"], 0, 1) is not None  # a cycle ends


def test_entities_on_a_path_are_read_as_their_tags():
    ner = ["PERSON", "O", "PERSON", "O", "LOCATION"]
    assert paths.tree_path(TREE, LABELS, WORDS, 0, 4, ner)[0] == "<-nsubj<-met->dobj->person->prep->in->pobj->"
    assert paths.tree_path(TREE, LABELS, ["Bob", "met", "Jr.", "in", "Rome"], 0, 4, ["O"] * 5)[0] == "<-nsubj<-met->dobj->o->prep->in->pobj->"
    assert paths.tree_path(TREE, LABELS, WORDS, 0, 3, [None] * 5)[0] == "<-nsubj<-met->dobj->al->prep->"


def test_tags_that_make_junk():
    on, common = [0, 1, 2, 3, 4], 1
    assert not paths.is_junk(on, common, LABELS, WORDS, TAGS)
    assert paths.is_junk(on, common, LABELS, WORDS, ["NNP", "VBD", "CD", "IN", "NNP"])
    assert paths.is_junk(on, common, LABELS, WORDS, ["NNP", "VBD", None, "IN", "NNP"])
    assert not paths.is_junk(on, common, LABELS, WORDS, ["NNP", "MD", "NNP", "IN", "NNP"])  # the root's tag isn't asked for
    assert paths.is_junk(on, common, ["adv", *LABELS[1:]], WORDS, TAGS)
    assert not paths.is_junk([1, 2, 3, 4], 1, ["x", "root", "adv", "prep", "pobj"], WORDS, TAGS)  # a path that begins at its root has no first label
    assert paths.is_junk(on, common, ["sbj", "root", "dobj", "prep", "sbj"], WORDS, TAGS)


def test_junk():
    ok = paths.tree_path(TREE, LABELS, WORDS, 0, 4)
    assert not paths.is_junk(ok[2], ok[1], LABELS, WORDS, TAGS)
    assert paths.is_junk(ok[2], ok[1], ["conj", *LABELS[1:]], WORDS, TAGS)
    assert paths.is_junk(ok[2], ok[1], LABELS, ["Bob", "say", *WORDS[2:]], TAGS)
    assert paths.is_junk(ok[2], ok[1], LABELS, WORDS, ["IN"] * 5)
    assert paths.is_junk(ok[2], ok[1], LABELS, ["[", *WORDS[1:]], TAGS)


def test_heads():
    assert paths.head_of_span(TREE, 2, 5) == 2
    assert paths.head_of_span(TREE, 4, 5) == 4
    assert paths.head_of_span([1, 0, 1], 0, 2) == 1


def test_path_columns_with_nulls(spark):
    df = spark.createDataFrame([(TREE, LABELS, WORDS, TAGS, 0, 4), (None, None, WORDS, None, 0, 1), (TREE, None, None, None, 0, 1), ([None, 0], None, ["a", "b"], None, 0, None)], "h array<int>, l array<string>, w array<string>, t array<string>, s int, d int")
    got = [r[0] for r in df.select(paths.path_udf("h", "l", "w", "t", F.lit(None).cast("array<string>"), "s", "d")).collect()]
    assert got[0].path == "<-nsubj<-met->dobj->al->prep->in->pobj->" and got[0].length == 5 and got[0].junk is False
    assert [g.path for g in got[1:]] == [None, None, None]
    assert [r[0] for r in df.select(paths.span_head_udf("h", "s", "d")).collect()] == [1, None, 0, None]


def _one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_mask_stem_tokens(spark):
    masked = text.mask_entities(F.lit("Bob met Al in 1999"), F.lit("Bob"), F.lit("Al"))
    assert _one(spark, masked) == "_enta met _entb in 1999"
    assert _one(spark, text.stem(masked)) == "_enta met _entb in 0000"
    assert _one(spark, text.tokens(text.stem(masked))) == ["_enta", "met", "_entb", "in", "0000"]
    assert _one(spark, text.mask_entities(F.lit("x"), F.lit(""), F.lit(None).cast("string"))) == "x"
    assert _one(spark, text.mask_entities(F.lit(None).cast("string"), F.lit("a"), F.lit("b"))) is None
    assert _one(spark, text.mask_entities(F.lit("a.c abc"), F.lit("a.c"), F.lit("zz"))) == "_enta abc"


def test_vocabulary_and_vectors(spark, rows):
    df = spark.createDataFrame([("a b a",), ("b a c",), (None,), ("",)], "s string")
    v = counts.vocabulary(counts.token_counts(df, text.tokens(F.col("s"))), 6)
    assert [r[0] for r in v.orderBy("id").collect()] == ["_pad", "_unk", "_go", "_eos", "a", "b"]
    m = v.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("m"))
    words = F.array(*[F.lit(x) for x in "acb"])
    got = m.select(text.vectorize(words, F.col("m"), eos=True).alias("e"), text.vectorize(words, F.col("m"), go=True, eos=True).alias("g")).select("e", "g", text.pad(F.col("e"), 6).alias("p"), text.pad(F.col("e"), 3).alias("q"), text.weights(text.pad(F.col("e"), 6)).alias("w")).first()
    assert (got.e, got.g, got.p, got.q, got.w) == ([4, 1, 5, 3], [2, 4, 1, 5, 3], [4, 1, 5, 3, 0, 0], [4, 1, 5, 3], [1.0, 1.0, 1.0, 1.0, 0.0, 0.0])


def test_vectorizer(spark):
    df = spark.createDataFrame([(["a", "c", "b", None],), ([],), (None,), (["b"] * 50_000,)], "w array<string>")
    for go in (False, True):
        for eos in (False, True):
            got = [r[0] for r in df.select(text.vectorizer([("a", 4), ("b", 5)], go, eos)("w")).collect()]
            g, e = [2] * go, [3] * eos
            assert got == [[*g, 4, 1, 5, 1, *e], [*g, *e], None, [*g, *[5] * 50_000, *e]]
    ids = spark.createDataFrame([([0, 1, 9, None],), ([],), (None,)], "i array<int>")
    assert [r[0] for r in ids.select(text.decoder(["x", "y"])("i")).collect()] == ["x y _unk _unk", "", None]
    assert df.limit(0).select(text.vectorizer([])("w")).count() == 0


def test_prefix_field(spark):
    f = F.split(F.lit("POSITIVE\tx\ty\tREL$r1\tpath#p\tREL$r2"), "\t")
    assert _one(spark, text.first_with_prefix(f, "REL$")) == "r1"
    assert _one(spark, text.first_with_prefix(f, "path#")) == "p"
    assert _one(spark, text.first_with_prefix(f, "ner#")) is None


@pytest.mark.parametrize("name,short", [("International Business Machines", "IBM"), ("Peter D. Hart", "#None#"), ("Al Gore", "#None#"), ("", "#None#")])
def test_abbreviation(spark, name, short):
    assert _one(spark, text.abbreviation(F.lit(name))) == short


def test_between_brackets_onehot(spark):
    assert _one(spark, text.between_names(F.lit("Bob met old Al"), F.lit("Bob"), F.lit("Al"))) == "met old"
    assert _one(spark, text.between_names(F.lit("Al met Bob"), F.lit("Bob"), F.lit("Al"))) is None
    assert _one(spark, text.bracketed(F.lit("in ROME"), F.lit("Rome"))) == "in [ROME]"
    assert _one(spark, text.bracketed(F.lit("a+b"), F.lit("a+b"))) == "[a+b]"
    assert _one(spark, text.one_hot(F.lit(2), 3)) == [0, 0, 1] and _one(spark, text.one_hot(F.lit(None).cast("int"), 2)) == [0, 0]
    assert _one(spark, text.clean_lex(F.lit("the a great x deal"))) == "great deal"


def test_folded_words(spark):
    df = spark.createDataFrame([("Renée O'Brien-2",), ("",), (None,), ("ÅÉ x" * 20000,)], "s string")
    got = [r[0] for r in df.select(folded_words(F.col("s"))).collect()]
    assert got[:3] == [["renee", "o", "brien", "2"], [], None] and len(got[3]) == 20001


def test_scores(spark):
    assert _one(spark, scoring.sigmoid(F.lit(-800.0))) == 0.0 and _one(spark, scoring.sigmoid(F.lit(800.0))) == 1.0
    assert _one(spark, scoring.log1p_exp(F.lit(800.0))) == 800.0
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert _one(spark, scoring.pair_score(arr(1.0, 2.0), arr(3.0, 4.0), F.lit(0.5), arr(0.25, 0.25))) == 12.0
    assert _one(spark, scoring.tensor_score(arr(1.0, 2.0), arr(-1.0, 1.0), arr(2.0, -3.0), F.lit(0.5))) == 4.0


@pytest.mark.parametrize("w,l,p", [(3, 1, 0.625), (1, 1, 1.5), (0, 0, 2.0), (700, 650, None)])
def test_sign_test(spark, w, l, p):
    got = _one(spark, scoring.sign_test(F.lit(w), F.lit(l)))
    assert math.isfinite(got) and (p is None or abs(got - p) < 1e-9)
