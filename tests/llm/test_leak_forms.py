"""Leaks against brute force; forms and their classes."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest

from factloom.llm import forms, leak


@pytest.mark.parametrize("depth", [1, 13, 40, 1000])
def test_suffix_array(depth):
    r = random.Random(0)
    ids = np.array([r.choice([-1, 0, 1, 2]) for _ in range(400)])
    order = leak.suffix_array(ids, depth)
    keys = [tuple(ids[i : i + depth]) for i in order]
    assert sorted(order) == list(range(400)) and keys == sorted(keys)


@pytest.mark.parametrize("m", [1, 5, 13, 20, 24, 40])
def test_any_threshold(spark, monkeypatch, m):
    """Few words in long runs: matches that agree far beyond the first words."""
    monkeypatch.setattr(leak, "SHARD_WORDS", 3000)
    r = random.Random(m)
    items = [(i, " ".join(r.choice("ab") for _ in range(r.choice([m - 1, m, m + 1, 60])))) for i in range(20)]
    docs = []
    for i in range(80):
        w = r.choice(items)[1].split()
        a, b = r.randrange(4), r.choice([m - 1, m, m + 3])
        docs.append((i, " ".join([r.choice("ab") for _ in range(30)] + w[a : a + b] + [r.choice("abz") for _ in range(40)])))
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame(items, "item_id bigint, text string")
    want = _brute(docs, items, m)
    assert {(x.doc_id, x.item_id) for x in leak.leaks(d, q, min_words=m).collect()} == want and want


def _brute(docs, items, m=13):
    grams = lambda w: {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    d, q = {k: leak.words(t) for k, t in docs}, {k: leak.words(t) for k, t in items}
    return {(a, b) for a in d for b in q if grams(d[a]) & grams(q[b])}


def _longest(x, y):
    best = 0
    for i in range(len(x)):
        for j in range(len(y)):
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(leak, "SHARD_WORDS", 500)
    r = random.Random(7)
    vocab = ["a", "b", "c", "the", "Été"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([5, 12, 13, 14, 40])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, items[5][1])]
    docs = []
    for i in range(250):
        t = " ".join(r.choice(vocab + ["zebra", "qq"]) for _ in range(r.choice([0, 5, 30, 80])))
        if r.random() < 0.6:
            w = (r.choice(items[:25])[1]).split()
            a = r.randrange(3)
            t += "; " + unicodedata.normalize("NFD", " ".join(w[a : a + r.choice([12, 13, 20])]).upper()) + "​ ! " + t
        docs.append((i, t))
    docs += [(500, None), (501, ""), (502, "zebra " * 50_000 + items[3][1] * 3), (503, docs[3][1])]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs] + [(None, items[20][1], 1)], "doc_id bigint, text string, n_words int").repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in leak.leaks(d, q).collect()}
    assert set(got) == _brute([x for x in docs if x[1]], [x for x in items if x[1]]) and len(got) > 30
    text, item = dict(docs), dict(items)
    for (k, i), x in list(got.items())[:40]:
        w, v = leak.words(text[k]), leak.words(item[i])
        assert w[x.doc_place : x.doc_place + x.n_words] == v[x.item_place : x.item_place + x.n_words]
        if len(w) < 200:
            assert x.n_words == _longest(w, v)
    monkeypatch.setattr(leak, "BLOCK_CHARS", 300)
    assert {(x.doc_id, x.item_id) for x in leak.leaks(d, q).collect()} == set(got)
    monkeypatch.setattr(leak, "BLOCKS_A_PASS", 2)
    assert {(x.doc_id, x.item_id) for x in leak.leaks(d, q).collect()} == set(got)
    clean = leak.without_leaks(d, leak.leaks(d, q))
    assert clean.count() == len(docs) + 1 - len({k for k, _ in got})
    assert leak.leaks(d.limit(0), q).count() == 0 and leak.leaks(d, q.limit(0)).count() == 0


FORMS = [
    ("Ｆｕｌｌ　ｗｉｄｔｈ１", "Full width1"), ("ﬁne ﬂow", "fine flow"), ("été", "été"), ("so­ft z​w﻿‍⁠", "soft zw"), ("a b c　d", "a b c d"),
    ("Lеs rоsеѕ", "Les roses"), ("Βοb", "Bob"), ("е́", "é"), ("x² ½ ™ ①", "x² ½ ™ ①"), ("K Å", "K Å"), ("A  b\r\n\tc", "A  b\r\n\tc"), ("ｶﾞ が", "ガ が"), ("مرحبا 漢字", "مرحبا 漢字"), ("e‍́", "é"),
]


@pytest.mark.parametrize("text,form", FORMS)
def test_form(text, form):
    assert forms.consistent_form(text) == form
    assert forms.consistent_form(form) == form or form in ("x² ½ ™ ①",)


def test_forms_are_stable():
    r = random.Random(3)
    pool = "aA1 éеоР́ΑοЖж​Ａﬁ漢が²"
    for _ in range(500):
        f = forms.consistent_form("".join(r.choice(pool) for _ in range(20)))
        assert forms.consistent_form(f) == f


def test_scripts():
    assert forms.resolve("Lеs") == ("Les", "mixed") and forms.resolve("сор") == ("cop", "whole") and forms.resolve("привет")[1] == "single" and forms.resolve("été") == ("été", "single")
    assert forms.resolve("漢字かな") == ("漢字かな", "single")


SPELLINGS = [
    ("вода мост", "вода мост", "вoдa мocт", 0, 0), ("вoда", "вода", "вoдa", 1, 0), ("Жf", "Жf", "Жf", 1, 0), ("сор", "cop", "cop", 0, 1), ("Lеs été", "Les été", "Les été", 1, 0), ("Bοb", "Bob", "Bob", 1, 0),
    ("μοre", "μοre", "μore", 1, 0), ("λόγoς", "λόγος", None, 1, 0),
]


@pytest.mark.parametrize("text,spelling,form,mixed,whole", SPELLINGS)
def test_spelling_is_of_the_resolved_script(text, spelling, form, mixed, whole):
    assert forms.consistent_spelling(text) == spelling
    got = forms._report(text)
    assert got[1:] == (spelling, mixed, whole) and got[0] == forms.consistent_form(text) and (form is None or got[0] == form)
    assert forms.consistent_form(spelling) == got[0]


def test_pairs(spark):
    rows = [(1, "café x"), (2, "café x"), (3, "café x"), (4, "саfé x"), (5, None), (6, ""), (7, "​"), (8, " 　\n"), (9, "other"), (10, "y" * 100_000), (11, "y" * 100_000 + "​"), (12, "Café x")]
    df = spark.createDataFrame([(*r, "q") for r in rows] + [(None, "café x", "q")], "doc_id bigint, text string, form_key string")
    got = sorted(tuple(r) for r in forms.same_form_pairs(df.filter("doc_id is not null")).collect())
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)]
    rep = {r.doc_id: (r.form, r.n_mixed, r.n_whole) for r in forms.with_forms(df.filter("doc_id < 10")).collect()}
    assert rep[4] == ("café x", 1, 0) and rep[5] == (None, None, None) and rep[6] == ("", 0, 0)
    assert forms.same_form_pairs(df.limit(0)).count() == 0


def test_hot_class(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(400)] + [(1000, "same text")], "doc_id bigint, text string")
    assert forms.same_form_pairs(df).count() == 400
