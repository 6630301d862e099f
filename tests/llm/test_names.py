"""Name linking: the trie, the rules, and brute force over small vocabularies."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import names as N


@pytest.mark.parametrize("a,b,d", [("abcd", "abcd", 0), ("abcd", "abdc", 1), ("abcd", "abd", 1), ("abcd", "xbcd", 1), ("abcd", "badc", 2), ("abcd", "wxyz", 3), ("", "a", 1)])
def test_edits(a, b, d):
    assert N.edits(a, b) == d == N.edits(b, a)


def test_trie_is_exact():
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(300)}
    t = N.Trie()
    for w in words:
        t.add(w)
    for w in list(words)[:60] + ["", "zzz"]:
        for k in (0, 1):
            assert t.near(w, k) == {x for x in words if N.edits(w, x) <= k}


def test_near_tokens(spark):
    r = random.Random(2)
    words = set()
    for _ in range(150):
        w = "".join(r.choice("abcde") for _ in range(r.randrange(4, 13)))
        words |= {w, w[:2] + w[3:], w[:1] + w[2:3] + w[1:2] + w[3:], w[:-1] + "x", "y" + w}
    words = {w for w in words if len(w) >= 4}
    got = {(x.t, x.u) for x in N.near_tokens(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and N.edits(a, b) == 1}


SAME = [
    ("Sen. Ferdinand Grei", "Grei, Ferdinand"), ("Bob Koudakria", "Robert B. Koudakria"), ("R. Koudakria", "Robert Koudakria"), ("A.S. Mopakeslin", "Anthony S. Mopakeslin"), ("V.F. Vaistaifastia", "Victoria Vaistaifastia"), ("S. Skiveizal Cty.", "South Skiveizal County"),
    ("U. of Koudakriabol", "University of Koudakriabol"), ("Koudakriabol University", "Univ. of Koudakriabol"), ("Kouleskazam Paper Ltd.", "Kouleskazam Paper Limited"), ("Kouleskazam Paper", "THE KOULESKAZAM PAPER COMPANY"),
    ("City of Piahaihaheir", "Piahaihaheir"), ("Ft. Krakraidrei Co.", "Fort Krakraidrei County"), ("Anthnoy Hiapiaprika", "Anthony Hiapiaprkia"), ("Renée Zodiakroun", "renee zodiakroun"), ("Zodiakroun   Renee", "Renee Zodiakroun ."),
    ("Steel Assn Bainimikun and Sons", "Bainimikun & Sons Steel Ass'n"),
]
OTHER = [
    ("Edward Keigehaprai", "Quentin Keigehaprai"), ("Robert A. Koudakria", "Robert B. Koudakria"), ("North Droboumaidil", "Fort Droboumaidil"), ("Droboumaidil", "North Droboumaidil"),
    ("Rougegiabus Brewing Brothers", "Rougegiabus Airways International"), ("Kouleskazam Paper Limited", "Kouleskazam Paper Holdings"), ("Q. Keigehaprai", "Edward Keigehaprai"), ("V.F. Vaistaifastia", "Frederick Vaistaifastia"), ("F. Vaistaifastia", "Victoria F. Vaistaifastia"), ("Nort Skiveizal", "Victoria Skiveizal"), ("Fort Grouba County", "Fort Grouba"),
]


def test_two_apart(spark):
    r = random.Random(3)
    words = set()
    for _ in range(120):
        w = "".join(r.choice("abcde") for _ in range(r.randrange(6, 12)))
        words |= {w, w[1:-1], w[:3] + "xy" + w[3:], w[1] + w[0] + w[2:-2] + w[-1] + w[-2], "y" + w[:-1]}
    words = {w for w in words if len(w) >= 6}
    got = {(x.t, x.u) for x in N.two_apart(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {(a, b) for a in words for b in words if N.edits(a, b) == 2}


def test_shared_endings_make_no_large_shard(spark):
    """Tokens of one ending are spread over shards."""
    words = [f"{a}{b}{c}{d}ison" for a in "bcdfg" for b in "aeiou" for c in "klmnp" for d in "aeiou"]
    rows = spark.createDataFrame([(w,) for w in words], "token string").select(F.inline(N.shard_rows(F.col("token"))))
    assert rows.filter("kind = 0").groupBy("shard").count().agg(F.max("count")).first()[0] <= 25


def _linked(spark, ents, said=()):
    e = spark.createDataFrame([(i, n, "junk") for i, n in enumerate(ents)], "ent_key bigint, ent_name string, cls string")
    m = spark.createDataFrame([(1000 + i, n, g, 0) for i, (n, g) in enumerate(said)], "mention_key bigint, label string, entity string, side int")
    return sorted(tuple(r) for r in N.same_entity_pairs(e, m).collect())


def test_rules():
    for group in (SAME, OTHER):
        for a, b in group:
            xs, ys = N.name_tokens(a), N.name_tokens(b)
            if sorted(xs) == sorted(ys):
                assert group is SAME, (a, b)
                continue
            hit = any(N.same_name([x for j, x in enumerate(xs) if j != i], [y for j, y in enumerate(ys) if j != k], N.edits(x, y)) for i, x in enumerate(xs) for k, y in enumerate(ys) if len(x) > 4 and N.edits(x, y) <= 2 and (x == y or not {x, y} <= N.KNOWN))
            assert hit == (group is SAME), (a, b)


def test_pairs(spark):
    got = _linked(spark, ["Bob Koudakria", "Robert Koudakira", None, "", "...", "Edward Zlatnik"], [("Koudakria, R.", None), ("Robert Koudakria", "g"), (None, None), ("Edward Zlatnik", None), ("Edward Zlatnik", None)])
    assert got == [(0, 1), (0, 1000), (1, 1000), (5, 1003), (5, 1004)]


def test_two_slips_need_a_step(spark):
    assert _linked(spark, ["Krakraidreifoun", "Krakradreifoum"]) == []
    assert _linked(spark, ["Krakraidreifoun", "Krakradreifoum"], [("Krakraidreifoum", "g")]) == [(0, 1)]


def test_two_slips_beside_an_agreeing_word(spark):
    assert _linked(spark, ["A. Krakraidreifoun", "Anthony Krakradreifoum", "Q. Krakradreifoum"]) == [(0, 1)]


def test_copies_and_frequent_names(spark):
    many = [f"John Smith{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)] + ["John Smith", "J. Smith", "Jack Smith"] + [f"{n} Smith" for n in N.FORMAL] + ["Zed Quux"] * 40
    got = set(_linked(spark, many))
    assert (60, 61) in got and (60, 62) in got
    first = len(many) - 40
    assert sum(a >= first for a, b in got) == 40 * 39 // 2


def test_slips_in_frequent_names(spark):
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    many = [f"{x}qqv{x} Hiapiaprika" for x in letters] + [f"Anthony {x}zzk{x}" for x in letters]
    said = ["Anthnoy Hiapiaprika", "Anthony Hiapiaprkia", "A. Hiapiaprkia", "nAthony Hiapiaprika", "Anthony iHapiaprika", "Q. Hiapiaprika"]
    n = len(many)
    got = {(a - n, b - n) for a, b in _linked(spark, many + said) if a >= n}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 4), (3, 4)}


def test_short_words(spark):
    some = ["R. Lee", "Robert Lee", "T. Ng", "Tam Ng", "Tan Ng", "Bo Li", "Li, Bo.", "Bo Lo", "T. N."]
    want = {(0, 1), (2, 3), (2, 4), (5, 6)}
    assert set(_linked(spark, some)) == want
    frequent = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}q Ng" for i in range(60)] + [f"{chr(97 + i // 26)}{chr(97 + i % 26)}q Lee" for i in range(60)]
    no_t = [n for n in frequent if n[0] not in "tr"]
    assert {p for p in _linked(spark, some + no_t) if p[1] < len(some)} == want


@pytest.mark.parametrize("rare", [0, 1, 3, 50])
def test_frequency_steers_the_work_only(spark, rare):
    names = [n for pair in SAME + OTHER for n in pair] + ["Pat Koudakria", "Patrick Koudakria", "Patrcik Koudakrai", "P. Koudakria", "P. Koudakrai", "nAthony iHapiaprika", "Kouleskazam Limted", "Kouleskazam Limited", "Kouleskazam", "Kouleskzaam"]
    names += ["Zanthippe Smith", "Z. Smith", "Kim Lee", "K. Lee", "Li Wu", "L. Wu", "Adnre Fofigreibrul", "Anrde Fofigreibrul", "Andre Kiata", "Timbeer Braidoudredrus Assn", "Tmber Braidoudredrus Association", "Timber Kiata"]
    names += ["N. Skebozoupos County", "Nabraidregom S. County", "N. Nabrizovo County", "N. Krouforum Cty."]
    cls = N.name_classes(spark.createDataFrame([(n,) for n in names], "name string")).distinct()
    got, all_compared = ({tuple(r) for r in N.linked_classes(cls, k).collect()} for k in (rare, 10**6))
    assert got == all_compared
    linked = {frozenset(p) for p in got}
    for a, b in (("smith zanthippe", "smith z"), ("kim lee", "k lee"), ("li wu", "l wu"), ("adnre fofigreibrul", "anrde fofigreibrul"), ("association braidoudredrus timbeer", "association braidoudredrus tmber")):
        assert frozenset((a, b)) in linked, (a, b)
    unlike = ("skebozoupos", "nabraidregom", "nabrizovo", "krouforum")
    assert not any(any(w in x for w in unlike) for pair in got for x in pair)


def test_candidates_grow_with_the_names(spark):
    """Twice the classes of shared words make about twice the candidates, not four times as many."""

    def candidates(n):
        r = random.Random(1)
        word = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.choice([3, 4])))
        first, last = [word() for _ in range(60)], [word() for _ in range(n // 60)]
        classes: set[str] = set()
        while len(classes) < n:
            f = r.choice(first)
            classes.add(" ".join(sorted([f[0] if r.random() < 0.1 else f, r.choice(last)])))
        return N.candidate_pairs(spark.createDataFrame([(c,) for c in classes], "cls string"), 5).count()

    one, two, four = (candidates(n) for n in (700, 1400, 2800))
    assert two < 2.6 * one and four < 2.6 * two


def test_empty(spark):
    assert _linked(spark, []) == []
    assert N.linked_classes(spark.createDataFrame([], "cls string")).count() == 0


def test_no_join_follows_the_data_to_the_driver(spark):
    """However small the files of its tables look, nothing of the names is broadcast."""
    e = spark.createDataFrame([(0, "Bob Koudakria"), (1, "Robert Koudakira")], "ent_key bigint, ent_name string")
    m = spark.createDataFrame([(9, "Koudakria, R.", None)], "mention_key bigint, label string, entity string")
    seen = []
    settled = N.settled
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(N, "settled", lambda df, name: (seen.append(df), settled(df, name))[1])
        seen.append(N.same_entity_pairs(e, m))
        assert len(seen) > 5 and seen[-1].count() == 3
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, plan
