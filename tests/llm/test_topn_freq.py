"""Top-n, term frequencies and pairs of items against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from factloom.llm import freq, together, topn


def test_top_n(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 8 + [None] + [f"g{i}" for i in range(30)]), r.randrange(20) / 10, i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, id int, bound string").repartition(7)
    got = {(x.g, x.rank): x.id for x in topn.top_n(df, "g", "s", [F.col("id").asc()], 5, "rank").collect()}
    want = {}
    for g in {x[0] for x in rows}:
        for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))[:5], 1):
            want[(g, k)] = x[2]
    assert got == want
    assert topn.top_n(df.limit(0), "g", "s", [F.col("id").asc()], 5).count() == 0


def test_bounds_cut_rows(spark):
    df = spark.range(4000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("s")).repartition(4)
    b = topn.partition_bounds(df, "g", "s", 5).first().bound
    assert 3900 < b <= 3995


def test_latest_scores(spark):
    s = "cell_id bigint, relation string, arg1 string, arg2 string, predicted double, scored_at int"
    df = spark.createDataFrame([(1, "r", "a", None, 0.9, 1), (2, "r", "a", None, 0.1, 2), (3, "r", "a", None, 0.2, 2), (4, "r", "a", None, None, 9), (5, "r", "a", None, float("nan"), 9), (6, "r", "a", "b", 0.5, None)], s)
    assert sorted((r.arg2 or "", r.cell_id) for r in topn.latest_scores(df).collect()) == [("", 3), ("b", 6)]


@pytest.mark.parametrize("heavy", [0, 3, 1024])
def test_frequencies(spark, heavy):
    r = random.Random(3)
    lists = [[r.choice(["the"] * 5 + ["of", ""] + [f"t{i}" for i in range(80)]) for _ in range(r.randrange(9))] for _ in range(400)] + [None, [None, ""], ["x" * 100_000, "x" * 100_000]]
    df = spark.createDataFrame([(x,) for x in lists], "terms array<string>").repartition(6)
    got = {x.term: (x.n_occurrences, x.n_records, x.mark) for x in freq.term_frequencies(df, heavy=max(heavy, 1)).collect()}
    occ, rec, n = Counter(), Counter(), 0
    for x in lists:
        t = [w for w in x or [] if w]
        occ.update(t)
        rec.update(set(t))
        n += bool(t)
    mark = lambda c: "rare" if c < 3 else "common" if c > n * 0.1 else None
    assert got == {w: (occ[w], rec[w], mark(rec[w])) for w in occ}


def test_no_terms(spark):
    df = spark.createDataFrame([(None,), ([],)], "terms array<string>")
    assert freq.term_frequencies(df).count() == 0 and freq.term_frequencies(df.limit(0)).count() == 0


def _pairs(baskets, least, lift):
    items = Counter(i for b in baskets for i in set(b or []) - {None})
    both = Counter(p for b in baskets for p in combinations(sorted(set(b or []) - {None}), 2))
    n = len(baskets)
    return {p: c for p, c in both.items() if c >= least and c * n >= lift * items[p[0]] * items[p[1]]}


@pytest.mark.parametrize("least,lift,chunk", [(1, 0.0, 4), (2, 1.5, 4), (3, 3.0, 32), (5, 10.0, 2)])
def test_pairs(spark, least, lift, chunk):
    r = random.Random(4)
    baskets = [[r.choice(["hot", None] + [f"i{min(int(r.expovariate(0.08)), 60)}" for _ in range(3)]) for _ in range(r.choice([0, 1, 2, 5, 30]))] for _ in range(300)] + [None, []]
    baskets += [["a1", "a2", "a2"]] * 6
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>").repartition(5)
    got = {(x.item_a, x.item_b): x.n_ab for x in together.associated(df, min_together=least, min_lift=lift, chunk=chunk).collect()}
    assert got == _pairs(baskets, least, lift)


def test_repeated_large_baskets_are_spread(spark):
    """Chunk pairs of many equal baskets go to all partitions alike."""
    rows = spark.range(300).withColumn("items", F.array(*[F.lit(f"i{k:03d}") for k in range(100)]))
    plan = together.basket_pairs(rows, "id")
    assert {x.n_ab for x in plan.collect()} == {300} and plan.count() == 100 * 99 // 2
    dealt = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("x")).repartition(16, F.xxhash64("id", "x", F.lit(0)))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 3000 / 16


def test_large_basket(spark):
    df = spark.createDataFrame([([f"i{k:04d}" for k in range(700)],), (["i0000", "i0699"],)], "items array<string>")
    out = together.associated(df)
    assert out.count() == 700 * 699 // 2 and out.filter("n_ab = 2").count() == 1
    assert together.associated(df.limit(0)).count() == 0
