"""Ranked-list measures on the worked examples, and properties of them."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.operators import ranking as R


def _list(spark, hits):
    return spark.createDataFrame([("q", i, float(-i), h) for i, h in enumerate(hits)], "q string, no int, score double, hit int")


def _order():
    return [F.col("score").desc(), F.col("no")]


def test_worked_example(spark):
    run = R.running(_list(spark, [1, 0, 1, 0]), ["q"], _order(), "hit", F.lit(3))
    got = run.orderBy("rnk").collect()
    assert [round(r.precision, 4) for r in got] == [1, 0.5, 0.6667, 0.5] and [round(r.recall, 4) for r in got] == [0.3333, 0.3333, 0.6667, 0.6667]
    gold = spark.createDataFrame([("q", 3), ("never", 2), ("none", 0)], "q string, n_gold bigint")
    assert {r.q: round(r.ap, 4) for r in R.average_precision(run, ["q"], "hit", gold).collect()} == {"q": 0.5556, "never": 0.0, "none": 0.0}
    p = {r.level: round(r.precision, 4) for r in R.interpolated(run, ["q"]).collect()}
    assert (p[0], p[3], p[5], p[7]) == (1.0, 1.0, 0.6667, 0.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hits=st.lists(st.sampled_from([0, 1, None]), min_size=1, max_size=12))
def test_properties(spark, hits):
    run = R.running(_list(spark, hits), ["q"], _order(), "hit")
    got = run.orderBy("rnk").collect()
    assert all(a.recall <= b.recall + 1e-12 for a, b in zip(got, got[1:])) and all(0 <= r.precision <= 1 for r in got)
    p = [r.precision for r in R.interpolated(run, ["q"]).orderBy("level").collect()]
    assert all(a >= b - 1e-12 for a, b in zip(p, p[1:]))


def test_upper_median(spark):
    df = spark.createDataFrame([("q", r) for r in (1, 2, 4, 9)], "q string, r int")
    got = R.rank_summary(df, ["q"], "r").first()
    assert (got.mean_rank, got.median_rank) == (4.0, 4)


def test_class_metrics(spark):
    df = spark.createDataFrame(list(zip([1, 1, 2, 0], [1, 2, 2, 1])), "t int, p int")
    m = R.class_metrics(df, "t", "p")
    got = {r.cls: (r.actual, r.predicted, r.correct, r.precision, r.recall, round(r.f1, 4)) for r in m.collect()}
    assert got == {1: (2, 2, 1, 0.5, 0.5, 0.5), 2: (1, 2, 1, 0.5, 1.0, 0.6667), 0: (1, 0, 0, 0.0, 0.0, 0.0)}
    c = R.cumulative_metrics(m, [F.when(F.col("cls") == 0, 9).otherwise(F.col("cls"))]).collect()
    assert [(r.cum_correct, r.cum_predicted, r.cum_actual) for r in c] == [(1, 2, 2), (2, 4, 3), (2, 4, 4)]
    assert [round(r.micro_p, 4) for r in c] == [0.5] * 3 and [round(r.micro_r, 4) for r in c] == [0.5, 0.6667, 0.5] and [round(r.macro_p, 4) for r in c] == [0.5, 0.5, 0.3333]
    assert R.class_metrics(df.limit(0), "t", "p").count() == 0


def test_global_ranks(spark):
    df = spark.range(1000).select(F.col("id"), F.pmod(F.col("id") * 37, F.lit(10)).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("h"))
    got = R.global_ranks(df, [F.col("s").desc(), F.col("id")], "h").collect()
    want = sorted(df.collect(), key=lambda r: (-r.s, r.id))
    hits = 0
    rank = {r.id: (r.rnk, r.hits) for r in got}
    for i, r in enumerate(want, 1):
        hits += r.h
        assert rank[r.id] == (i, hits)


def test_same_for_any_partitioning(spark):
    df = _list(spark, [1, 0, 1, 1, 0, 1])
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = [tuple(r) for r in R.running(df, ["q"], _order(), "hit").orderBy("rnk").collect()]
        assert n == 1 or got == first
        first = got
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_confusion_and_best(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.8, 0.0), (0.2, 1.0), (0.1, 0.0), (None, 1.0), (float("nan"), 1.0)], "s double, g double")
    got = R.confusion(df, [], "s", "g", 0.5).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (1, 1, 1, 1)
    b = spark.createDataFrame([("t", "NA", 0.9), ("t", "r", 0.5), ("u", "NA", 0.1), ("u", "r", 0.5), ("v", "NA", 1.0)], "k string, l string, s double")
    assert {r.k: r.s for r in R.best_labels(b, ["k"], "l", "s", "NA").collect()} == {"t": -0.5, "u": 0.5}


def test_arrays(spark):
    v = F.array(*[F.lit(x) for x in (0.5, 2.0, 2.0, 1.0)])
    r = spark.range(1).select(R.argmax(v).alias("a"), R.top_of_array(v, 2).alias("t"), R.softmax(v).alias("s")).first()
    assert r.a == 1 and [x.place for x in r.t] == [1, 2] and abs(sum(r.s) - 1) < 1e-9
