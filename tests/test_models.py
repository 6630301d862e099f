"""Models: gradients against differences, falling loss, better than chance on held-out cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.models import baseline, factor, lbfgs
from factloom.operators import ranking as R
from factloom.operators import sampling
from factloom.plans import fits


@pytest.fixture(scope="module")
def blocks(spark):
    """Tuples of two kinds, each with its own four relations; one cell of each tuple is held out."""
    seen, held = [], []
    for t in range(24):
        own = [f"{'REL$' if r == 0 else 'path#'}{t % 2}{r}" for r in range(4)]
        for r in own:
            (held if r == own[t // 2 % 4] else seen).append((r, f"a{t}", f"b{t}"))
    return spark.createDataFrame(seen, "relation string, arg1 string, arg2 string"), held


def _ap(spark, params, cfg, train, held):
    rels = sorted({r for r, _, _ in held})
    rows = [(r, a, b, int((r, a, b) in set(held))) for _, a, b in held for r in rels]
    rows = [r for r in rows if r[:3] not in {tuple(x) for x in train.collect()}]
    out = factor.predict(spark.createDataFrame(rows, "relation string, arg1 string, arg2 string, hit int"), params, cfg, train)
    run = R.running(out.withColumn("q", F.lit("q")), ["q"], [F.col("score").desc(), F.col("relation"), F.col("arg1")], "hit")
    return run.filter("hit = 1").agg(F.avg("precision")).first()[0], sum(r[3] for r in rows) / len(rows)


@pytest.mark.parametrize("parts,pairs,epochs", [("F", "bpr", 8), ("NF", "bpr", 5), ("FE", "ent", 5), ("F", "inv", 9)])
def test_ranking_fit(spark, blocks, parts, pairs, epochs):
    """Each epoch draws other pairs, so losses fall over epochs but not in each."""
    train, held = blocks
    cfg = factor.Config(parts, 4, epochs=epochs, rate=0.8, pairs=pairs, patience=10)
    params, losses = factor.fit(train, cfg)
    assert len(losses) == epochs and losses[-1] < losses[0]
    if pairs == "bpr" and "N" in parts:
        ap, chance = _ap(spark, params, cfg, train, held)
        assert ap > 1.3 * chance


def test_pointwise_fit(spark, blocks):
    train, held = blocks
    neg = train.select(F.when(F.substring("relation", -2, 1) == "0", F.regexp_replace("relation", "0(.)$", "1$1")).otherwise(F.regexp_replace("relation", "1(.)$", "0$1")).alias("relation"), "arg1", "arg2", F.lit(0.0).alias("target"))
    params, losses = factor.fit_pointwise(train.withColumn("target", F.lit(1.0)).unionByName(neg), factor.Config("F", 3, epochs=5, rate=1.0))
    assert losses[-1] < losses[0]
    assert set(r.kind for r in params.select("kind").distinct().collect()) == {"bias", "rel", "tup"}
    assert factor.top_of_components(params, "rel", 1).count() <= 6


def test_empty_fit(spark, blocks):
    params, losses = factor.fit(blocks[0].limit(0), factor.Config("F", 2, epochs=1))
    assert params.count() == 0 and losses == [0.0]


def test_gradient_by_differences(spark):
    """Score gradients of a 3 x 3 matrix as the training step sees them."""
    rng = np.random.default_rng(0)
    r, t = rng.normal(size=(3, 2)), rng.normal(size=(3, 2))
    params = spark.createDataFrame(
        [("rel", f"r{i}", [float(x) for x in r[i]]) for i in range(3)] + [("tup", f"a{i}\u0001b", [float(x) for x in t[i]]) for i in range(3)] + [("bias", f"r{i}", [0.1]) for i in range(3)], "kind string, key string, vec array<double>"
    )
    cfg = factor.Config("F", 2)
    cells = spark.createDataFrame([(f"r{i}", f"a{j}", "b") for i in range(3) for j in range(3)], "relation string, arg1 string, arg2 string")
    s = factor.with_scores(cells, params, cfg, None).withColumn("g", F.lit(1.0))
    got = {(x.kind, x.key): x.g for x in factor._gradients(s, "g", cfg).groupBy("kind", "key").agg(F.array(F.sum(F.col("grad")[0]), F.sum(F.get("grad", F.lit(1)))).alias("g")).collect()}
    total = lambda r, t: float((r @ t.T).sum())
    for i in range(3):
        for k in range(2):
            e = np.zeros((3, 2))
            e[i, k] = 1e-6
            assert abs((total(r + e, t) - total(r, t)) / 1e-6 - got[("rel", f"r{i}")][k]) < 1e-4
            assert abs((total(r, t + e) - total(r, t)) / 1e-6 - got[("tup", f"a{i}\u0001b")][k]) < 1e-4


def test_minimise():
    a = np.diag([1.0, 10.0, 100.0])
    x, values = lbfgs.minimise(lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1), np.zeros(3), tolerance=1e-9)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-3) and all(u >= v - 1e-12 for u, v in zip(values, values[1:]))


def test_logistic_factors(spark):
    cells = spark.createDataFrame([(i, j, float((i + j) % 2)) for i in range(4) for j in range(6)], "rel int, tup int, target double")
    b, r, t, values = lbfgs.logistic_factors(cells, 4, 6, 2, l2=0.001, rounds=40)
    z = b[:, None] + r @ t.T
    assert values[-1] < values[0] / 2 and all((z[i, j] > 0) == ((i + j) % 2 == 1) for i in range(4) for j in range(6))
    with pytest.raises(ValueError):
        lbfgs.logistic_factors(cells, 4, 10**9, 2)


def test_baseline(spark):
    df = spark.createDataFrame([(f"good fine {i}", "P") for i in range(20)] + [(f"bad poor {i}", "N") for i in range(20)], "s string, y string")
    out = baseline.train_and_predict(df, df.union(spark.createDataFrame([(None, None), ("", "P")], df.schema)), "s", "y", 256)
    assert out.count() == 42 and out.filter("y = predicted").count() >= 40


def test_save(spark, tmp_path):
    p = spark.createDataFrame([("rel", "a", [1.0]), ("tup", "b", [2.0])], "kind string, key string, vec array<double>")
    factor.save(p, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("kind = 'rel'").count() == 1


@pytest.mark.parametrize("mode", ["bpr-all", "bpr-row", "bpr-tensor", "sgd-dynamic"])
def test_modes(spark, blocks, mode):
    train, _ = blocks
    cells = train.withColumn("target", F.lit(1.0)) if mode.startswith("sgd") else train
    cfg = factor.Config("FTB", 3, epochs=3, rate=0.5, phases=factor.THREE_PHASES, patience=9)
    params, losses = factor.train(cells, cfg, mode)
    assert len(losses) == 3 and all(np.isfinite(losses)) and set(r.kind for r in params.select("kind").distinct().collect()) == {"bias", "rel", "tup", "src", "dst", "any"}
    with pytest.raises(ValueError):
        factor.train(cells, cfg, "none")


def test_draws(spark, blocks):
    train, _ = blocks
    seen = {tuple(r) for r in train.collect()}
    for pairs, check in {
        "tensor": lambda r: (r.other != r.relation) + (r.b1 != r.a1) + (r.b2 != r.a2) == 1,
        "all": lambda r: r.other is not None,
        "row": lambda r: r.other is None or (r.b1, r.b2) == (r.a1, r.a2),
    }.items():
        rows = factor.training_pairs(train, factor.Config("F", 2, pairs=pairs), 0).collect()
        assert rows and all(check(r) and (r.other, r.b1, r.b2) not in seen and (r.relation, r.a1, r.a2) in seen for r in rows)
    half = factor.training_pairs(train, factor.Config("F", 2, pairs="row"), 0).filter("other is null").count()
    assert 0.3 * len(seen) < half < 0.7 * len(seen)


def test_phases_leave_parameters(spark, blocks):
    train, _ = blocks
    cfg = factor.Config("T", 2, epochs=1, phases=(("src",),))
    start = {(r.kind, r.key): r.vec for r in factor.initial(train, cfg).collect()}
    params, _ = factor.fit(train, cfg)
    moved = {r.kind for r in params.collect() if r.vec != start[(r.kind, r.key)]}
    assert "src" not in moved and {"rel", "dst"} <= moved


def test_resume_and_sweep(spark, blocks, tmp_path):
    train, held = blocks
    cfg = factor.Config("F", 2, epochs=4, rate=0.5, patience=9)
    whole, losses = factor.fit(train, cfg, folder=str(tmp_path / "a"))
    factor.fit(train, factor.Config("F", 2, epochs=2, rate=0.5, patience=9), folder=str(tmp_path / "b"))
    again, more = factor.fit(train, cfg, folder=str(tmp_path / "b"))
    assert np.allclose(losses, more)
    rows = lambda p: {(r.kind, r.key): tuple(round(x, 9) for x in r.vec) for r in p.collect()}
    assert rows(whole) == rows(again)
    v = spark.createDataFrame([(*h, 1.0) for h in held], "relation string, arg1 string, arg2 string, target double")
    got = factor.sweep(train, {"x": factor.Config("F", 2, epochs=2), "y": factor.Config("F", 2, epochs=1, decay_on_rise=True, decay=0.5)}, v, str(tmp_path / "s")).collect()
    assert [(r.name, r.epoch) for r in got] == [("x", 0), ("x", 1), ("y", 0)]


def test_partial_gradients_are_added_by_tasks(spark):
    """More partitions than the driver adds by itself."""
    cells = spark.createDataFrame([(i, j, float((i + j) % 2)) for i in range(4) for j in range(6)], "rel int, tup int, target double")
    a = lbfgs.logistic_factors(cells.repartition(20), 4, 6, 2, l2=0.001, rounds=3)
    b = lbfgs.logistic_factors(cells.coalesce(1), 4, 6, 2, l2=0.001, rounds=3)
    assert np.allclose(a[3], b[3])


def test_factors_in_blocks(spark, blocks, monkeypatch):
    """More parameters than the driver holds are fitted in blocks, by the same steps and to the same predictions."""
    cells = spark.createDataFrame([(i, j, float((i + j) % 2)) for i in range(5) for j in range(7)], "rel int, tup int, target double")
    monkeypatch.setattr(lbfgs, "BLOCK", 9)
    vr, vt, values = lbfgs.factors_apart(cells, 5, 7, 2, l2=0.001, rounds=7)
    vr, vt = vr.orderBy("_rel").collect(), vt.orderBy("_tup").collect()
    r, b, t = np.array([x._vr for x in vr]), np.array([x.b for x in vr]), np.array([x._vt for x in vt])
    assert r.shape == (5, 2) and t.shape == (7, 2)
    # the same start, minimised in one vector
    start = np.concatenate([np.zeros(5), lbfgs._normal(0, np.arange(5), 2).ravel(), lbfgs._normal(1, np.arange(7), 2).ravel()])
    y = np.array([[float((i + j) % 2) for j in range(7)] for i in range(5)])

    def value_gradient(x):
        bb, rr, tt = x[:5], x[5:15].reshape(5, 2), x[15:].reshape(7, 2)
        z = bb[:, None] + rr @ tt.T
        g = 1 / (1 + np.exp(-z)) - y
        return float((np.logaddexp(0, z) - y * z).sum()) + 0.0005 * float(x @ x), np.concatenate([g.sum(1), (g @ tt).ravel(), (g.T @ rr).ravel()]) + 0.001 * x

    x, want = lbfgs.minimise(value_gradient, start, rounds=7)
    assert len(values) > 6 and np.allclose(values, want)
    assert np.allclose(b, x[:5]) and np.allclose(r.ravel(), x[5:15]) and np.allclose(t.ravel(), x[15:])
    # a fit beyond the bound gives every cell its probability
    train, held = blocks
    both = train.withColumn("target", F.lit(1.0)).unionByName(train.selectExpr("concat(relation, '-') relation", "arg1", "arg2", "0.0D target"))
    rows = spark.createDataFrame([(*h, 1.0) for h in held], both.schema)
    inside = {tuple(x)[:3]: x.prob for x in lbfgs.fit_cells(both, rows, components=3, rounds=1).collect()}
    monkeypatch.setattr(lbfgs, "MAX_PARAMETERS", 10)
    beyond = {tuple(x)[:3]: x.prob for x in lbfgs.fit_cells(both, rows, components=3, rounds=1).collect()}
    assert inside.keys() == beyond.keys() == set(held) and all(abs(inside[h] - beyond[h]) < 0.1 for h in held)


def test_slices_of_components(spark, blocks, monkeypatch):
    """A pointwise fit by slices of components takes the same steps, and no row is written with whole vectors."""
    train, _ = blocks
    cfg = factor.Config("FTB", 5, epochs=1, rate=0.5)
    cells = train.withColumn("target", F.lit(1.0))
    fitted = lambda: (lambda p, x: ({(r.kind, r.key): r.vec for r in p.collect()}, x))(*factor.fit_pointwise(cells, cfg, True))
    whole, losses = fitted()
    monkeypatch.setattr(factor, "SLICE", 2)
    written, settled = [], factor.settled
    monkeypatch.setattr(factor, "settled", lambda df, name: (written.append(df.columns), settled(df, name))[1])
    got, more = fitted()
    assert np.allclose(losses, more) and got.keys() == whole.keys() and all(np.allclose(got[k], whole[k]) for k in whole)
    assert not any(c.startswith("v_") for columns in written for c in columns)


def test_held_cells_in_blocks(spark, monkeypatch):
    """Held cells are scored in the blocks of their tuples, as the minimum of one vector scores them; unknown relations and tuples too."""
    monkeypatch.setattr(lbfgs, "BLOCK", 9)
    monkeypatch.setattr(lbfgs, "BIG", 3)
    tups = [7, -3, 1 << 61, 12, 13]
    y = {(i, j): float((i * j) % 3 == 0) for i in range(4) for j in range(4) if (i, j) != (3, 2)} | {(3, 0): 1.0}
    rows = [(i, tups[j], v, False) for (i, j), v in y.items()] + [(3, tups[2], 1.0, True), (None, tups[1], 0.0, True), (2, tups[4], 1.0, True), (None, tups[4], 0.0, True)]
    cells = spark.createDataFrame(rows, "rel int, tup bigint, target double, held boolean")
    got = lbfgs.held_out(cells, 4, 5, len(rows), 2, 5, lambda out: out, l2=0.1)
    start = np.concatenate([np.zeros(4), lbfgs._normal(0, np.arange(4), 2).ravel(), lbfgs._normal(1, np.array(tups[:4]), 2).ravel()])
    i, j = (np.array(x) for x in zip(*y))
    v = np.array(list(y.values()))

    def value_gradient(x):
        r, t, out = x[4:12].reshape(4, 2), x[12:].reshape(4, 2), 0.1 * x
        z = x[i] + (r[i] * t[j]).sum(1)
        g = 1 / (1 + np.exp(-z)) - v
        np.add.at(out, i, g)
        np.add.at(out[4:12].reshape(4, 2), i, g[:, None] * t[j])
        np.add.at(out[12:].reshape(4, 2), j, g[:, None] * r[i])
        return float((np.logaddexp(0, z) - v * z).sum()) + 0.05 * float(x @ x), out

    x, _ = lbfgs.minimise(value_gradient, start, rounds=5)
    known = x[3] + x[4:12].reshape(4, 2)[3] @ x[12:].reshape(4, 2)[2]
    want = sorted([(1.0, 1 / (1 + np.exp(-known))), (0.0, 0.5), (1.0, 1 / (1 + np.exp(-x[2]))), (0.0, 0.5)])
    assert np.allclose(sorted(tuple(r) for r in got.collect()), want, atol=1e-5)


def test_toy_run_keeps_no_parameters_in_the_driver(spark, tmp_path, monkeypatch):
    """One hidden right cell of each tuple and half of the drawn negatives are judged, and no vector of all parameters is made, at any size."""
    rows = [(f"{'REL$' if r < 2 else 'path#'}{t % 3}{r}", f"a{t}", f"b{t}", 1.0) for t in range(30) for r in range(3)] + [("REL$00", "a0", None, 1.0), ("path#9", "x", "y", 0.0)]
    spark.createDataFrame(rows, "relation string, arg1 string, arg2 string, gold double").write.parquet(str(tmp_path / "cells.parquet"))

    def refuse(*_, **__):
        raise AssertionError("all parameters in the driver")

    monkeypatch.setattr(lbfgs, "logistic_factors", refuse)
    out = fits.toy_run(spark, str(tmp_path)).collect()
    draws = spark.createDataFrame(rows[:90], "relation string, arg1 string, arg2 string, gold double")
    rels = spark.createDataFrame([(r, i) for i, r in enumerate(sorted({x[0] for x in rows if x[0].startswith("REL$")}))], "rel string, idx bigint")
    neg = sampling.negatives(draws, rels, 6, F.pmod(F.xxhash64("arg1", "arg2"), F.lit(1 << 30))).filter(F.pmod(F.xxhash64("relation", "arg1", "arg2"), F.lit(2)) == 0)
    assert len(out) == 1 and out[0].tp + out[0].fn == 30 and out[0].tn + out[0].fp == neg.count() > 0
