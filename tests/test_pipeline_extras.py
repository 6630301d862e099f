"""Runs with stages, and the smaller functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from factloom import pipeline
from factloom.functions import paths, scoring, text
from factloom.models import factor


def test_layers():
    assert pipeline.layered({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}, {"b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}


def test_run(spark, tmp_path):
    """[M18] A small end-to-end run: load, fit, score; a second run reads what is there."""
    built = []

    def cells(s, t):
        built.append("cells")
        return spark.createDataFrame([(f"r{i % 2}", f"a{i}", "b") for i in range(8)], "relation string, arg1 string, arg2 string")

    def scores(s, t):
        built.append("scores")
        cfg = factor.Config(**s["model"])
        return factor.predict(t["cells"], factor.fit(t["cells"], cfg)[0], cfg)

    run = lambda **on: pipeline.Run(spark, str(tmp_path), pipeline.layered({"model": {"parts": "F", "components": 2, "epochs": 1}}, {"stages": on})).stage("cells", cells).stage("scores", scores)
    assert set(run(scores=False)()) == {"cells"}
    assert run()()["scores"].count() == 8 and built == ["cells", "scores"]
    run()()
    assert built == ["cells", "scores"] and '"epochs": 1' in run().describe()


def test_projection(spark):
    df = spark.createDataFrame([("g", 2.0), ("g", 1.0), ("g", 3.0), ("h", -3.0), ("h", -2.0)], "g string, x double")
    out = factor.at_most(df, ["g"], "x", 1.0, 20).groupBy("g").agg(F.sum(scoring.sigmoid(F.col("projected"))).alias("e"), F.max("multiplier").alias("m")).collect()
    got = {r.g: r for r in out}
    assert abs(got["g"].e - 1) < 1e-3 and got["h"].m == 0.0


def test_mean_target(spark):
    t = lambda a, b: spark.range(1).select(scoring.mean_target_term(F.lit(a), F.lit(b))).first()[0]
    assert t(0.3, 0.3) == 0.0 and abs(t(0.5, 0.25) - (0.5 * math.log(0.5) + 0.5 * math.log(1.5))) < 1e-12 and math.isfinite(t(1.0, 0.0))
    x, h = 0.4, 1e-6
    p = 1 / (1 + math.exp(-x))
    g = spark.range(1).select(scoring.mean_target_gradient(F.lit(0.8), F.lit(p), F.lit(p), F.lit(1))).first()[0]
    assert abs((t(0.8, 1 / (1 + math.exp(-x - h))) - t(0.8, p)) / h - g) < 1e-4


def test_surface():
    words, ner, head = ["IBM", "and", "Big", "Blue", "met", "Blue"], ["ORG", "O", "ORG", "ORG", "O", "ORG"], [4, 0, 3, 4, -1, 4]
    assert paths.surface_spans("Big Blue", words, ner, head) == [(2, 4), (3, 4), (5, 6)]
    assert paths.surface_spans("International Business Machines", words, ner, head) == [(0, 1)]
    assert paths.nearest_surface_span("Big Blue", words, ner, head, (0, 1)) == (2, 4)
    assert paths.nearest_surface_span("Nobody", words, ner, head, (0, 1)) is None and paths.surface_spans("", [None], [None], [None]) == []


def test_strings(spark):
    df = spark.createDataFrame([("0.5:REL$/a:b",), ("x:y",), ("none",), (None,)], "s string")
    s, l = text.score_label(F.col("s"))
    assert [tuple(r) for r in df.select(s, l).collect()] == [(0.5, "REL$/a:b"), (None, "y"), (None, None), (None, None)]
    phrase = lambda r: spark.range(1).select(text.relation_phrase(F.lit(r))).first()[0]
    assert [phrase(r) for r in ("REL$/people/person/place_of_birth", "REL$/people/person/place_of_rest", None)] == ["was born in", "place of rest", None]
    said = lambda r: spark.range(1).select(text.relation_sentence(F.lit("A"), F.lit(r), F.lit("B"))).first()[0]
    assert [said(r) for r in ("REL$/location/country/capital", "REL$/book/author/works_written")] == ["A's capital is B", "A wrote B"]


def test_experiments_and_rate():
    e = pipeline.experiments()
    assert len(e) == 20 and e["mix0-keep80"] == {"loss_mix": 0.0, "keep": 0.8} and e["mix9-keep100"] == {"loss_mix": 0.9, "keep": 1.0}
    assert pipeline.learning_rate(1.0, 0.5, [3, 2, 1]) == 1.0 and pipeline.learning_rate(1.0, 0.5, [3, 2, 1, 4, 1, 5]) == 0.25
