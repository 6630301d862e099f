"""Queries of ranked lists and their measures.

The lists are the scored label cells of the matrix: one list for each relation (the pattern), ranked by score; a cell is right if its
gold is above one half. A second system ranks the same cells by another score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import ranking as R
from ..session import settled
from ..sources import sinks
from ..sources.tables import table



def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("cell_id").asc()]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cells").filter(F.col("relation").startswith("REL$") & F.col("predicted").isNotNull() & ~F.isnan("predicted"))
    return c.select("cell_id", "relation", "arg1", "arg2", "hide", F.col("predicted").alias("score"), (F.col("gold") > 0.5).cast("int").alias("hit"))


def _systems(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    second = F.round((F.col("score") * 7 + F.pmod("cell_id", F.lit(10))) / 16, 6)
    return s.select(F.lit("A").alias("system"), "*").unionByName(s.withColumn("score", second).select(F.lit("B").alias("system"), "*"))


def _run(spark: SparkSession, d: str) -> DataFrame:
    return R.running(_systems(spark, d), ["system", "relation"], _order(), "hit")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def ranked_predictions(spark: SparkSession, d: str) -> DataFrame:
    """[O1, K3] All scored cells in one list, by ranges, with the right ones counted down the list."""
    return R.global_ranks(_scored(spark, d), _order(), "hit").select("cell_id", F.col("rnk").cast("long").alias("rnk"), F.col("hits").cast("long").alias("hits"))


def running_pr(spark: SparkSession, d: str) -> DataFrame:
    """[W1] Running precision and recall of each relation's list."""
    return R.running(_scored(spark, d), ["relation"], _order(), "hit").select("relation", "cell_id", "rnk", "tp", "precision", "recall")


def pool_topk(spark: SparkSession, d: str) -> DataFrame:
    """[O2, U4] Facts among the first hundred of either system."""
    return R.pool(_systems(spark, d), ["relation"], ["arg1", "arg2"], _order(), 100, "system")


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """[W5] Average precision of each system and relation."""
    run = _run(spark, d)
    gold = _systems(spark, d).groupBy("system", "relation").agg(F.sum("hit").alias("n_gold"))
    return _rounded(R.average_precision(run, ["system", "relation"], "hit", gold), "ap")


def map_systems(spark: SparkSession, d: str) -> DataFrame:
    """[A22] Mean and weighted mean of the average precisions."""
    return _rounded(R.mean_average_precision(average_precision(spark, d), ["system"]), "map", "weighted_map")


def interp_11pt(spark: SparkSession, d: str) -> DataFrame:
    """[W6, W7] Eleven-point interpolated precision, averaged over relations."""
    p = R.interpolated(_run(spark, d), ["system", "relation"], depth=1000)
    return _rounded(p.groupBy("system", "level").agg(F.avg("precision").alias("precision")), "precision")


def precision_envelope(spark: SparkSession, d: str) -> DataFrame:
    """[W7] Highest precision from each place on."""
    run = R.running(_scored(spark, d), ["relation"], _order(), "hit")
    return R.precision_envelope(run, ["relation"]).select("relation", "cell_id", "envelope")


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    """[W8] Precision at 50, 100, 200, 300 and 400."""
    return R.precision_at(_run(spark, d), ["system", "relation"], [50, 100, 200, 300, 400])


def unjudged_labels(spark: SparkSession, d: str) -> DataFrame:
    """[W8] How many of the first 400 facts of each list the KB hasn't judged."""
    kb = table(spark, d, "kb_relations").select(F.concat(F.lit("REL$"), "reltype").alias("relation"), F.col("sourceguid").alias("arg1"), F.col("destguid").alias("arg2"), F.lit(1).alias("judged")).distinct()
    s = _scored(spark, d).join(kb, ["relation", "arg1", "arg2"], "left")
    return R.unjudged(R.running(s, ["relation"], _order(), "judged"), ["relation"], "judged", 400)


def best_f1(spark: SparkSession, d: str) -> DataFrame:
    """[A17, A18, W11] Best F1 and area of each list."""
    r = R.by_type(_run(spark, d), ["system", "relation"]).select("system", "relation", "rnk", "tp", "precision", "recall", "f1", "area", "n")
    return _rounded(r, "precision", "recall", "f1", "area")


def pooled_f1(spark: SparkSession, d: str) -> DataFrame:
    """[A18] Measures of all relations together at their best places."""
    t = R.best_f1(R.running(_scored(spark, d), ["relation"], _order(), "hit"), ["relation"])
    gold = _scored(spark, d).groupBy("relation").agg(F.sum("hit").alias("n_gold"))
    return _rounded(R.pooled_f1(t.join(gold, "relation")), "precision", "recall", "f1")


def last_hit(spark: SparkSession, d: str) -> DataFrame:
    """[W10] Mean precision at the right facts, down to the last."""
    return _rounded(R.until_last_hit(_run(spark, d), ["system", "relation"], "hit"), "ap")


def heldout_rank(spark: SparkSession, d: str) -> DataFrame:
    """[W4] Ranks of hidden facts among their tuple's candidates."""
    c = table(spark, d, "cells").filter("predicted is not null and not isnan(predicted)").select("cell_id", "relation", "arg1", "arg2", "hide", F.col("predicted").alias("score"))
    return R.heldout_ranks(c, ["arg1", "arg2"], "score", "hide", "cell_id").select("cell_id", "rnk")


def rank_by_type(spark: SparkSession, d: str) -> DataFrame:
    """[A19] Mean and median of hidden facts' ranks by relation."""
    c = table(spark, d, "cells").filter("predicted is not null and not isnan(predicted)").select("cell_id", "relation", "arg1", "hide", F.col("predicted").alias("score"))
    r = R.heldout_ranks(c, ["arg1"], "score", "hide", "cell_id")
    return _rounded(R.rank_summary(r, ["relation"], "rnk"), "mean_rank")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    """[A14] Confusion counts of hidden cells at one half."""
    return _rounded(R.confusion(table(spark, d, "cells").filter("hide"), [], "predicted", "gold", 0.5), "precision", "recall")


def _predicted_labels(spark: SparkSession, d: str) -> DataFrame:
    t = F.upper(F.trim("labels"))
    return table(spark, d, "corpus_records").select(t.alias("truth"), F.when(F.pmod("rec_id", F.lit(7)) == 0, F.lit("NEGATIVE")).when(F.pmod("rec_id", F.lit(11)) == 0, F.lit("POSITIVE")).otherwise(t).alias("predicted"))


def class_prf(spark: SparkSession, d: str) -> DataFrame:
    """[A15, A16] Measures of each label."""
    return _rounded(R.class_metrics(_predicted_labels(spark, d), "truth", "predicted"), "precision", "recall", "f1")


def micro_macro_cum(spark: SparkSession, d: str) -> DataFrame:
    """[W2, W3] Micro and macro measures over the labels in order."""
    m = R.class_metrics(_predicted_labels(spark, d), "truth", "predicted")
    out = R.cumulative_metrics(m, [F.col("cls")]).select("cls", "cum_actual", "cum_predicted", "cum_correct", "micro_p", "micro_r", "micro_f1", "macro_p", "macro_r", "macro_f1")
    return _rounded(out, "micro_p", "micro_r", "micro_f1", "macro_p", "macro_r", "macro_f1")


def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """[W9] Days whose error rate is above the four before."""
    c = table(spark, d, "cells").filter("predicted is not null and not isnan(predicted) and scored_at is not null")
    day = c.groupBy(F.date_trunc("month", F.col("scored_at").cast("timestamp_ntz")).cast("timestamp_ntz").alias("step")).agg(F.round(F.avg(F.abs(F.col("predicted") - F.col("gold"))), 9).alias("cost"))
    return R.early_stop(day, "step", "cost")


def top3_dims(spark: SparkSession, d: str) -> DataFrame:
    """[O4, O5] The three largest dimensions of each embedding, and the largest."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    t = e.select("vec_id", R.argmax(F.col("v")).alias("best"), R.top_of_array(F.col("v"), 3).alias("t"))
    return t.select("vec_id", "best", F.array_join(F.transform("t", lambda x: x["place"].cast("string")), ",").alias("places"))


def softmax_top(spark: SparkSession, d: str) -> DataFrame:
    """[O4] Softmax share of the largest dimension."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", F.round(F.array_max(R.softmax(F.col("v"))), 6).alias("share"))


def best_labels(spark: SparkSession, d: str) -> DataFrame:
    """[O6] Best label of each tuple, less one where the most frequent label scores higher."""
    s = _scored(spark, d)
    return _rounded(R.best_labels(s, ["arg1", "arg2"], "relation", "score", "REL$/music/league/part_held"), "score")


def rank_diff(spark: SparkSession, d: str) -> DataFrame:
    """[O8, J22] Places of facts in both systems' first thousand."""
    s = _systems(spark, d)
    top = lambda x: R.top_k(s.filter(F.col("system") == x), ["relation"], _order(), 1000)
    return R.rank_differences(top("A"), top("B"), ["relation", "cell_id"], "rnk", 1000)


def dropped_to_zero(spark: SparkSession, d: str) -> DataFrame:
    """[O9] Scores of tuples without an open pattern cell become 0."""
    seen = table(spark, d, "cells").filter(F.col("relation").startswith("path#") & ~F.col("hide"))
    s = _scored(spark, d).filter("arg2 is not null")
    return R.drop_to_zero(s, seen, ["arg1", "arg2"], "score").select("cell_id", "score")


def two_best_lines(spark: SparkSession, d: str) -> DataFrame:
    """[O10] Both scores of each cell as lines of their own."""
    s = _scored(spark, d).select("cell_id", F.lit("score").alias("l1"), F.col("score").alias("s1"), F.lit("complement").alias("l2"), F.round(1 - F.col("score"), 6).alias("s2"))
    return R.two_best_lines(s, ["cell_id"], ("l1", "s1"), ("l2", "s2"))


def restricted_ranks(spark: SparkSession, d: str) -> DataFrame:
    """[P9] Cells of KB pairs, their labels in full."""
    kb = table(spark, d, "kb_relations").select(F.col("sourceguid").alias("arg1"), F.col("destguid").alias("arg2"))
    s = _scored(spark, d).withColumn("relation", F.substring("relation", 5, 1000))
    return R.restricted(s, kb, ["arg1", "arg2"], "relation").select("cell_id", "relation")


def to_annotate(spark: SparkSession, d: str) -> DataFrame:
    """[J24] The first fifty cells of each relation that the KB hasn't judged."""
    kb = table(spark, d, "kb_relations").select(F.concat(F.lit("REL$"), "reltype").alias("relation"), F.col("sourceguid").alias("arg1"), F.col("destguid").alias("arg2"))
    return R.to_annotate(R.top_k(_scored(spark, d), ["relation"], _order(), 50), kb, ["relation", "arg1", "arg2"]).select("cell_id", "rnk")


def annotated_precision(spark: SparkSession, d: str) -> DataFrame:
    """[A26] Measures of each relation's list on judged facts only."""
    kb = table(spark, d, "kb_relations").select(F.concat(F.lit("REL$"), "reltype").alias("relation"), F.col("sourceguid").alias("arg1"), F.col("destguid").alias("arg2")).distinct()
    r = R.running(_scored(spark, d).join(kb, ["relation", "arg1", "arg2"], "left_semi"), ["relation"], _order(), "hit")
    g = r.groupBy("relation").agg(F.avg("precision").alias("mean_precision"), F.sum("hit").alias("correct"), F.count(F.lit(1)).alias("total"))
    return _rounded(g, "mean_precision")


def pattern_matches(spark: SparkSession, d: str) -> DataFrame:
    """Cells by the relation patterns that they match."""
    p = spark.createDataFrame([("born",), ("^REL\\$/(film|firm)/",), ("held$",)], "pattern string")
    return R.matching(table(spark, d, "cells").select("relation"), "relation", p).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def result_tables(spark: SparkSession, d: str) -> DataFrame:
    """[K11] Average precision of both systems by relation, as lines in three styles."""
    ap = settled(average_precision(spark, d), "ap")
    out = None
    for style in ("text", "latex", "gnuplot"):
        one = sinks.result_table(ap, "relation", "system", "ap", ["A", "B"], style).withColumn("style", F.lit(style))
        out = one if out is None else out.unionByName(one)
    return out


def sign_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether system A has the better average precisions."""
    ap = average_precision(spark, d).withColumnRenamed("relation", "pattern")
    return _rounded(R.compare_systems(ap, "A", "B"), "p")


def heldout_candidates(spark: SparkSession, d: str) -> DataFrame:
    """[O13, K4] Labels of tuples with a right hidden cell, all in one ranking by label frequency."""
    s = _scored(spark, d)
    tuples = s.filter("hide and hit = 1").select("arg1", "arg2").distinct()
    labels = s.groupBy("relation").agg(F.round(F.avg("score"), 6).alias("score"))
    every = tuples.crossJoin(labels)  # every label is asked of every tuple
    return R.ranked(every, ["arg1", "arg2"], [F.col("score").desc(), F.col("relation")])


def scored_cells(spark: SparkSession, d: str) -> DataFrame:
    """[F15, F16, A24] Score, probability and log-likelihood of cells under fixed vectors."""
    v = lambda c, s: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.pmod(c * i * 31 + s, F.lit(17)) - 8) / 10.0)
    c = table(spark, d, "cells").select("cell_id", "gold")
    x = c.select("cell_id", "gold", scoring.pair_score(v(F.col("cell_id"), 3), v(F.floor(F.col("cell_id") / 7), 5), F.lit(0.25)).alias("x"))
    return x.select("cell_id", F.round("x", 6).alias("score"), F.round(scoring.sigmoid(F.col("x")), 6).alias("prob"), F.round(scoring.log_likelihood(F.col("gold"), F.col("x")), 6).alias("ll"))


def tensor_scores(spark: SparkSession, d: str) -> DataFrame:
    """Three-way scores of embeddings with their neighbours in id."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(n, "vec_id").select("vec_id", F.round(scoring.tensor_score(F.col("v"), F.col("v"), F.col("w"), F.lit(0.5)), 4).alias("score"))


QUERIES = {f.__name__: f for f in (
    ranked_predictions, running_pr, pool_topk, average_precision, map_systems, interp_11pt, precision_envelope, precision_at_k, unjudged_labels, best_f1, pooled_f1, last_hit, heldout_rank, rank_by_type, confusion, class_prf,
    micro_macro_cum, early_stop, top3_dims, softmax_top, best_labels, rank_diff, dropped_to_zero, two_best_lines, restricted_ranks, to_annotate, annotated_precision, pattern_matches, result_tables, sign_test,
    heldout_candidates, scored_cells, tensor_scores,
)}

_S = "s AS (SELECT cell_id, relation, arg1, arg2, hide, predicted score, (gold > 0.5)::INTEGER hit FROM cells WHERE starts_with(relation, 'REL$') AND NOT isnan(predicted))"
_B = f"{_S}, b AS (SELECT 'A' system, * FROM s UNION ALL SELECT 'B', cell_id, relation, arg1, arg2, hide, round((score * 7 + cell_id % 10) / 16, 6), hit FROM s)"
_RUN = f"""{_B}, r AS (SELECT *, row_number() OVER w rnk, sum(hit) OVER w tp, sum(hit) OVER (PARTITION BY system, relation) n_gold FROM b WINDOW w AS (PARTITION BY system, relation ORDER BY score DESC, cell_id ROWS UNBOUNDED PRECEDING)),
    run AS (SELECT *, tp / rnk "precision", coalesce(tp / nullif(n_gold, 0), 0) recall FROM r)"""
_AP = f"{_RUN}, ap AS (SELECT system, relation, max(n_gold)::BIGINT n_gold, round(coalesce(sum(\"precision\") FILTER (hit = 1) / nullif(max(n_gold), 0), 0), 6) ap FROM run GROUP BY 1, 2)"
_CLS = """c AS (SELECT upper(trim(labels)) truth, CASE WHEN rec_id % 7 = 0 THEN 'NEGATIVE' WHEN rec_id % 11 = 0 THEN 'POSITIVE' ELSE upper(trim(labels)) END pred FROM corpus_records),
    l AS (SELECT truth cls, 1 a, 0 p, coalesce((truth = pred)::INTEGER, 0) c FROM c UNION ALL SELECT pred, 0, 1, 0 FROM c), g AS (SELECT cls, sum(a)::BIGINT actual, sum(p)::BIGINT predicted, sum(c)::BIGINT correct FROM l WHERE cls IS NOT NULL GROUP BY 1),
    m AS (SELECT *, coalesce(correct / nullif(predicted, 0), 0) pr, coalesce(correct / nullif(actual, 0), 0) re FROM g), k AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) f FROM m)"""
_F1 = "coalesce(2 * \"precision\" * recall / nullif(\"precision\" + recall, 0), 0)"

ORACLE = {
    "ranked_predictions": f"WITH {_S} SELECT cell_id, row_number() OVER w rnk, (sum(hit) OVER w)::BIGINT hits FROM s WINDOW w AS (ORDER BY score DESC, cell_id ROWS UNBOUNDED PRECEDING)",
    "running_pr": f"WITH {_RUN} SELECT relation, cell_id, rnk::INTEGER rnk, tp::BIGINT tp, \"precision\", recall FROM run WHERE system = 'A'",
    "pool_topk": f"WITH {_RUN} SELECT DISTINCT relation, arg1, arg2 FROM run WHERE rnk <= 100",
    "average_precision": f"WITH {_AP} SELECT * FROM ap",
    "map_systems": f"WITH {_AP} SELECT system, round(avg(ap), 6) AS \"map\", round(sum(ap * n_gold) / sum(n_gold), 6) weighted_map FROM ap GROUP BY 1",
    "interp_11pt": f"""WITH {_RUN}, v AS (SELECT system, relation, i::INTEGER lvl, CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE coalesce(max("precision") FILTER (rnk <= 1000 AND recall >= i / 10 - 1e-9), 0) END p FROM run, range(11) t(i) GROUP BY 1, 2, i)
        SELECT system, lvl AS "level", round(avg(p), 6) AS "precision" FROM v GROUP BY 1, 2""",
    "precision_envelope": f"WITH {_RUN} SELECT relation, cell_id, max(\"precision\") OVER (PARTITION BY relation ORDER BY rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) envelope FROM run WHERE system = 'A'",
    "precision_at_k": f"WITH {_RUN} SELECT system, relation, rnk::INTEGER k, \"precision\" FROM run WHERE rnk IN (50, 100, 200, 300, 400)",
    "unjudged_labels": f"""WITH {_S}, j AS (SELECT *, (relation, arg1, arg2) IN (SELECT ('REL$' || reltype, sourceguid, destguid) FROM kb_relations WHERE reltype IS NOT NULL AND sourceguid IS NOT NULL AND destguid IS NOT NULL) q, row_number() OVER (PARTITION BY relation ORDER BY score DESC, cell_id) r FROM s)
        SELECT relation, count(*) FILTER (r <= 400 AND NOT coalesce(q, false)) n_unjudged, least(count(*), 400) n FROM j GROUP BY 1""",
    "best_f1": f"""WITH {_RUN}, f AS (SELECT *, {_F1} f1 FROM run), x AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY system, relation ORDER BY round(f1, 12) DESC, rnk) = 1), a AS (SELECT system, relation, avg("precision") area, count(*) n FROM run GROUP BY 1, 2)
        SELECT system, relation, rnk::INTEGER rnk, tp::BIGINT tp, round("precision", 6) "precision", round(recall, 6) recall, round(f1, 6) f1, round(area, 6) area, n FROM x JOIN a USING (system, relation)""",
    "pooled_f1": f"""WITH {_RUN}, f AS (SELECT *, {_F1} f1 FROM run WHERE system = 'A'), x AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY relation ORDER BY round(f1, 12) DESC, rnk) = 1),
        t AS (SELECT sum(tp)::BIGINT tp, sum(rnk)::BIGINT n_pred, sum(n_gold)::BIGINT n_gold FROM x) SELECT tp, n_pred, n_gold, round(tp / n_pred, 6) "precision", round(tp / n_gold, 6) recall, round(2 * tp / (n_pred + n_gold), 6) f1 FROM t""",
    "last_hit": f"WITH {_RUN} SELECT system, relation, max(rnk)::INTEGER AS \"depth\", round(avg(\"precision\"), 6) ap FROM run WHERE hit = 1 GROUP BY 1, 2",
    "heldout_rank": """WITH c AS (SELECT *, min(predicted) FILTER (hide) OVER (PARTITION BY arg1, arg2) low FROM cells WHERE NOT isnan(predicted)),
        r AS (SELECT cell_id, hide, row_number() OVER (PARTITION BY arg1, arg2 ORDER BY predicted DESC, cell_id)::INTEGER rnk FROM c WHERE predicted >= low) SELECT cell_id, rnk FROM r WHERE hide""",
    "rank_by_type": """WITH c AS (SELECT *, min(predicted) FILTER (hide) OVER (PARTITION BY arg1) low FROM cells WHERE NOT isnan(predicted)),
        r AS (SELECT relation, hide, row_number() OVER (PARTITION BY arg1 ORDER BY predicted DESC, cell_id)::INTEGER rnk FROM c WHERE predicted >= low)
        SELECT relation, round(avg(rnk), 6) mean_rank, list_sort(list(rnk))[count(*) // 2 + 1] median_rank, count(*) n FROM r WHERE hide GROUP BY 1""",
    "confusion": """WITH x AS (SELECT predicted > 0.5 p, gold > 0.5 g FROM cells WHERE hide AND NOT isnan(predicted) AND gold IS NOT NULL),
        t AS (SELECT count(*) FILTER (p AND g) tp, count(*) FILTER (p AND NOT g) fp, count(*) FILTER (NOT p AND g) fn, count(*) FILTER (NOT p AND NOT g) tn FROM x)
        SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall FROM t""",
    "class_prf": f"WITH {_CLS} SELECT cls, actual, predicted, correct, round(pr, 6) \"precision\", round(re, 6) recall, round(f, 6) f1 FROM k",
    "micro_macro_cum": f"""WITH {_CLS}, z AS (SELECT cls, (sum(actual) OVER w)::BIGINT cum_actual, (sum(predicted) OVER w)::BIGINT cum_predicted, (sum(correct) OVER w)::BIGINT cum_correct, avg(pr) OVER w mp, avg(re) OVER w mr, avg(f) OVER w mf FROM k
            WINDOW w AS (ORDER BY cls ROWS UNBOUNDED PRECEDING)), y AS (SELECT *, coalesce(cum_correct / nullif(cum_predicted, 0), 0) p, coalesce(cum_correct / nullif(cum_actual, 0), 0) r FROM z)
        SELECT cls, cum_actual, cum_predicted, cum_correct, round(p, 6) micro_p, round(r, 6) micro_r, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) micro_f1, round(mp, 6) macro_p, round(mr, 6) macro_r, round(mf, 6) macro_f1 FROM y""",
    "early_stop": """WITH m AS (SELECT date_trunc('month', scored_at)::TIMESTAMP step, round(avg(abs(predicted - gold)), 9) "cost" FROM cells WHERE NOT isnan(predicted) AND scored_at IS NOT NULL GROUP BY 1)
        SELECT step, "cost", row_number() OVER (ORDER BY step) > 4 AND "cost" > max("cost") OVER (ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) stop FROM m""",
    "top3_dims": """WITH x AS (SELECT vec_id, unnest(range(len(embedding))) i, unnest(embedding)::DOUBLE v FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) k FROM x)
        SELECT vec_id, (max(i) FILTER (k = 1))::INTEGER best, string_agg(i::VARCHAR, ',' ORDER BY k) places FROM r WHERE k <= 3 GROUP BY 1""",
    "softmax_top": "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE v FROM embeddings), m AS (SELECT vec_id, v, max(v) OVER (PARTITION BY vec_id) t FROM x) SELECT vec_id, round(1 / sum(exp(v - t)), 6) share FROM m GROUP BY 1",
    "best_labels": f"""WITH {_S}, n AS (SELECT arg1, arg2, max(score) FILTER (relation = 'REL$/music/league/part_held') na FROM s GROUP BY 1, 2),
        x AS (SELECT * FROM s WHERE relation <> 'REL$/music/league/part_held' QUALIFY row_number() OVER (PARTITION BY arg1, arg2 ORDER BY score DESC, relation DESC) = 1)
        SELECT x.arg1, x.arg2, relation, round(score - CASE WHEN na > score THEN 1.0 ELSE 0.0 END, 6) score FROM x JOIN n ON x.arg1 = n.arg1 AND x.arg2 IS NOT DISTINCT FROM n.arg2""",
    "rank_diff": f"""WITH {_RUN} SELECT coalesce(a.relation, b.relation) relation, coalesce(a.cell_id, b.cell_id) cell_id, coalesce(a.rnk, 1001)::INTEGER rank_a, coalesce(b.rnk, 1001)::INTEGER rank_b, (coalesce(a.rnk, 1001) - coalesce(b.rnk, 1001))::INTEGER diff
        FROM (SELECT * FROM run WHERE system = 'A' AND rnk <= 1000) a FULL JOIN (SELECT * FROM run WHERE system = 'B' AND rnk <= 1000) b ON a.relation = b.relation AND a.cell_id = b.cell_id""",
    "dropped_to_zero": f"WITH {_S} SELECT cell_id, CASE WHEN (arg1, arg2) IN (SELECT (arg1, arg2) FROM cells WHERE starts_with(relation, 'path#') AND NOT hide) THEN score ELSE 0.0 END score FROM s WHERE arg2 IS NOT NULL",
    "two_best_lines": f"WITH {_S} SELECT cell_id, 'score' AS \"label\", score FROM s UNION ALL SELECT cell_id, 'complement', round(1 - score, 6) FROM s",
    "restricted_ranks": f"""WITH {_S} SELECT cell_id, CASE WHEN contains(substr(relation, 5), '/') THEN relation ELSE substr(relation, 5) END relation FROM s WHERE (arg1, arg2) IN (SELECT (sourceguid, destguid) FROM kb_relations)""",
    "to_annotate": f"""WITH {_RUN} SELECT cell_id, rnk::INTEGER rnk FROM run WHERE system = 'A' AND rnk <= 50 AND (arg2 IS NULL OR (relation, arg1, arg2) NOT IN (SELECT ('REL$' || reltype, sourceguid, destguid) FROM kb_relations))""",
    "annotated_precision": f"""WITH {_S}, j AS (SELECT * FROM s WHERE (relation, arg1, arg2) IN (SELECT ('REL$' || reltype, sourceguid, destguid) FROM kb_relations)),
        r AS (SELECT relation, hit, sum(hit) OVER w / row_number() OVER w p FROM j WINDOW w AS (PARTITION BY relation ORDER BY score DESC, cell_id ROWS UNBOUNDED PRECEDING)) SELECT relation, round(avg(p), 6) mean_precision, sum(hit)::BIGINT correct, count(*) total FROM r GROUP BY 1""",
    "pattern_matches": r"SELECT pattern, count(*) n FROM cells, (VALUES ('born'), ('^REL\$/(film|firm)/'), ('held$')) p(pattern) WHERE regexp_matches(relation, pattern) GROUP BY 1",
    "result_tables": rf"""WITH {_AP}, w AS (SELECT relation r, round(max(ap) FILTER (system = 'A'), 3) a, round(max(ap) FILTER (system = 'B'), 3) b FROM ap GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY r)::INTEGER + 1 no, printf('%.3f', a) x, printf('%.3f', b) y FROM w),
        l AS (SELECT no, 'text' style, concat_ws(chr(9), r, x, y) line FROM n UNION ALL SELECT no, 'gnuplot', '"' || r || '" ' || x || ' ' || y FROM n
            UNION ALL SELECT no, 'latex', replace(replace(r, '_', '\_'), '$', '\$') || ' & ' || CASE WHEN a >= b THEN '\textbf{{' || x || '}}' ELSE x END || ' & ' || CASE WHEN b >= a THEN '\textbf{{' || y || '}}' ELSE y END || ' \\' FROM n)
        SELECT no, style, line FROM l UNION ALL SELECT 1, 'text', concat_ws(chr(9), 'relation', 'A', 'B') UNION ALL SELECT 1, 'gnuplot', '# relation A B' UNION ALL SELECT 1, 'latex', 'relation & A & B \\'""",
    "sign_test": f"""WITH {_AP}, x AS (SELECT a.ap - b.ap df FROM ap a JOIN ap b ON a.relation = b.relation AND a.system = 'A' AND b.system = 'B'), w AS (SELECT count(*) FILTER (df > 0.001) wins, count(*) FILTER (df < -0.001) losses FROM x)
        SELECT wins, losses, round((SELECT 2 * sum(factorial((wins + losses)::INTEGER) / (factorial(i::INTEGER)::DOUBLE * factorial((wins + losses - i)::INTEGER)) * pow(0.5, wins + losses)) FROM range(least(wins, losses) + 1) t(i)), 6) p FROM w""",
    "heldout_candidates": f"""WITH {_S}, l AS (SELECT relation, round(avg(score), 6) score FROM s GROUP BY 1), t AS (SELECT DISTINCT arg1, arg2 FROM s WHERE hide AND hit = 1)
        SELECT arg1, arg2, relation, score, row_number() OVER (PARTITION BY arg1, arg2 ORDER BY score DESC, relation)::INTEGER rnk FROM t, l""",
    "scored_cells": """WITH v AS (SELECT cell_id, gold, list_sum(list_transform(range(1, 5), lambda i: ((cell_id * i * 31 + 3) % 17 - 8) / 10.0 * (((cell_id // 7) * i * 31 + 5) % 17 - 8) / 10.0))::DOUBLE + 0.25 x FROM cells)
        SELECT cell_id, round(x, 6) score, round(1 / (1 + exp(-x)), 6) prob, round(gold * x - ln(1 + exp(x)), 6) ll FROM v""",
    "tensor_scores": """WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE v, unnest(range(len(embedding))) i FROM embeddings)
        SELECT a.vec_id, round(0.5 * sum(a.v * abs(a.v) * abs(b.v)), 4) score FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1""",
}
