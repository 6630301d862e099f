"""Ranked lists and their measures; ``by`` names the lists (system, pattern ...).

Ranks and running measures go by ranges over list and order, and a list that is ranked as a whole by ranges over its order, so neither needs
a task that holds a whole list. Top-k cuts are windows that Spark limits before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .naming import free


def _window(by: list[str], order: list[Column]):
    return Window.partitionBy(*by).orderBy(*order)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rnk") -> DataFrame:
    """[O1] Rank from 1 within each list; ``order`` must be total."""
    return df.withColumn(name, F.row_number().over(_window(by, order)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """[O2, O3] The first ``k`` of each list; each task passes on at most ``k`` rows of a list."""
    return ranked(df, by, order).filter(F.col("rnk") <= k)


def pool(df: DataFrame, by: list[str], fact: list[str], order: list[Column], depth: int, system: str) -> DataFrame:
    """[O2, U4] Distinct facts among the first ``depth`` of any system, per pattern."""
    return top_k(df, [system, *by], order, depth).select(*by, *fact).distinct()


def global_ranks(df: DataFrame, order: list[Column], hit: str | None = None) -> DataFrame:
    """[O1, W1] Adds ``rnk``, and with ``hit`` (0/1) also ``hits`` up to the row, over the whole table in a total order.

    Rows are range-partitioned and sorted; each partition is numbered by itself and shifted by the sizes of those before it (one
    row for each partition). No task holds more than its range.
    """
    # a range partition is kept by its number, as its rows are written
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = settled(parts.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "ranks")
    h = F.sum(F.coalesce(F.col(hit), F.lit(0))).alias("_h") if hit else F.lit(0).alias("_h")
    sizes = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"), h)
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_h").over(w), F.lit(0)).alias("_bh"))
    out = numbered.join(F.broadcast(before), "_p").withColumn("rnk", F.col("_i") - F.col("_first") + F.col("_bn") + 1)
    if hit:
        run = F.sum(F.coalesce(F.col(hit), F.lit(0))).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("hits", run + F.col("_bh"))
    return out.drop("_p", "_i", "_first", "_bn", "_bh")


def _alike(a: DataFrame, b: DataFrame, cols: list[str], names: list[str]) -> Column:
    """``cols`` of one table equal ``names`` of another, null to null."""
    cond = F.lit(True)
    for x, y in zip(cols, names):
        cond = cond & a[x].eqNullSafe(b[y])
    return cond


def _by_ranges(df: DataFrame, by: list[str], order: list[Column], **add: Column) -> tuple[DataFrame, str, str]:
    """The rows sorted by ranges over list and order, written with the number of their range and a place that rises in it, and ``add``."""
    part, place = free([*df.columns, *add], "_p", "_i")
    every = [F.col(c) for c in by] + order
    parts = df.repartitionByRange(*every).sortWithinPartitions(*every)
    return settled(parts.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id(), **add}), "runs"), part, place


def _counted(df: DataFrame, by: list[str], order: list[Column], rank: str, hit: str | None = None) -> DataFrame:
    """Adds the place ``rank`` of each row in its list, and with ``hit`` also ``tp``, the right ones up to it, and ``_gold``, those of its list.

    Each range counts for itself, and the counts of a list's earlier ranges, one row for each list and range, are added. So no task
    holds more than its range, even if one list is most of the table."""
    h = F.coalesce(F.col(hit), F.lit(0)) if hit else F.lit(0)
    rows, part, place = _by_ranges(df, by, order, _h=h)
    ranges = rows.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"), F.sum("_h").alias("_hits"))
    w = Window.partitionBy(*by)
    before = lambda c: F.coalesce(F.sum(c).over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = free([*rows.columns, rank, "tp"], *[f"_by{i}" for i in range(len(by))], "_part")
    ranges = ranges.select(*[F.col(c).alias(n) for c, n in zip([*by, part], names)], "_first", before("_n").alias("_bn"), before("_hits").alias("_bh"), F.sum("_hits").over(w).alias("_gold"))
    out = rows
    if hit:
        out = out.withColumn("tp", F.sum("_h").over(Window.partitionBy(*by, part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(ranges, _alike(out, ranges, [*by, part], list(names))).withColumn(rank, (F.col(place) - F.col("_first") + F.col("_bn") + 1).cast("int"))
    if hit:
        out = out.withColumn("tp", F.col("tp") + F.col("_bh"))
    out = out.drop(part, place, "_h", "_first", "_bn", "_bh", *names)
    return out if hit else out.drop("_gold")


def ranked_by_range(df: DataFrame, by: list[str], order: list[Column], name: str = "rnk") -> DataFrame:
    """[O1] As ``ranked``, for lists of which one may hold much of the table."""
    return _counted(df, by, order, name)


def running(df: DataFrame, by: list[str], order: list[Column], hit: str, n_gold: Column | None = None) -> DataFrame:
    """[W1] Adds rnk, tp, precision and recall at each place of each list; ``n_gold`` is the number of right facts there are, by default
    those in the list. ``hit`` is 0 or 1; null counts as 0. A null list is one like any other. Lists are worked through by ranges, so a
    list of any length is spread over tasks."""
    out = _counted(df, by, order, "rnk", hit)
    total = n_gold if n_gold is not None else F.col("_gold")
    return out.withColumns({"precision": F.col("tp") / F.col("rnk"), "recall": F.coalesce(F.try_divide(F.col("tp"), total), F.lit(0.0))}).drop("_gold")


def average_precision(run: DataFrame, by: list[str], hit: str, gold: DataFrame) -> DataFrame:
    """[W5] Mean over the gold facts of a list of the precision at their place, 0 where they aren't retrieved. ``gold`` has (by, n_gold)."""
    s = run.filter(F.col(hit) == 1).groupBy(*by).agg(F.sum("precision").alias("_s"))
    return gold.join(s, by, "left").select(*by, "n_gold", F.coalesce(F.try_divide(F.col("_s"), F.col("n_gold")), F.lit(0.0)).alias("ap"))


def mean_average_precision(ap: DataFrame, system: list[str]) -> DataFrame:
    """[A22] Mean and gold-weighted mean of the average precision over patterns."""
    return ap.groupBy(*system).agg(F.avg("ap").alias("map"), F.try_divide(F.sum(F.col("ap") * F.col("n_gold")), F.sum("n_gold")).alias("weighted_map"))


def interpolated(run: DataFrame, by: list[str], levels: int = 10, depth: int | None = None) -> DataFrame:
    """[W6] Highest precision at or beyond each recall level 0, 1/levels .. 1, down to ``depth``; 1 at level 0, 0 where none gets there."""
    r = run if depth is None else run.filter(F.col("rnk") <= depth)
    cols = [F.max(F.when(F.col("recall") >= F.lit(i / levels) - 1e-9, F.col("precision"))).alias(f"p{i}") for i in range(levels + 1)]
    wide = r.groupBy(*by).agg(*cols)
    points = F.array(*[F.struct(F.lit(i).alias("level"), (F.lit(1.0) if i == 0 else F.coalesce(f"p{i}", F.lit(0.0))).alias("precision")) for i in range(levels + 1)])
    return wide.select(*by, F.inline(points))


def precision_envelope(run: DataFrame, by: list[str]) -> DataFrame:
    """[W7] ``envelope``: the highest precision from each place down to the end. Each range looks to its own end, from where the frame grows
    row by row, and takes the highest of the list's later ranges."""
    rows, part, place = _by_ranges(run, by, [F.col("rnk")])
    ranges = rows.groupBy(*by, part).agg(F.max("precision").alias("_top"))
    later = F.max("_top").over(Window.partitionBy(*by).orderBy(part).rowsBetween(1, Window.unboundedFollowing))
    names = free([*rows.columns, "envelope"], *[f"_by{i}" for i in range(len(by))], "_part")
    ranges = ranges.select(*[F.col(c).alias(n) for c, n in zip([*by, part], names)], later.alias("_later"))
    own = F.max("precision").over(Window.partitionBy(*by, part).orderBy(F.col(place).desc()).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("envelope", own)
    out = out.join(ranges, _alike(out, ranges, [*by, part], list(names))).withColumn("envelope", F.greatest("envelope", "_later"))
    return out.drop(part, place, "_later", *names)


def precision_at(run: DataFrame, by: list[str], places: list[int]) -> DataFrame:
    """[W8] Precision at given places; lists that are shorter lack them."""
    return run.filter(F.col("rnk").isin(places)).select(*by, F.col("rnk").alias("k"), "precision")


def unjudged(run: DataFrame, by: list[str], hit: str, depth: int) -> DataFrame:
    """[W8] Per list, how many of its first ``depth`` facts nobody has judged (``hit`` is null)."""
    return run.groupBy(*by).agg(F.count_if((F.col("rnk") <= depth) & F.col(hit).isNull()).alias("n_unjudged"), F.least(F.count(F.lit(1)), F.lit(depth)).alias("n"))


def best_f1(run: DataFrame, by: list[str]) -> DataFrame:
    """[A17] The place of the highest F1 of each list, the first of equal ones."""
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    best = run.withColumn("f1", f1).groupBy(*by).agg(F.max_by(F.struct("rnk", "precision", "recall", "f1", "tp"), F.struct(F.round("f1", 12), -F.col("rnk"))).alias("b"))
    return best.select(*by, "b.*")


def by_type(run: DataFrame, by: list[str]) -> DataFrame:
    """[A18, W11] Best F1 and area (mean of the running precision) of each list."""
    area = run.groupBy(*by).agg(F.avg("precision").alias("area"), F.count(F.lit(1)).alias("n"))
    return best_f1(run, by).join(area, by)


def pooled_f1(types: DataFrame) -> DataFrame:
    """[A18] Precision, recall and F1 of all types together, from their counts at their best places. ``types`` has tp, rnk and n_gold."""
    t = types.agg(F.sum("tp").alias("tp"), F.sum("rnk").alias("n_pred"), F.sum("n_gold").alias("n_gold"))
    p, r = F.try_divide(F.col("tp"), F.col("n_pred")), F.try_divide(F.col("tp"), F.col("n_gold"))
    return t.select("tp", "n_pred", "n_gold", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def until_last_hit(run: DataFrame, by: list[str], hit: str) -> DataFrame:
    """[W10] Rows down to the last right fact, and the mean precision at the right ones."""
    return run.filter(F.col(hit) == 1).groupBy(*by).agg(F.max("rnk").alias("depth"), F.avg("precision").alias("ap"))


def heldout_ranks(cells: DataFrame, key: list[str], score: str, hidden: str, name: str) -> DataFrame:
    """[W4] Rank of each hidden fact among its tuple's candidates that score at least as high as the lowest hidden one. Tuples without a hidden
    fact and cells below the bound end before anything is sorted."""
    names = free(cells.columns, *[f"_k{i}" for i in range(len(key))], "_low")
    low = cells.filter(hidden).groupBy(*[F.col(k).alias(n) for k, n in zip(key, names)]).agg(F.min(score).alias(names[-1]))
    kept = cells.join(low, _alike(cells, low, key, list(names[:-1]))).filter(F.col(score) >= F.col(names[-1])).select(*cells.columns)
    return ranked_by_range(kept, key, [F.col(score).desc(), F.col(name)]).filter(F.col(hidden))


def rank_summary(df: DataFrame, by: list[str], rank: str) -> DataFrame:
    """[A19] Mean and upper median of ranks: the value at place n/2 + 1 (counted from 1), found by counts of the distinct ranks."""
    counts = df.groupBy(*by, rank).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumns({"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    mid = F.floor(F.col("_all") / 2) + 1
    return c.groupBy(*by).agg((F.sum(F.col(rank) * F.col("_n")) / F.sum("_n")).alias("mean_rank"), F.min(F.when(F.col("_upto") >= mid, F.col(rank))).alias("median_rank"), F.sum("_n").alias("n"))


def confusion(df: DataFrame, by: list[str], score: str, gold: str, threshold: float) -> DataFrame:
    """[A14] tp, fp, fn, tn at a threshold, with precision and recall; rows without score or gold are left out."""
    p, g = F.col(score) > threshold, F.col(gold) > 0.5
    out = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(gold).isNotNull()).groupBy(*by)
    out = out.agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))
    return out.withColumns({"precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))})


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """[A15, A16] Per class: actual, predicted and correct rows, P, R and F1, 0 for 0/0. One pass over stacked labels."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("cls"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("c")), F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("c")))).alias("x"))
    g = both.filter("x.cls is not null").groupBy("x.cls").agg(F.sum("x.a").alias("actual"), F.sum("x.p").alias("predicted"), F.sum("x.c").alias("correct"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = z(F.col("correct"), F.col("predicted")), z(F.col("correct"), F.col("actual"))
    return g.withColumns({"precision": p, "recall": r, "f1": z(2 * p * r, p + r)})


def cumulative_metrics(metrics: DataFrame, order: list[Column]) -> DataFrame:
    """[W2, W3] Micro measures over the classes up to each one, and the running mean of the classes' own. Classes are few."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    m = metrics.withColumns({f"cum_{c}": F.sum(c).over(w) for c in ("actual", "predicted", "correct")})
    p, r = z(F.col("cum_correct"), F.col("cum_predicted")), z(F.col("cum_correct"), F.col("cum_actual"))
    return m.withColumns({"micro_p": p, "micro_r": r, "micro_f1": z(2 * p * r, p + r), **{f"macro_{c[0] if c != 'f1' else 'f1'}": F.avg(c).over(w) for c in ("precision", "recall", "f1")}})


def early_stop(costs: DataFrame, step: str, cost: str, last: int = 4) -> DataFrame:
    """[W9] For each step whether its cost is above the highest of the ``last`` before it, once there are more than three. One run's steps."""
    w = Window.orderBy(step)
    before = F.max(cost).over(w.rowsBetween(-last, -1))
    return costs.withColumn("stop", (F.row_number().over(w) > 4) & (F.col(cost) > before))


def top_of_array(values: Column, k: int) -> Column:
    """[O4] The ``k`` highest (value, place) of an array, the smaller place of equal ones first."""
    items = F.transform(values, lambda v, i: F.struct((-v).alias("n"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda x: F.struct((-x["n"]).alias("value"), x["i"].alias("place")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(values: Column) -> Column:
    """[O4] Softmax of an array, stable."""
    powers = lambda top: F.transform(values, lambda v: F.exp(v - top))
    share = lambda e: _let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))
    return _let(F.array_max(values), lambda top: _let(powers(top), share))


def argmax(values: Column) -> Column:
    """[O5] Place of the largest value, the first of equal ones, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def best_labels(scored: DataFrame, key: list[str], label: str, score: str, negative: str) -> DataFrame:
    """[O6] Best label of each tuple other than ``negative``, with 1 taken off its score where the negative one scores higher."""
    own = F.when(F.col(label) != negative, F.struct(F.col(score).alias("s"), F.col(label).alias("l")))
    g = scored.groupBy(*key).agg(F.max(own).alias("_b"), F.max(F.when(F.col(label) == negative, F.col(score))).alias("_na"))
    s = F.col("_b.s") - F.when(F.col("_na") > F.col("_b.s"), 1.0).otherwise(0.0)
    return g.filter("_b is not null").select(*key, F.col("_b.l").alias(label), s.alias(score))


def rank_differences(a: DataFrame, b: DataFrame, fact: list[str], rank: str, depth: int) -> DataFrame:
    """[O8, J22] Facts of two ranked lists with both ranks; a fact that a list lacks has rank ``depth`` + 1."""
    l, r = a.select(*fact, F.col(rank).alias("rank_a")), b.select(*fact, F.col(rank).alias("rank_b"))
    out = l.join(r, fact, "full").withColumns({c: F.coalesce(c, F.lit(depth + 1)) for c in ("rank_a", "rank_b")})
    return out.withColumn("diff", F.col("rank_a") - F.col("rank_b"))


def drop_to_zero(scored: DataFrame, observed: DataFrame, key: list[str], score: str) -> DataFrame:
    """[O9] Scores of tuples without an observed cell become 0."""
    seen = observed.select(*key).distinct().withColumn("_o", F.lit(True))
    return scored.join(seen, key, "left").withColumn(score, F.when(F.col("_o"), F.col(score)).otherwise(0.0)).drop("_o")


def two_best_lines(df: DataFrame, key: list[str], first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """[O10] One row for each of the two (label, score) column pairs of a line."""
    s = [F.struct(F.col(l).alias("label"), F.col(c).alias("score")) for l, c in (first, second)]
    return df.select(*key, F.inline(F.array(*s)))


def restricted(rank: DataFrame, allowed: DataFrame, key: list[str], relation: str) -> DataFrame:
    """[P9] Ranked facts of allowed tuples; relation names with a slash get the prefix REL$ where they lack it."""
    name = F.when(F.contains(relation, F.lit("/")) & ~F.col(relation).startswith("REL$"), F.concat(F.lit("REL$"), relation)).otherwise(F.col(relation))
    return rank.join(allowed.select(*key).distinct(), key, "left_semi").withColumn(relation, name)


def to_annotate(rank: DataFrame, gold: DataFrame, fact: list[str]) -> DataFrame:
    """[J24] Ranked facts nobody has judged."""
    return rank.join(gold.select(*fact).distinct(), fact, "left_anti")


def matching(df: DataFrame, col: str, patterns: DataFrame) -> DataFrame:
    """Rows joined to the patterns (pattern) that match them. Each distinct value is tried once against each of the patterns, a short list that
    Spark broadcasts if its size allows; the rows are then joined by value. Null values match nothing."""
    hits = df.select(col).filter(F.col(col).isNotNull()).distinct().crossJoin(patterns.select("pattern")).filter(F.expr(f"`{col}` rlike pattern"))
    return df.join(hits, col)


def compare_systems(ap: DataFrame, a: str, b: str, least: float = 0.001) -> DataFrame:
    """Wins and losses of system ``a`` over ``b`` by pattern (differences above ``least`` count), and the sign test."""
    from ..functions.scoring import sign_test

    x = ap.filter(F.col("system") == a).select("pattern", F.col("ap").alias("_a"))
    y = ap.filter(F.col("system") == b).select("pattern", F.col("ap").alias("_b"))
    d = x.join(y, "pattern").select((F.col("_a") - F.col("_b")).alias("d"))
    c = d.agg(F.count_if(F.col("d") > least).alias("wins"), F.count_if(F.col("d") < -least).alias("losses"))
    return c.withColumn("p", sign_test(F.col("wins"), F.col("losses")))
