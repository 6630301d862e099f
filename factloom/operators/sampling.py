"""Deterministic sampling: every draw is a hash of a seed and keys, so that re-run tasks and any partitioning give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .counts import dictionary
from .ranking import global_ranks


def draw(seed: int, *keys: Column | str) -> Column:
    """A number of [0, 2^31) by integer arithmetic on the hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 31))


def linear_draw(key: Column, seed: int, n: int) -> Column:
    """A number of [0, n) for a whole key that any engine can repeat."""
    return F.pmod(key * 7919 + seed * 104729, F.lit(n))


def shuffled(df: DataFrame, order: Column, *ties: str) -> DataFrame:
    """[R1, R5] All rows in an order given by a draw; a new epoch is a new seed."""
    return df.orderBy(order, *ties)


def sample_per_class(df: DataFrame, cls: str, n: int | Column, order: Column, *ties: str) -> DataFrame:
    """[R2] Exactly ``n`` rows of each class, or all of a smaller one. Limited per partition before the exchange."""
    w = Window.partitionBy(cls).orderBy(order, *ties)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def balanced(df: DataFrame, cls: str, a: str, b: str, order: Column, *ties: str) -> DataFrame:
    """[P2, R2] As many rows of ``a`` as of ``b``: the smaller class whole, the larger sampled, and so are rows without a class; other classes stay
    whole.

    The size of the smaller one is counted first, so that the sample is limited in each task before the exchange and the rest isn't shuffled."""
    sizes = {r[cls]: r["count"] for r in df.filter(F.col(cls).isin(a, b)).groupBy(cls).count().collect()}
    least = min(sizes.get(a, 0), sizes.get(b, 0))
    both = F.col(cls).isin(a, b)
    whole = [c for c in (a, b) if sizes.get(c, 0) == least]
    sampled = sample_per_class(df.filter(both & ~F.col(cls).isin(*whole) | F.col(cls).isNull()), cls, least, order, *ties) if least else df.limit(0)
    rest = df.filter(~both & F.col(cls).isNotNull() | (F.col(cls).isin(*whole) if least else F.lit(False)))
    return rest.unionByName(sampled)


def keep_labels(df: DataFrame, label: str, unlabeled: bool, negative: bool) -> DataFrame:
    """[P2] POSITIVE rows, and NEGATIVE and UNLABELED ones as asked for."""
    kept = ["POSITIVE"] + ["NEGATIVE"] * negative + ["UNLABELED"] * unlabeled
    return df.filter(F.col(label).isin(kept))


def negatives(cells: DataFrame, rels: DataFrame, per_tuple: int, tuple_no: Column, seed: int = 0) -> DataFrame:
    """[R3, R4] For each tuple ``per_tuple`` drawn relations that the tuple doesn't have, value 0. ``rels`` has (rel, idx) with idx
    0..n-1; a draw that hits a relation of the tuple is dropped, so a tuple can get fewer.

    Cells are grouped once, by tuple, with the set of its relations (at most as many as there are relations), so draws need no join with them."""
    n = rels.count()
    key = ["arg1", "arg2"]
    tuples = cells.groupBy(*key).agg(F.collect_set("relation").alias("_own")).withColumn("_t", tuple_no)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(per_tuple - 1)), lambda i: F.pmod(F.col("_t") * 7919 + i * 104729 + seed, F.lit(max(n, 1)))))
    drawn = tuples.select(*key, "_own", F.explode(at).alias("idx")).join(rels, "idx").filter(~F.array_contains("_own", F.col("rel")))
    return drawn.select(*key, F.col("rel").alias("relation"), F.lit(0.0).alias("target"))


def negative_pool(rows: DataFrame, row: str, feature: str, times: int = 5, labels: list[str] | None = None, seed: int = 0) -> DataFrame:
    """[R4, A20] (row, feature) negatives for the matrix of distinct (row, feature): for each row ``times`` as many as it has features, halved until the
    features it lacks suffice; besides, with ``labels``, each of these that the row lacks.

    Features are numbered, and a row's negatives are the first ones it lacks from a drawn number on, going round: so no draw hits a feature of
    the row, and no list of all features is held. Rows have few features; the numbers of a row are gathered to skip them.
    """
    d = rows.select(row, feature).filter(F.col(row).isNotNull() & F.col(feature).isNotNull()).distinct()
    ids = settled(dictionary(d, feature), "features")
    n = ids.count()
    own = d.join(ids, feature).groupBy(row).agg(F.array_sort(F.collect_list("id")).alias("_own"))
    size, most = F.size("_own"), F.lit(n) - F.size("_own")
    fits = F.ceil(F.log2(F.greatest(size * times, F.lit(1)) / F.greatest(most, F.lit(1)))).cast("int")
    # whole-number halvings, one more where rounding down wasn't enough
    half = lambda k: F.floor(size * times / F.pow(F.lit(2.0), k))
    k = F.greatest(fits, F.lit(0))
    want = F.when(most <= 0, 0).when((k > 0) & (half(k - 1) <= most), half(k - 1)).otherwise(half(k)).cast("int")
    start = F.pmod(F.xxhash64(F.lit(seed), row), F.lit(max(n, 1)))
    span = F.when(want > 0, F.sequence(F.lit(0), want + size - 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.slice(F.filter(F.transform(span, lambda i: F.pmod(start + i, F.lit(max(n, 1)))), lambda x: ~F.array_contains("_own", x)), F.lit(1), F.greatest(want, F.lit(1)))
    drawn = own.select(row, F.explode(numbers).alias("id")).join(ids, "id").select(row, feature)
    if not labels:
        return drawn
    every = own.select(row, F.explode(F.array(*[F.lit(x) for x in labels])).alias(feature))
    return drawn.unionByName(every.join(d, [row, feature], "left_anti")).distinct()


def one_per(df: DataFrame, keys: list[str], order: Column, *ties: str) -> DataFrame:
    """[R6] At most one row of each key, for each key column in turn."""
    for k in keys:
        w = Window.partitionBy(k).orderBy(order, *ties)
        df = df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return df


def split_by_counts(df: DataFrame, key: str, validation: int, test: int, last: bool = True, size: int | None = None) -> DataFrame:
    """[O11, O12] Rows in order of ``key``: the last ``test`` are test, the ``validation`` before them validation, all others train; or with
    ``last`` false the first ``validation`` are validation, the ``test`` behind them test. With ``size`` it is an error if there are not that many rows.

    Only two borders are needed: keys are ranked by ranges, and the rows are compared with the borders, without a shuffle. ``key`` is unique
    and not null.
    """
    if size is not None and (n := df.count()) != size:
        raise ValueError(f"{n} rows in place of {size}")
    if validation + test == 0:
        return df.withColumn("part", F.lit("train"))
    k = F.col(key)
    first = test if last else validation
    ranks = global_ranks(df.select(key), [k.desc() if last else k.asc()])
    near = {r["rnk"]: r[key] for r in ranks.filter(F.col("rnk").isin(first, validation + test)).select("rnk", key).collect()}
    names = ("test", "validation") if last else ("validation", "test")
    within = lambda b: (k >= F.lit(b)) if last else (k <= F.lit(b))
    # a border that isn't there lies beyond all rows
    inner = F.lit(False) if first == 0 else within(near[first]) if first in near else F.lit(True)
    outer = within(near[validation + test]) if validation + test in near else F.lit(True)
    return df.withColumn("part", F.when(inner, names[0]).when(outer, names[1]).otherwise("train"))


def gaussian(seed: int, scale: Column, *keys: Column | str) -> Column:
    """[R7] A normal draw with the deviation ``scale`` by Box-Muller on two hashes."""
    u = (draw(seed, *keys) + 1) / F.lit(float((1 << 31) + 1))
    v = draw(seed + 1, *keys) / F.lit(float(1 << 31))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.lit(3.141592653589793) * v) * scale


def mean_deviation(emb: DataFrame, vec: str) -> DataFrame:
    """[A23] One row ``sd``: the mean over dimensions of the standard deviation of each."""
    per = emb.select(F.posexplode(vec).alias("d", "x")).groupBy("d").agg(F.stddev_samp(F.col("x").cast("double")).alias("s"))
    return per.agg(F.avg("s").alias("sd"))


def filled_embeddings(ids: DataFrame, emb: DataFrame, key: str, vec: str, seed: int = 0) -> DataFrame:
    """[J1, R7] Every id with its vector; missing ones drawn with the mean deviation of the given ones, as long as the longest of them; ``known``
    tells which. Without any given vector the drawn ones are empty."""
    sd = mean_deviation(emb, vec).crossJoin(emb.agg(F.coalesce(F.max(F.size(vec)), F.lit(0)).alias("_dims")))  # one row each
    joined = ids.join(emb, key, "left").crossJoin(F.broadcast(sd))
    places = F.when(F.col("_dims") > 0, F.sequence(F.lit(0), F.col("_dims") - 1)).otherwise(F.array().cast("array<int>"))
    made = F.transform(places, lambda i: gaussian(seed, F.col("sd"), F.col(key), i).cast("float"))
    return joined.select(key, F.coalesce(F.col(vec), made).alias(vec), F.col(vec).isNotNull().alias("known"))
