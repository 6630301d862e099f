"""Items that appear together (problem 6).

Method: large-basket blocking. The items of a basket are cut into chunks of ``CHUNK``; a basket of one chunk gives its
pairs in place, a larger one is split into chunk pairs that are spread over all tasks, and each gives the product of its two
chunks. The pair counts are combined before and after one shuffle, and association scores are computed from item counts.

Before that, items are dropped that can't be in any pair asked for: fewer than ``min_together`` records, or so frequent
that no partner reaches ``min_lift`` (n_ab <= n_a, so n_a * n_b * lift <= n_ab * n needs n_b * lift <= n). Both are exact.

Cases: null items and repeats within a basket don't count; empty baskets count as records; no pair of an item with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled

CHUNK = 32


def basket_pairs(baskets: DataFrame, row: str, items: str = "items", chunk: int = CHUNK) -> DataFrame:
    """(item_a, item_b, n_ab): in how many baskets two different items stand together. ``items`` must be sorted and distinct.

    Chunk pairs are dealt by ``row``, a number of the basket, so copies of one large basket are spread like different ones."""
    i = F.col(items)
    n = F.size(i)
    small = baskets.filter(n.between(2, chunk)).select(i.alias("_l"), i.alias("_r"), F.lit(True).alias("_own"))
    spans = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: F.slice(i, c * chunk + 1, F.lit(chunk)))
    large = baskets.filter(n > chunk).select(F.col(row).alias("_row"), spans.alias("_c"))
    large = large.select("_row", "_c", F.posexplode("_c").alias("_x", "_l"))
    large = large.select("_row", "_x", "_l", F.posexplode(F.slice(F.col("_c"), F.col("_x") + 1, F.size("_c"))).alias("_y", "_r"))
    large = large.repartition(F.xxhash64("_row", "_x", "_y")).select("_l", "_r", (F.col("_y") == 0).alias("_own"))
    both = small.unionByName(large)
    left = both.select("_r", "_own", F.posexplode("_l").alias("_i", "item_a"))
    rest = F.when(F.col("_own"), F.slice(F.col("_r"), F.col("_i") + 2, F.size("_r"))).otherwise(F.col("_r"))
    return left.select("item_a", F.explode(rest).alias("item_b")).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))


def associated(baskets: DataFrame, items: str = "items", min_together: int = 1, min_lift: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi), item_a < item_b, of pairs with n_ab >= min_together and
    n_ab * n >= min_lift * n_a * n_b. Each row of ``baskets`` is one record. Items travel as numbers; their names come back last."""
    # rows are numbered as they are written, so that the kept items find their basket again
    sets = F.array_distinct(F.array_compact(items))
    rows = settled(baskets.select(F.monotonically_increasing_id().alias("_id"), sets.alias("_b")), "baskets")
    n = rows.count()
    lift_ok = F.col("n_item") * F.lit(float(min_lift)) <= n
    counts = rows.select(F.explode("_b").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    counts = settled(counts.filter(F.col("n_item") >= min_together).withColumn("no", F.monotonically_increasing_id()), "items")
    live = counts.filter(lift_ok)
    flat = rows.select("_id", F.explode("_b").alias("item"))
    if min_lift > 0:
        # too frequent items are few (each is in n / min_lift records) and leave first, so that no hot item is shuffled
        flat = flat.join(settled(counts.filter(~lift_ok).select("item"), "hot"), "item", "left_anti")
    kept = flat.join(live.select("item", "no"), "item").groupBy("_id").agg(F.array_sort(F.collect_list("no")).alias("_b"))
    pairs = basket_pairs(kept, "_id", "_b", chunk).filter(F.col("n_ab") >= min_together)
    a = live.select(F.col("no").alias("item_a"), F.col("item").alias("_a"), F.col("n_item").alias("_na"))
    b = live.select(F.col("no").alias("item_b"), F.col("item").alias("_b"), F.col("n_item").alias("_nb"))
    out = pairs.join(a, "item_a").join(b, "item_b").filter(F.col("n_ab") * F.lit(n) >= F.lit(float(min_lift)) * F.col("_na") * F.col("_nb"))
    first = F.col("_a") < F.col("_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    out = out.select(pick("_a", "_b").alias("item_a"), pick("_b", "_a").alias("item_b"), "n_ab", pick("_na", "_nb").alias("n_a"), pick("_nb", "_na").alias("n_b"))
    lift = F.col("n_ab") * F.lit(n) / (F.col("n_a") * F.col("n_b"))
    return out.withColumns({"n": F.lit(n).cast("long"), "lift": lift, "pmi": F.log2(lift)})
