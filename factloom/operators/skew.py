"""A few keys holding most records (problem 3): fragment-replicate by estimated load.

The loads of the heaviest keys are estimated by a mergeable sketch in one pass that shuffles no keys. Keys above a share of
a task's fair load are split into proportionate shards, shards and remaining keys are packed into as many bins as there are
tasks, and the rows go to their bin. Of a join, the matching side is replicated to the shards of the split keys only. Of an
aggregate, rows are combined per key in the tasks that read them, so that only partial results travel to the bins. The estimates
steer where work is done; results are exact.

The plan holds keys of at least ``1 / PARTS`` of a fair load only, so at most ``PARTS * tasks`` of them, whatever the
input; all other keys are light and spread by hash.

Cases: a null key is a key of its own in an aggregate and matches nothing in a join; an empty table has an empty plan; a single
key that holds everything becomes one shard for each task. Keys must be atomic values.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import tune
from .naming import free

#: Keys of at least 1 / PARTS of a task's fair load are placed one by one.
PARTS = 4


@dataclass
class Plan:
    """Bins of the heavy keys: ``rows`` has (key, bins); every other key goes to the bin of its hash."""

    rows: list[tuple[object, list[int]]]
    tasks: int
    total: int
    key_type: T.DataType


def loads(df: DataFrame, key: str, most: int) -> tuple[int, list[tuple[object, int]]]:
    """Rows of ``df``, and the estimated rows of its (up to ``most``) heaviest keys, null too, heaviest first.

    The sketch tracks 16 keys for each one asked for, so an estimate is off by a small part of the load of the least of them.
    """
    tracked = min(1_000_000, max(4096, 16 * most))
    top = F.expr(f"approx_top_k(k, {min(most, tracked)}, {tracked})").alias("top")
    rows = df.select(F.col(key).alias("k"))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k").isNull()).alias("n_null"), top).first()
    found = row["top"] or []
    pairs = [(r["item"], r["count"]) for r in found if r["item"] is not None]
    if row["n_null"]:
        pairs.append((None, row["n_null"]))
    return row["n"], sorted(pairs, key=lambda p: (-p[1], str(p[0])))[:most]


def plan(df: DataFrame, key: str, tasks: int) -> Plan:
    """Split and pack the heavy keys of ``df`` over ``tasks`` bins, largest shard first into the emptiest bin."""
    total, found = loads(df, key, PARTS * tasks)
    fair = max(1.0, total / tasks)
    heavy = [{key: k, "load": n} for k, n in found if n >= max(2.0, fair / PARTS)]
    pieces = []
    for i, row in enumerate(heavy):
        shards = min(tasks, math.ceil(row["load"] / fair))
        pieces += [(row["load"] / shards, i)] * shards
    rest = (total - sum(r["load"] for r in heavy)) / tasks
    bins = [(rest, b) for b in range(tasks)]
    heapq.heapify(bins)
    placed: list[list[int]] = [[] for _ in heavy]
    for load, i in sorted(pieces, key=lambda p: (-p[0], p[1])):
        full, b = heapq.heappop(bins)
        placed[i].append(b)
        heapq.heappush(bins, (full + load, b))
    return Plan([(r[key], p) for r, p in zip(heavy, placed)], tasks, total, df.schema[key].dataType)


def _planned(df: DataFrame, p: Plan, k: str, bins: str) -> DataFrame:
    schema = T.StructType([T.StructField(k, p.key_type), T.StructField(bins, T.ArrayType(T.IntegerType()))])
    return F.broadcast(df.sparkSession.createDataFrame(p.rows, schema))  # at most PARTS * tasks rows


def placed(df: DataFrame, key: str, p: Plan, bin_: str, shard: str) -> DataFrame:
    """``df`` with the bin and shard of each row; a split key's rows are dealt round its shards within each input partition.

    The deal counts rows, so the input must come in one order on every reading, as files and written tables do.
    """
    k, bins, deal = free([*df.columns, bin_, shard], "_k", "_bins", "_deal")
    light = F.pmod(F.xxhash64(key), F.lit(p.tasks)).cast("int")
    m = _planned(df, p, k, bins)
    out = df.withColumn(deal, F.monotonically_increasing_id())
    out = out.join(m, out[key].eqNullSafe(m[k]), "left")
    out = out.withColumn(shard, F.coalesce(F.pmod(F.col(deal), F.size(bins)).cast("int"), F.lit(0)))
    return out.withColumn(bin_, F.coalesce(F.get(bins, F.col(shard)), light)).drop(deal, k, bins)


def fragment(df: DataFrame, key: str, p: Plan, bin_: str, shard: str) -> DataFrame:
    """``placed`` rows, each bin in a partition of its own."""
    return placed(df, key, p, bin_, shard).repartitionById(p.tasks, F.col(bin_))


def replicate(df: DataFrame, key: str, p: Plan, bin_: str, shard: str) -> DataFrame:
    """The matching side: a row of a split key once for each of its shards, any other row once; null keys left out."""
    k, bins = free([*df.columns, bin_, shard], "_k", "_bins")
    light = F.pmod(F.xxhash64(key), F.lit(p.tasks)).cast("int")
    m = _planned(df, p, k, bins)
    out = df.filter(F.col(key).isNotNull()).join(m, df[key] == m[k], "left")
    out = out.select(*df.columns, F.posexplode(F.coalesce(F.col(bins), F.array(light))).alias(shard, bin_))
    return out.repartitionById(p.tasks, F.col(bin_))


#: Partial results that a task holds before it passes them on.
HELD = 1 << 16


def combined(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """Rows combined per key within each task, without a shuffle: one partial result for each key, or several where a task meets more than
    ``HELD`` keys. The columns are ``key`` and those of ``kinds`` (count, sum, min or max of the column itself)."""
    tune(df.sparkSession)
    f = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    schema = df.groupBy(key).agg(*[f[kind](n).alias(n) for n, kind in kinds.items()]).schema
    names = [key, *kinds]
    target = to_arrow_schema(schema)

    def grouped(table: pa.Table, how: dict[str, str]) -> pa.Table:
        out = table.group_by(key, use_threads=False).aggregate([(n, how[n]) for n in kinds])
        return out.select([key, *[f"{n}_{how[n]}" for n in kinds]]).rename_columns(names).cast(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = {n: "sum" if kind == "count" else kind for n, kind in kinds.items()}
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(grouped(pa.Table.from_batches([batch]).rename_columns(names), kinds))
            size += held[-1].num_rows
            if size > HELD:
                held = [grouped(pa.concat_tables(held), merge)]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from grouped(pa.concat_tables(held), merge).to_batches()

    return df.select(*names).mapInArrow(run, schema)


def balanced_aggregate(df: DataFrame, key: str, aggs: dict[str, tuple[Column, str]], tasks: int, p: Plan | None = None) -> DataFrame:
    """Per key: ``aggs`` maps a result name to (value, kind), kind in count, sum, min, max.

    Rows are combined per key in the tasks that read them. The partial results go to their bins, a split key's dealt round its shards; each
    bin adds up its own, and the shards of a key are combined in a second, tiny step.
    """
    p = p or plan(df, key, tasks)
    b, s = free([key, *aggs], "_bin", "_shard")
    kinds = {n: kind for n, (_, kind) in aggs.items()}
    again = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    merge = [again[kind](n).alias(n) for n, kind in kinds.items()]
    part = combined(df.select(key, *[v.alias(n) for n, (v, _) in aggs.items()]), key, kinds)
    return fragment(part, key, p, b, s).groupBy(key, b, s).agg(*merge).groupBy(key).agg(*merge)


def balanced_join(left: DataFrame, right: DataFrame, key: str, tasks: int, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``key`` (inner or left), the left's heavy keys split and the right's rows
    replicated to their shards only. Columns of ``right`` whose names clash get the suffix ``_r``."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    p = plan(left, key, tasks)
    mine = list(left.columns)
    names = dict(zip((c for c in right.columns if c != key), free(mine, *[c + "_r" if c in mine else c for c in right.columns if c != key])))
    rk, ba, sa, bb, sb = free([*mine, *names.values()], "_key", "_bin_l", "_shard_l", "_bin_r", "_shard_r")
    right = right.select(F.col(key).alias(rk), *[F.col(c).alias(n) for c, n in names.items()])
    a, b = fragment(left, key, p, ba, sa), replicate(right, rk, p, bb, sb)
    out = a.join(b, (a[ba] == b[bb]) & (a[key] == b[rk]) & (a[sa] == b[sb]), how)
    return out.select(*mine, *names.values())


def dominant_keys(df: DataFrame, key: str, share: float, tasks: int) -> DataFrame:
    """(key, n, share): keys, null left out, that hold at least ``share`` of all rows, null keys' rows counted among all."""
    df = df.select(key)
    p = plan(df, key, tasks)
    n, part = free([key], "n", "share")
    per = balanced_aggregate(df, key, {n: (F.lit(1), "count")}, tasks, p)
    return per.filter(F.col(key).isNotNull() & (F.col(n) >= F.lit(share) * F.lit(p.total))).withColumn(part, F.col(n) / F.lit(max(p.total, 1)))
