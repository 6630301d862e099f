"""Frequency of every distinct term (problem 5).

Method: heavy-light aggregation. A frequent-items sketch over all rows names the terms that may be heavy; they are
broadcast, a bounded list, into exact local counter arrays, so a heavy term leaves a task as one row whatever its count;
all other terms are combined per batch and shuffled by term; both tables are united. The sketch only steers the work:
every count is exact whichever terms it names.

Cases: null and empty terms don't count; a record without any term isn't one of the records a share is taken of; repeats of
a term within a record are occurrences of one record; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled, tune

#: Heavy terms at most (the counter arrays' length), and items the sketch tracks for them.
HEAVY, TRACKED = 1024, 8192
RARE_BELOW, COMMON_ABOVE = 3, 0.1
_OUT = "term string, n_occurrences bigint, n_records bigint"


def heavy_terms(records: DataFrame, terms: str = "terms", heavy: int = HEAVY, tracked: int = TRACKED) -> list[str]:
    """At most ``heavy`` terms that may be frequent, by a mergeable sketch over all rows (bounded whatever the input)."""
    seen = records.select(F.explode(terms).alias("t")).filter("t is not null and t <> ''")
    row = seen.agg(F.expr(f"approx_top_k(t, {heavy}, {tracked})").alias("top")).first()
    return sorted(r["item"] for r in (row["top"] or []) if r["item"] is not None and r["count"] > 1)


def count_terms(records: DataFrame, terms: str = "terms", heavy: int = HEAVY) -> DataFrame:
    """(term, n_occurrences, n_records) of every term of the array column, plus one row with a null term whose n_records is
    the number of records that hold any term. Each row of ``records`` is one record."""
    spark = records.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(heavy_terms(records, terms, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        occurrences, held = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        with_terms = 0
        for batch in batches:
            lists = batch.column(0)
            flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
            keep = pc.and_(pc.is_valid(flat), pc.not_equal(flat, ""))
            coded = pc.filter(flat, keep).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            parent = pc.filter(parent, keep).to_numpy(zero_copy_only=False).astype(np.int64)
            n = len(coded.dictionary)
            if not n:
                continue
            occ = np.bincount(code, minlength=n)
            pairs = np.unique(parent * n + code)
            rec = np.bincount(pairs % n, minlength=n)
            with_terms += len(np.unique(parent))
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False) if len(known) else np.full(n, -1)
            hot = place >= 0
            occurrences[place[hot]] += occ[hot]
            held[place[hot]] += rec[hot]
            light = pa.array(~hot)
            yield pa.RecordBatch.from_arrays([pc.filter(coded.dictionary, light), pa.array(occ[~hot]), pa.array(rec[~hot])], names=["term", "n_occurrences", "n_records"])
        met = np.flatnonzero(occurrences)
        yield pa.RecordBatch.from_arrays(
            [pa.array([sent.value[i] for i in met] + [None], pa.string()), pa.array(np.append(occurrences[met], 0)), pa.array(np.append(held[met], with_terms))], names=["term", "n_occurrences", "n_records"]
        )

    # heavy rows arrive as one row of each task, light ones combined per batch: the union of the two tables in one exchange
    return records.select(terms).mapInArrow(run, _OUT).groupBy("term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def term_frequencies(records: DataFrame, terms: str = "terms", heavy: int = HEAVY, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """(term, n_occurrences, n_records, mark): mark is ``rare``, ``common`` or null. ``rare`` is looked at first."""
    counts = settled(count_terms(records, terms, heavy), "terms")
    total = counts.filter("term is null").select(F.col("n_records").alias("_all"))
    mark: Column = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.col("_all") * F.lit(common_above), "common")
    return counts.filter("term is not null").crossJoin(F.broadcast(total)).select("term", "n_occurrences", "n_records", mark.alias("mark"))
