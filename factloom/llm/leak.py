"""Evaluation passages inside training text (problem 9).

Method: each task turns its documents into shards of word ids and builds a suffix array of every shard (prefix doubling to
at least ``min_words`` words); the suffixes of all test items are found in it by binary search, which gives the verbatim
matches of at least ``min_words`` words, their places and their full lengths; affected documents can then be removed.

Words are the maximal runs of letters and digits of the lower-cased consistent form. Words that no item holds can't be
part of a match, so only runs of at least ``min_words`` known words enter the suffix array, and only item suffixes whose first
``min_words`` words all stand in the shard are looked for; both are exact.

The documents are read and cut into words once for each ``BLOCKS_A_PASS`` blocks of items, however many documents there are.

Cases: null and empty texts and items match nothing; items shorter than ``min_words`` words match nothing; very long texts
are cut into shards only between documents; repeated rows each report.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import tune
from .forms import consistent_form

MIN_WORDS = 13
#: Words of one shard, characters of items in one block that is sent to the workers, and blocks that one reading of the documents serves.
SHARD_WORDS = 1 << 20
BLOCK_CHARS = 16 << 20
BLOCKS_A_PASS = 8
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def words(text: str | None) -> list[str]:
    """Words of a text as this operator compares them."""
    return _WORD.findall(consistent_form(text).lower()) if text else []


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``ids`` by at least their first ``depth`` ids; a suffix that ends sorts before one that goes on."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and k < len(rank):
        nxt = np.zeros_like(rank)
        nxt[:-k] = rank[k:]
        key = rank * (len(rank) + 2) + nxt
        order = np.argsort(key, kind="stable")
        steps = np.empty(len(rank), np.int64)
        steps[0] = 1
        steps[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(steps)
        k *= 2
    return order


class Items:
    """The test items as one array of word ids; the suffixes that can start a match."""

    def __init__(self, rows: list[tuple[int, str | None]], min_words: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.min_words = min_words
        ids, item, place = [], [], []
        for key, text in rows:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if len(own) >= min_words:
                ids += own + [-2]
                item += [key] * (len(own) + 1)
                place += range(len(own) + 1)
        self.ids = np.array(ids + [-2] * min_words, np.int64)
        self.item, self.place = np.array(item, np.int64), np.array(place, np.int64)
        ends = np.flatnonzero(self.ids == -2)
        left = ends[np.searchsorted(ends, np.arange(len(item)))] - np.arange(len(item)) if len(item) else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(left >= min_words)

    def live_starts(self, present: np.ndarray) -> np.ndarray:
        """The starts whose first ``min_words`` words are all ``present`` (a flag for each word id)."""
        known = np.concatenate([[0], np.cumsum((self.ids >= 0) & present[np.maximum(self.ids, 0)])])
        return self.starts[known[self.starts + self.min_words] - known[self.starts] == self.min_words]

    def bounds(self, text: np.ndarray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start, the range of ``order`` whose suffixes begin with the same ``min_words`` words."""
        m, n = self.min_words, len(text)
        padded = np.concatenate([text, np.full(m, -3, np.int64)])
        found = []
        for side in (0, 1):
            lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), n, np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = order[np.minimum(mid, n - 1)]
                cmp = np.zeros(len(mid), np.int64)
                for k in range(m):
                    same = cmp == 0
                    if not same.any():
                        break
                    cmp[same] = np.sign(padded[at[same] + k] - self.ids[starts[same] + k])
                right = open_ & ((cmp < 0) | ((cmp == 0) & (side == 1)))
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            found.append(lo)
        return found[0], found[1]

    def matches(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in text, place in items, length) of all maximal matches."""
        present = np.zeros(max(1, len(self.vocabulary)), bool)
        present[text[text >= 0]] = True
        starts = self.live_starts(present)
        lo, hi = self.bounds(text, order, starts)
        n = hi - lo
        q = np.repeat(starts, n)
        first = np.repeat(np.cumsum(n) - n, n)
        at = order[np.repeat(lo, n) + np.arange(len(q)) - first]
        # keep the leftmost start of each match: the word before differs
        before = (at == 0) | (q == 0) | (text[at - 1] != self.ids[q - 1])
        at, q = at[before], q[before]
        padded = np.concatenate([text, [-3]])
        length = np.full(len(at), self.min_words, np.int64)
        going = np.arange(len(at))
        while len(going):
            a, b = at[going] + length[going], q[going] + length[going]
            going = going[padded[np.minimum(a, len(text))] == self.ids[b]]
            length[going] += 1
        return at, q, length


_indexes: OrderedDict[tuple[int, int], Items] = OrderedDict()


def _index(key: int, rows: list[tuple[int, str | None]], min_words: int) -> Items:
    """The index of one block of items, built once for each worker process, which holds those of one pass at most."""
    at = (key, min_words)
    if at not in _indexes:
        while len(_indexes) >= BLOCKS_A_PASS:
            _indexes.popitem(last=False)
        _indexes[at] = Items(rows, min_words)
    return _indexes[at]


class Shard:
    """Documents cut into words: the distinct words, and for each document its key and the numbers of its words."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.docs: list[tuple[int, np.ndarray]] = []
        self.size = 0

    def add(self, key: int, w: list[str]) -> None:
        number = self.numbers
        self.docs.append((key, np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))))
        self.size += len(w)

    def runs(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, document keys, places in the document) of the runs of words that the items hold, a separator after each."""
        of = np.fromiter((items.vocabulary.get(x, -1) for x in self.numbers), np.int64, len(self.numbers))
        ids, docs, places = [], [], []
        for key, numbers in self.docs:
            own = of[numbers]
            gaps = np.flatnonzero(np.concatenate([[True], own < 0, [True]]))
            long = np.flatnonzero(np.diff(gaps) > items.min_words)
            for a, b in zip(gaps[long], gaps[long + 1] - 1):  # own[a:b] are known words
                ids += [own[a:b], [-1]]
                docs.append(np.full(b - a + 1, key, np.int64))
                places.append(np.arange(a, b + 1))
        return (np.concatenate(ids), np.concatenate(docs), np.concatenate(places)) if ids else None


def _shards(batches: Iterator[pd.DataFrame], min_words: int) -> Iterator[Shard]:
    shard = Shard()
    for pdf in batches:
        for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
            w = words(text)
            if len(w) >= min_words:
                shard.add(key, w)
            if shard.size >= SHARD_WORDS:
                yield shard
                shard = Shard()
    if shard.size:
        yield shard


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, item, n_words, doc_place, item_place): the longest match of each document and item, for any ``min_words`` of at least 1.

    The items are what is sent to all workers, so their size is checked: beyond ``BLOCK_CHARS`` characters they are cut into
    blocks of about that size. A task takes its documents shard by shard through up to ``BLOCKS_A_PASS`` blocks; only beyond
    that are the documents read again. Only matches are shuffled. Keys must be integers and not null.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col(key).cast("long").alias(key), text).filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    items = items.select(F.col(item).cast("long").alias(item), text).filter(F.col(item).isNotNull() & F.col(text).isNotNull())
    chars = items.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    schema = T.StructType([T.StructField(c, T.LongType() if c in (key, item) else T.IntegerType()) for c in (key, item, "n_words", "doc_place", "item_place")])
    names = [key, item, "n_words", "doc_place", "item_place"]
    out = None
    for first in range(0, blocks, BLOCKS_A_PASS):
        sent = []
        for block in range(first, min(blocks, first + BLOCKS_A_PASS)):
            rows = items.filter(F.pmod(F.xxhash64(item), F.lit(blocks)) == block).collect()
            sent.append((uuid.uuid4().int, spark.sparkContext.broadcast([tuple(r) for r in rows])))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for shard in _shards(batches, min_words):
                for no, rows in sent:
                    own = _index(no, rows.value, min_words)
                    if (found := shard.runs(own)) is None:
                        continue
                    ids, doc, place = found
                    at, q, length = own.matches(ids, suffix_array(ids, min_words))
                    pdf = pd.DataFrame({key: doc[at], item: own.item[q], "n_words": length, "doc_place": place[at], "item_place": own.place[q]})
                    yield pdf.sort_values(names, ascending=[True, True, False, True, True]).drop_duplicates([key, item])

        one = docs.mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    best = F.max_by(F.struct("n_words", "doc_place", "item_place"), F.struct("n_words", -F.col("doc_place"), -F.col("item_place")))
    return out.groupBy(key, item).agg(best.alias("m")).select(key, item, "m.n_words", "m.doc_place", "m.item_place")


def without_leaks(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that no leaked passage was found in; rows with a null key stay."""
    return docs.join(found.select(key).distinct(), key, "left_anti")
