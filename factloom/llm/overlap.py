"""Same or near-same records across splits (problem 1).

Method: each word of a record sets one bit of a code, kept as the places of its set bits (64-bit hashes) in order. Two word sets
that differ in d words have codes within Hamming distance d, and a Jaccard similarity of at least t allows
d <= (1-t)/(1+t) * (a+b) for sets of a and b words. The code of the held-out record is cut into r+1 segments of equal numbers of
set bits, r being that largest distance; as every differing bit spoils one segment at most, one segment at least stands unbroken in
the code of the other record. So records whose names agree, and of which one holds a segment of the other as a run of
neighbouring set bits, are candidates. A segment always holds bits (about four), so no key says that something is absent, and the
number of keys grows with the length of the texts only. Candidates within the Hamming radius of the code folded to 128 bits are
verified on the word sets. Unlike sampled bits, word bits never lose a pair: the distance of codes, folded or not, is never above
that of the sets.

Records are compared as classes (same names, same word set), so copies are not paired with each other; the pairs of
records are spelled out at the end only, as the result asks for them.

Cases: null or wordless sentences and names match nothing; empty tables give no pairs; a record delivered again counts once;
word sets of any size; repeated records each come out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folding import folded_words
from ..operators.deliveries import once_per_key
from ..session import once, settled, tune

SIMILARITY = 0.8
#: Bits of the folded code and of a word of it; sizes of sets of one band are within the factor ``BAND``.
FOLDED, WORD = 128, 64
BAND = 1.06


def _bits(words: Column) -> Column:
    """Places of the set bits of the code of a word set, ascending. Words of one hash, should there be any, keep a place each."""
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def _longs(bits: Column) -> list[Column]:
    """The folded code as longs."""
    low = F.transform(bits, lambda b: b.bitwiseAND(F.lit(FOLDED - 1)).cast("int"))

    def one(k: int) -> Column:
        own = F.filter(low, lambda b: F.shiftright(b, 6) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b % WORD)))

    return [one(k) for k in range(FOLDED // WORD)]


def hamming(a: str, b: str) -> Column:
    """Hamming distance of two codes given as columns a_0.. and b_0.."""
    parts = [F.bit_count(F.col(f"{a}_{k}").bitwiseXOR(F.col(f"{b}_{k}"))) for k in range(FOLDED // WORD)]
    return sum(parts[1:], parts[0])


def _band(n: int) -> int:
    """Band of a set of ``n`` words."""
    return math.floor(math.log(n) / math.log(BAND) + 1e-9)


@lru_cache(maxsize=65536)
def _plan(b: int, t: float) -> tuple[tuple[int, int, int], ...]:
    """For a set of ``b`` words: (band, number of segments, bits of a segment) for each band that similar sets can be in."""
    lo, hi = max(1, math.ceil(t * b - 1e-9)), math.floor(b / t + 1e-9)
    out = []
    for band in range(_band(lo), _band(hi) + 1):
        last = min(hi, math.floor(BAND ** (band + 1) + 1))
        r = math.floor((1 - t) / (1 + t) * (b + last) + 1e-9)
        if r < b:
            out.append((band, r + 1, b // (r + 1)))
    return tuple(out)


@lru_cache(maxsize=65536)
def _runs_of(a: int, t: float) -> tuple[int, ...]:
    """Lengths of runs that the segments of similar sets can have in a set of ``a`` words."""
    sizes = range(max(1, math.ceil(t * a - 1e-9)), math.floor(a / t + 1e-9) + 1)
    return tuple(sorted({k for b in sizes for band, _, k in _plan(b, t) if band == _band(a)}))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_sums(at: np.ndarray) -> np.ndarray:
    """Running sum of the bits' hashes, from 0: the content of the run [i, j) is the difference of both ends."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(at.view(np.uint64) + np.uint64(1)), dtype=np.uint64)])


def _keys(bits: pd.Series, names: pd.Series, t: float, probing: bool) -> pd.Series:
    """Keys of a code: its segments for each band, or all its runs of the lengths asked for in its own band."""
    out = []
    for places, name in zip(bits, names):
        n = len(places)
        sums = _run_sums(np.ascontiguousarray(places, np.int64))
        held = []
        for band, count, k in _plan(n, t) if probing else [(_band(n), n - k + 1, k) for k in _runs_of(n, t)]:
            start = np.arange(count) * k if probing else np.arange(count)
            salt = np.uint64(((band << 20) ^ (k << 8)) & 0xFFFFFFFFFFFFFFFF)
            held.append(_mix(_mix(sums[start + k] - sums[start]) + salt))
        keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
        out.append(np.unique(_mix(keys ^ np.uint64(name & 0xFFFFFFFFFFFFFFFF)).view(np.int64)))
    return pd.Series(out, dtype=object)


def block_keys(bits: Column, names: Column, t: float, probing: bool) -> Column:
    """Keys of the segments of a code, or of the runs that such segments are looked for in. ``names`` is a long."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(bits: pd.Series, names: pd.Series) -> pd.Series:
        return _keys(bits, names, t, probing)

    return keys(bits, names)


def prepared(records: DataFrame, key: str, split: str, a: str, b: str, text: str) -> DataFrame:
    """(key, side, split, names, cls_key, words): records that can match, with a digest of names and of names plus words."""
    one = once_per_key(records.select(key, split, a, b, text), key)
    side = F.when(F.col(split) == "train", 0).when(F.col(split).isin("validation", "test"), 1)
    named = lambda c: F.array_join(F.array_sort(folded_words(F.col(c))), " ")
    w = one.filter(side.isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(text).isNotNull())
    w = w.select(key, F.col(split).alias("split"), side.alias("side"), F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(text).alias("_t"))
    a, b, text = "_a", "_b", "_t"
    w = once(w, key, "split", "side", a=named(a), b=named(b), words=F.array_sort(F.array_distinct(folded_words(F.col(text)))))
    w = w.filter((F.col("a") != "") & (F.col("b") != "") & (F.size("words") > 0))
    names = F.concat_ws("\n", F.least("a", "b"), F.greatest("a", "b"))
    return w.select(key, "split", "side", F.unhex(F.md5(names)).alias("names"), F.unhex(F.md5(F.concat_ws("\n", names, F.array_join("words", " ")))).alias("cls_key"), "words")


def similar_classes(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(cls_a, cls_b, similarity): class pairs train x held-out with the same names and similar word sets."""
    t = similarity
    tune(rows.sparkSession)
    # names that stand on both sides; all other records end here
    sides = rows.groupBy("names").agg(F.min("side").alias("_lo"), F.max("side").alias("_hi")).filter("_lo < _hi").select("names")
    live = rows.join(sides, "names", "left_semi")
    # not by names, which would put all records of one pair of names into one task
    live = live.groupBy("side", "cls_key").agg(F.first("names").alias("names"), F.first("words").alias("words"))
    # a class travels as a number, given as it is written
    live = settled(live.withColumn("no", F.monotonically_increasing_id()), "classes")
    longs = [f"f_{k}" for k in range(FOLDED // WORD)]

    def keyed(side: int, p: str) -> DataFrame:
        part = live.filter(F.col("side") == side).select("no", F.xxhash64("names").alias("names"), F.size("words").alias("n"), _bits(F.col("words")).alias("bits"))
        part = part.select("no", "names", "n", "bits", *[c.alias(f"f_{k}") for k, c in enumerate(_longs(F.col("bits")))])
        part = part.select("no", "n", *longs, F.explode(block_keys(F.col("bits"), F.col("names"), t, side == 1)).alias("key"))
        return part.withColumnsRenamed({c: f"{p}_{c}" for c in ("no", "n")} | {c: f"{p}{c[1:]}" for c in longs})

    near = keyed(0, "a").join(keyed(1, "b"), "key").filter(hamming("a", "b") <= F.floor((F.col("a_n") + F.col("b_n")) * ((1 - t) / (1 + t)) + 1e-9))
    near = near.select("a_no", "b_no").distinct()
    wa = live.filter("side = 0").select(F.col("no").alias("a_no"), F.col("cls_key").alias("cls_a"), F.col("names").alias("na"), F.col("words").alias("wa"))
    wb = live.filter("side = 1").select(F.col("no").alias("b_no"), F.col("cls_key").alias("cls_b"), F.col("names").alias("nb"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    out = near.join(wa, "a_no").join(wb, "b_no").filter("na = nb").select("cls_a", "cls_b", (both / (F.size("wa") + F.size("wb") - both)).alias("similarity"))
    return out.filter(F.col("similarity") >= t - 1e-12)


def split_overlaps(records: DataFrame, key: str = "rec_id", split: str = "split_name", a: str = "entas", b: str = "entbs", text: str = "sentences", similarity: float = SIMILARITY) -> DataFrame:
    """(key_train, key_held, split, similarity): one train record and one of validation or test that overlap."""
    rows = settled(prepared(records, key, split, a, b, text), "records")
    pairs = similar_classes(rows, similarity)
    train = rows.filter("side = 0").select(F.col("cls_key").alias("cls_a"), F.col(key).alias(f"{key}_train"))
    held = rows.filter("side = 1").select(F.col("cls_key").alias("cls_b"), F.col(key).alias(f"{key}_held"), "split")
    return pairs.join(train, "cls_a").join(held, "cls_b").select(f"{key}_train", f"{key}_held", "split", "similarity")


def overlap_report(records: DataFrame, key: str = "rec_id", split: str = "split_name", source: str = "source", **kw) -> DataFrame:
    """(split, source, n_records, n_pairs): held-out records that overlap train, and their pairs, per split and source."""
    pairs = split_overlaps(records, key=key, split=split, **kw)
    src = once_per_key(records.select(key, F.col(source).alias("source")), key)
    joined = pairs.join(src, pairs[f"{key}_held"] == src[key])
    return joined.groupBy("split", "source").agg(F.countDistinct(f"{key}_held").alias("n_records"), F.count(F.lit(1)).alias("n_pairs"))
