"""Cross-split overlaps against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from factloom.functions.folding import fold_text
from factloom.llm import overlap

SCHEMA = "rec_id bigint, split_name string, source string, entas string, entbs string, sentences string, words string, cls int"


def _brute(rows):
    import re

    w = lambda s: sorted(re.findall(r"[^\W_]+", fold_text(s)))
    seen = {}
    for r in rows:
        if r[0] is None:
            continue
        seen.setdefault(r[0], r)
    out = set()
    keep = [(r, sorted([" ".join(w(r[3])), " ".join(w(r[4]))]), set(w(r[5]))) for r in seen.values() if None not in (r[3], r[4], r[5])]
    for a, na, sa in keep:
        for b, nb, sb in keep:
            if a[1] == "train" and b[1] in ("validation", "test") and na == nb and "" not in na and sa and sb and 5 * len(sa & sb) >= 4 * len(sa | sb):
                out.add((a[0], b[0]))
    return out


def test_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["Çà", "l'été"]
    base = [r.sample(vocab, r.choice([1, 2, 3, 5, 9, 10, 20, 33, 50])) for _ in range(12)]
    rows = []
    for i in range(400):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            words[r.randrange(len(words))] = r.choice(vocab)
        names = ["José  Ruiz", "Al"] if r.random() < 0.8 else [f"n{i % 7}", "Al"]
        if r.random() < 0.4:
            names = ["AL", names[0].upper()]
        rows.append((i, r.choice(["train", "train", "validation", "test", "other", None]), "s", *names, " , ".join(words), "x", 3))
    rows += [(900, "train", "s", None, "Al", "a b", "x", 1), (901, "test", "s", "Al", "Bo", None, "x", 1), (902, "test", "s", "", "Bo", "a b", None, 1), (903, "train", "s", "", "Bo", "a b", "x", 1)]
    rows += [(904, "train", "s", "Al", "Bo", "", "x", 1), (905, "test", "s", "Al", "Bo", "...", "x", 1)]
    long = " ".join(f"v{i}" for i in range(5000))
    rows += [(906, "train", "s", "Al", "Bo", long, "x", 1), (907, "test", "s", "Bo", "Al", long + " extra words here", "x", 1), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1]) for r in overlap.split_overlaps(df).select("rec_id_train", "rec_id_held").collect()}
    want = _brute(rows)
    assert got == want and (906, 907) in got and len(want) > 100


def test_long_records(spark):
    r = random.Random(9)
    rows = []
    for i in range(60):
        size = r.choice([45, 52, 53, 60, 66, 80, 150, 600])
        base = random.Random(size)
        words = [f"w{base.randrange(2000)}" for _ in range(size)]
        for _ in range(r.randrange(size // 6)):
            words[r.randrange(size)] = f"x{r.randrange(50)}"
        rows.append((i, "train" if i % 2 else "test", "s", "Al", "Bo", " ".join(words), "x", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x[0], x[1]) for x in overlap.split_overlaps(df).select("rec_id_train", "rec_id_held").collect()}
    assert got == _brute(rows) and len(got) > 40


def test_copies_and_report(spark):
    rows = [(i, "train", "s", "Al", "Bo", "one two three", None, 1) for i in range(300)] + [(1000 + i, "test", "t" if i else None, "Bo", "Al", "One, two; THREE", None, 1) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert overlap.split_overlaps(df).count() == 900
    assert sorted(((r.split, r.source, r.n_records, r.n_pairs) for r in overlap.overlap_report(df).collect()), key=str) == [("test", "t", 2, 600), ("test", None, 1, 300)]
    assert overlap.split_overlaps(df.limit(0)).count() == 0


def _candidates(spark, n):
    """Candidate pairs of ``n`` records a side, of 100 words that don't overlap much, under one pair of names."""
    r = random.Random(n)
    vocab = [f"w{i}" for i in range(5000)]
    common = [f"c{i}" for i in range(20)]
    rows = []
    for i in range(2 * n):
        rows.append((i, "train" if i % 2 else "test", "s", "Al", "Bo", " ".join(r.sample(vocab, 90) + r.sample(common, 10)), "x", 1))
    df = overlap.prepared(spark.createDataFrame(rows, SCHEMA), "rec_id", "split_name", "entas", "entbs", "sentences")
    w = df.select("side", "rec_id", F.xxhash64("names").alias("names"), overlap._bits(F.col("words")).alias("bits"))
    keys = lambda side: w.filter(F.col("side") == side).select("rec_id", F.explode(overlap.block_keys(F.col("bits"), F.col("names"), 0.8, side == 1)).alias("key"))
    return keys(0).withColumnRenamed("rec_id", "other").join(keys(1), "key").select("rec_id", "other").distinct().count()


def test_unrelated_records_of_one_pair_of_names_are_hardly_candidates(spark):
    """Up to a million pairs of records share ten common words of a hundred; next to none may be compared."""
    assert all(_candidates(spark, n) < n / 20 for n in (250, 500, 1000))


def test_segments_find_all_similar_sets():
    """A segment of one set is a run of the other whenever they are similar enough, at every size."""
    import numpy as np
    import pandas as pd

    r = random.Random(8)
    for n in [*range(1, 60), 100, 333, 1500, 5000]:
        for _ in range(6):
            a = {r.getrandbits(63) for _ in range(n)}
            out, new = r.randrange(n // 5 + 1), r.randrange(n // 4 + 1)
            b = set(sorted(a, key=lambda x: (x * 2654435761) % 1000003)[out:]) | {r.getrandbits(63) for _ in range(new)}
            if not b or len(a & b) < 0.8 * len(a | b):
                continue
            key = lambda x, probing: set(overlap._keys(pd.Series([np.array(sorted(x), np.int64)]), pd.Series([7]), 0.8, probing)[0].tolist())
            assert key(a, False) & key(b, True) and key(b, False) & key(a, True), (n, len(b))
