"""Token ids of a whole corpus by a public byte-level BPE vocabulary (problem 8).

Method: a text is cut into pieces by the vocabulary's pattern; the byte positions of a piece are the leaves of a segment
tree that holds, for each live position, the rank of the pair that starts there, and in each inner node the leftmost
position of the least rank. A merge takes the root's position, joins it to its live right neighbour and updates the
leaves of the two pairs it changed and of the one it ended: O(log n) each, so a piece of n bytes costs O(n log n), also
where a text is one run of a million letters.

Cases: null and empty texts give an empty list; the strings of special tokens are ordinary text; texts of any length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import tune

#: Default place of the vocabulary (token in base64, rank); a parameter of every function here.
VOCABULARY = os.environ.get("FACTLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pattern that cuts a text into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers, and the longest it remembers; beyond that they are worked out again.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64
_NONE = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Vocabulary file -> rank of each token, which is its id."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    ends = list(range(1, n + 1))  # ends[i]: where the live part that starts at i ends
    back = list(range(-1, n - 1))  # back[i]: start of the live part before i
    rank = [_NONE] * size
    get = ranks.get
    for i in range(n - 1):
        rank[i] = get(piece[i : i + 2], _NONE)
    # tree[k] for an inner node k: the leftmost position of the least rank below it; leaves are size..2*size-1
    tree = [0] * size + list(range(size))
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = b if rank[b] < rank[a] else a

    def update(i: int, value: int) -> None:
        rank[i] = value
        k = (i + size) >> 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = b if rank[b] < rank[a] else a
            k >>= 1

    while rank[i := tree[1]] != _NONE:
        j = ends[i]
        end = ends[i] = ends[j]
        if end < n:
            back[end] = i
        update(j, _NONE)
        update(i, get(piece[i : ends[end]], _NONE) if end < n else _NONE)
        if (p := back[i]) >= 0:
            update(p, get(piece[p:end], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Encoder:
    """Encodes texts in one worker; pieces that were met are remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.pieces, self.known = ranks, regex.compile(pattern), {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for m in self.pieces.findall(text):
            ids = known.get(m)
            if ids is None:
                ids = merge_piece(m.encode(), self.ranks)
                if len(m) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[m] = ids
            out += ids
        return out


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids ARRAY<INT>): one row for each row of ``docs``. A scan and one Arrow pass; nothing is shuffled.

    The vocabulary file (under 1 MB, checked) is read by the driver and sent to the workers, so only the driver needs it.
    """
    spark = docs.sparkSession
    tune(spark)
    data = open(vocabulary, "rb").read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary of more than 64 MB is not sent to workers")
    sent = spark.sparkContext.broadcast(data)
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(sent.value), pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, 500):
                lists = [encoder.encode(t.as_py()) for t in texts.slice(start, 500)]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([keys.slice(start, 500), ids], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)
