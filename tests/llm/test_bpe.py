"""Token ids against the public library, and decoding back."""

from __future__ import annotations

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe

RANKS = bpe.read_ranks(open(bpe.VOCABULARY, "rb").read())
PUBLIC = tiktoken.Encoding("public", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BACK = {i: t for t, i in RANKS.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(s):
    ids = bpe.Encoder(RANKS).encode(s)
    assert ids == PUBLIC.encode_ordinary(s) and b"".join(BACK[i] for i in ids).decode() == s


def test_long_piece():
    s = "ab" * 20_000 + "é" * 5_000 + " " * 3_000
    assert bpe.Encoder(RANKS).encode(s) == PUBLIC.encode_ordinary(s)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    e = bpe.Encoder(RANKS)
    text = " ".join(f"zq{i}x" for i in range(200))
    assert e.encode(text) == PUBLIC.encode_ordinary(text) and len(e.known) <= 10


def test_table(spark):
    texts = ["<|endoftext|> it's", "", None, "x" * 200_000, "漢字 ​", "<|endoftext|> it's"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no key", 1)], "doc_id bigint, text string, ids int")
    out = bpe.encode_corpus(df)
    assert out.columns == ["doc_id", "ids"]
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got == {i: PUBLIC.encode_ordinary(t) if t else [] for i, t in enumerate(texts)} | {None: PUBLIC.encode_ordinary("no key")}
    assert bpe.encode_corpus(df.limit(0)).count() == 0
