"""Dependency trees and paths: finding a path between two tokens, its junk test, rendering it as a phrase, heads and contexts.

Trees are parent-index arrays; all functions are Arrow-batched pandas UDFs, as a walk of unbounded length up a tree or along a
path is no Column expression.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shipped

# How steps of a path read, tried in this order at each place. A star in the pattern takes one step along. Each rule adds words:
# "after" or "before" the words so far, or at the "end" or the "start of end" of the words that close the phrase; "1" and "2" are the starred steps.
RENDERING = [
    ("<- nsubjpass <-", (("after", "was"),)),
    ("-> nsubj ->", ()),
    ("<- nsubj <-", ()),
    ("<- nn <-", ()),
    ("-> dobj ->", ()),
    ("-> rcmod ->", (("after", "who"),)),
    ("-> partmod ->", ()),
    ("* -> amod ->", (("end", "1"),)),
    ("<- amod <-", (("after", ","),)),
    ("-> advmod ->", (("after", ","),)),
    ("<- appos <- *", (("before", "1"),)),
    ("* -> dep ->", (("after", "1"),)),
    ("<- dep <-", ()),
    ("* -> pobj ->", (("after", "1"),)),
    ("-> iobj ->", (("end", "something"),)),
    ("<- iobj <- *", (("before", "1"), ("before", "something"))),
    ("-> prep -> * -> pobj ->", (("after", "1"),)),
    ("-> prep -> * -> dep -> * -> pobj ->", (("after", "1"), ("after", "2"))),
    ("<- pobj <- * <- prep <- *", (("before", "1"), ("before", "2"))),
    ("<- dobj <- *", (("before", "1"),)),
    ("-> appos ->", (("after", ","),)),
    ("<- poss <-", (("after", "'s"),)),
    ("* -> poss ->", (("start of end", "1"), ("start of end", "'s"))),
    ("* -> nn ->", (("start of end", "1"),)),
    ("be", (("after", "is"),)),
    ("*", (("after", "1"),)),
]
_RULES = [(pattern.split(), adds) for pattern, adds in RENDERING]
_STEP = re.compile(r"->|<-|(?:(?!->|<-).)+")

# What makes a path junk, and parts of names that are read as entity tokens.
FEASIBLE_TAGS = set("NN NNP NNS NNPS VB VBD VBZ VBG VBN VBP RB RBR RBS IN TO JJ JJR JJS PRP PRP$".split())
NAME_SUFFIXES = set("Jr. II Jr d.l. D.L. d.l D.L".split())
JUNK_LABELS = set("conj ccomp parataxis xcomp pcomp advcl punct infmod cop abbrev neg det prt".split())
CONTENT_TAGS = set("NN NNP NNS NNPS VB VBD VBZ VBG VBN VBP PRP PRP$ RB RBR RBS JJ JJR JJS".split())
JUNK_ROOTS = set("say describe tell".split())


def render(path: str | None, a: str = "_enta", b: str = "_entb") -> str | None:
    """Phrase of a path ``label|steps|label``, with the names at its ends; ``:INV`` swaps them. Null for anything else."""
    parts = (path or "").split("|")
    if len(parts) != 3:
        return None
    left, right = (b, a) if parts[2].endswith("INV") else (a, b)
    steps = [left, *_STEP.findall(parts[1]), right]
    words: list[str] = []
    closing: list[str] = []
    at = 0
    while at < len(steps):
        for pattern, adds in _RULES:
            piece = steps[at : at + len(pattern)]
            if len(piece) == len(pattern) and all(p in ("*", s) for p, s in zip(pattern, piece)):
                break
        taken = [s for p, s in zip(pattern, piece) if p == "*"]
        for side, what in adds:
            word = taken[int(what) - 1] if what.isdigit() else what
            target = words if side in ("after", "before") else closing
            target.insert(0 if side in ("before", "start of end") else len(target), word)
        at += len(pattern)
    return " ".join(words + closing)


@shipped
@F.pandas_udf(T.StringType())
def render_udf(path: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """``render`` of each row."""
    return pd.Series([render(p, x or "_enta", y or "_entb") for p, x, y in zip(path, a, b)], dtype=object)


def ancestors(head: list[int | None], at: int) -> list[int]:
    """A token and its ancestors up to the root; ends at a null or outside parent, and at a cycle."""
    out = []
    while at is not None and 0 <= at < len(head) and at not in out:
        out.append(at)
        at = head[at]
    return out


def _at(xs: list[str | None] | None, i: int) -> str:
    return (xs[i] if xs is not None and 0 <= i < len(xs) else None) or ""


def tree_path(head: list[int | None], labels: list[str | None], words: list[str | None], source: int, dest: int, ner: list[str | None] | None = None) -> tuple[str, int, list[int]] | None:
    """(path string, lowest common ancestor, tokens on the path) between two tokens; None where the tree doesn't join them.

    A token of an entity, or a suffix of a name, is read as its entity tag (``O`` for a suffix outside one), any other as its word. Lower case.
    """
    up, down = ancestors(head, source), ancestors(head, dest)
    common = next((x for x in up if x in down), None)
    if common is None:
        return None

    def read(i: int) -> str:
        tag = _at(ner, i) or "O"
        return tag if tag != "O" or ner is not None and _at(words, i) in NAME_SUFFIXES else _at(words, i)

    rise, fall = up[: up.index(common)], down[: down.index(common)][::-1]
    text = "".join(("" if i == source else read(i)) + f"<-{_at(labels, i)}<-" for i in rise)
    text += "" if common in (source, dest) else read(common)
    text += "".join(f"->{_at(labels, i)}->" + ("" if i == dest else read(i)) for i in fall)
    return text.lower(), common, [*rise, common, *fall]


def is_junk(on_path: list[int], common: int, labels: list[str | None], words: list[str | None], tags: list[str | None]) -> bool:
    """[P13] Whether a path says nothing: a tag other than those of words that can link, a junk label, a root of saying, fewer than two content
    words, quotes or brackets, an adverb first, or subjects or names at both ends."""
    steps = [i for i in on_path if i != common]
    ls = {i: _at(labels, i).lower() for i in steps}
    if any(_at(tags, i) not in FEASIBLE_TAGS for i in steps) or any(x in JUNK_LABELS for x in ls.values()) or _at(words, common).lower() in JUNK_ROOTS:
        return True
    if sum(_at(tags, i) in CONTENT_TAGS for i in on_path) < 2 or any(_at(words, i) in ("?", '"', "[") for i in on_path):
        return True
    first, last = ls.get(on_path[0]), ls.get(on_path[-1])
    return first == "adv" or first == last and first in ("name", "sbj")


PATH_TYPE = T.StructType([T.StructField("path", T.StringType()), T.StructField("root", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("junk", T.BooleanType())])


@shipped
@F.pandas_udf(PATH_TYPE)
def path_udf(head: pd.Series, labels: pd.Series, words: pd.Series, tags: pd.Series, ner: pd.Series, source: pd.Series, dest: pd.Series) -> pd.DataFrame:
    """[F23, P13] Path between two tokens of a sentence, its root word, number of tokens and whether it is junk."""
    rows = []
    for h, ls, ws, ts, ns, s, d in zip(head, labels, words, tags, ner, source, dest):
        none = h is None or ws is None or pd.isna(s) or pd.isna(d) or s == d
        h, ls, ws, ts = ([None if pd.isna(x) else int(x) for x in h], [] if ls is None else list(ls), list(ws), [] if ts is None else list(ts)) if not none else ([], [], [], [])
        found = None if none else tree_path(h, ls, ws, int(s), int(d), [] if ns is None else list(ns))
        if found is None:
            rows.append((None, None, None, None))
        else:
            text, common, on = found
            rows.append((text, ws[common] if common < len(ws) else None, len(on), is_junk(on, common, ls, ws, ts)))
    return pd.DataFrame(rows, columns=["path", "root", "length", "junk"]).astype({"length": "Int32", "junk": "boolean"})


def head_of_span(head: list[int | None], start: int, end: int) -> int:
    """The largest of the highest ancestors within [start, end) of the tokens of a span; ``start`` if there is none."""
    best = start
    for i in range(start, end):
        seen = {i}
        while 0 <= i < len(head) and head[i] is not None and start <= head[i] < end and head[i] not in seen:
            i = head[i]
            seen.add(i)
        best = max(best, i)
    return best


@shipped
@F.pandas_udf(T.IntegerType())
def span_head_udf(head: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """Head token of each span; null where the tree or an end is null or the span is empty."""
    out = []
    for h, s, e in zip(head, start, end):
        ok = h is not None and not pd.isna(s) and not pd.isna(e) and s < e
        out.append(head_of_span([None if pd.isna(x) else int(x) for x in h], int(s), int(e)) if ok else None)
    return pd.Series(out, dtype="Int32")


def surface_spans(phrase: str, words: list[str | None], ner: list[str | None], head: list[int | None]) -> list[tuple[int, int]]:
    """Spans [start, end) where a phrase may stand in a sentence: from each entity token whose word is part of the phrase, or is its
    abbreviation, up the tree as long as the parent's word is part of the phrase."""
    parts = [w for w in re.split(r"[-\s]", phrase) if w]
    short = "".join(w[0] for w in parts)
    part_of = lambda i: i < len(words) and bool(words[i]) and words[i] in phrase
    out = []
    for i, word in enumerate(words):
        if not word or (i < len(ner) and ner[i] or "O") == "O" or not (part_of(i) or (short.isupper() and word == short)):
            continue
        top, seen = i, {i}
        while top < len(head) and head[top] is not None and 0 <= head[top] and part_of(head[top]) and head[top] not in seen:
            top = head[top]
            seen.add(top)
        out.append((min(i, top), max(i, top) + 1))
    return out


def nearest_surface_span(phrase: str, words: list[str | None], ner: list[str | None], head: list[int | None], slot: tuple[int, int]) -> tuple[int, int] | None:
    """Of the spans of a phrase the one whose head is nearest to the slot's, the first of equal ones."""
    at = head_of_span(head, *slot)
    return min(surface_spans(phrase, words, ner, head), key=lambda s: abs(head_of_span(head, *s) - at), default=None)


SPAN_TYPE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@shipped
@F.pandas_udf(SPAN_TYPE)
def surface_udf(phrase: pd.Series, words: pd.Series, ner: pd.Series, head: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """Span of a phrase nearest to a slot [start, end); nulls where there is none."""
    rows = []
    for p, w, n, h, s, e in zip(phrase, words, ner, head, start, end):
        if not p or w is None or pd.isna(s) or pd.isna(e):
            rows.append((None, None))
            continue
        h = [] if h is None else [None if pd.isna(x) else int(x) for x in h]
        rows.append(nearest_surface_span(p, list(w), [] if n is None else list(n), h, (int(s), int(e))) or (None, None))
    return pd.DataFrame(rows, columns=["start", "end"]).astype("Int32")


def _text(toks: Column) -> Column:
    return F.array_join(F.transform(toks, lambda t: t["word"]), " ")


def _outside(toks: Column) -> Column:
    return F.filter(toks, lambda t: F.coalesce(t["ner"], F.lit("O")) == "O")


def between_context(toks: Column, end: Column, start: Column) -> tuple[Column, Column, Column]:
    """Words between two spans: without entity tokens, all of them, and their tags."""
    part = F.slice(toks, end + 1, F.greatest(start - end, F.lit(0)))
    return _text(_outside(part)), _text(part), F.array_join(F.transform(part, lambda t: t["tag"]), " ")


def neighbour_context(toks: Column, start: Column, end: Column, n: int = 2) -> tuple[Column, Column]:
    """Up to ``n`` words before the first span and behind the second, entity tokens left out."""
    lo = F.greatest(start - n, F.lit(0))
    return _text(_outside(F.slice(toks, lo + 1, start - lo))), _text(_outside(F.slice(toks, end + 1, F.lit(n))))


def pair_features(path: Column, junk: Column, length: Column, gap: Column, apart: Column, kinds: tuple[Column, Column], between: tuple[Column, Column, Column]) -> Column:
    """Features of a mention pair for training, as an array: its path (not junk, fewer than ten tokens) as ``path#``; its entity types as
    ``type#``; where fewer than 11 tokens lie between, the words and tags there, alone and with the types. A pair without such a path whose heads
    are more than ten tokens ``apart`` has none. ``between`` is what ``between_context`` gives."""
    good = F.coalesce(~junk & (length < 10), F.lit(False))
    a, b = (F.coalesce(k, F.lit("O")) for k in kinds)
    lex, full, tags = between
    close = (gap < 11) & ((F.length(lex) > 0) | (F.length(full) > 0))
    some = lambda name, text: F.when(close & (F.length(text) > 0), F.concat(F.lit(name), text))
    typed = lambda name, text: F.when(close, F.concat(F.lit(name), a, F.lit("|"), text, F.lit("|"), b))
    every = F.array(
        F.when(good & (F.length(path) > 0), F.concat(F.lit("path#"), path)), F.concat(F.lit("type#"), a, F.lit("->"), b),
        some("lex#", lex), some("lex#", full), some("pos#", tags), typed("lex-ner#", lex), typed("pos-ner#", tags),
    )
    kept = F.filter(every, lambda x: x.isNotNull() & ~F.contains(x, F.lit("javascript")))
    return F.when(~good & (apart > 10), F.array().cast("array<string>")).otherwise(kept)


def link_features(path: Column, junk: Column, length: Column, gap: Column, kinds: tuple[Column, Column], between: tuple[Column, Column, Column]) -> Column:
    """Features of an ordered mention pair for linking, each marked ``/2``: the words between, if fewer than 20 tokens, behind an arrow; the
    path (not junk, fewer than six tokens) and the types beside it."""
    good = F.coalesce(~junk & (length < 6), F.lit(False))
    a, b = (F.coalesce(k, F.lit("NA")) for k in kinds)
    lex, full, _ = between
    every = F.array(F.when(gap < 20, F.concat(F.lit("->"), F.concat_ws(" ", lex, full))), F.when(good, path), F.when(good, F.concat(a, F.lit("->"), b)))
    return F.transform(F.filter(every, lambda x: (F.length(x) > 0) & ~F.contains(x, F.lit("javascript"))), lambda x: F.concat(x, F.lit("/2")))
