"""Deeply nested records into related flat tables (problem 4).

A merged schema of all inputs is inferred; every array level then becomes a child table that is exploded from its parent,
and carries the parent's surrogate key (the root's key columns and the ordinals down to the parent) and its own ordinal
from 0. Structs are flattened into their table with joined names.

Cases: a null or empty array has no child rows; null elements keep their place and come out as rows of nulls; optional fields
that an input lacks are null; columns that would clash get a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDER = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def merge_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: fields united, numbers widened, anything else as text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f for f in b.fields}
        mine = [T.StructField(f.name, merge_types(f.dataType, other.pop(f.name).dataType) if f.name in other else f.dataType) for f in a.fields]
        return T.StructType(mine + [T.StructField(f.name, f.dataType) for f in b.fields if f.name in other])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_types(a.elementType, b.elementType))
    if a in _WIDER and b in _WIDER:
        return _WIDER[max(_WIDER.index(a), _WIDER.index(b))]
    return T.StringType()


def _fit(col: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return col
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        names = {f.name: f.dataType for f in have.fields}
        fields = [(_fit(col.getField(f.name), names[f.name], f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(col, lambda x: _fit(x, have.elementType, want.elementType))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    return col.cast(want)


def merged(inputs: list[DataFrame]) -> DataFrame:
    """All inputs under one schema that holds each of them."""
    schema = inputs[0].schema
    for df in inputs[1:]:
        schema = merge_types(schema, df.schema)
    out = None
    for df in inputs:
        have = {f.name: f.dataType for f in df.schema.fields}
        one = df.select(*[(_fit(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
        out = one if out is None else out.unionByName(one)
    return out


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    taken.add(name)
    return name


def pruned(schema: T.StructType, paths: list[str]) -> T.StructType:
    """The part of a schema that the dotted ``paths`` name, through structs and arrays; for reading no more than that."""

    def part(kind: T.DataType, tails: list[str]) -> T.DataType:
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(part(kind.elementType, tails), kind.containsNull)
        if not isinstance(kind, T.StructType) or "" in tails:
            return kind
        heads: dict[str, list[str]] = {}
        for t in tails:
            head, _, rest = t.partition(".")
            heads.setdefault(head, []).append(rest)
        return T.StructType([T.StructField(f.name, part(f.dataType, heads[f.name]), f.nullable) for f in kind.fields if f.name in heads])

    return part(schema, paths)


def flatten(df: DataFrame, key: list[str], root: str = "root", carry: dict[str, dict[str, Callable[[Column], Column]]] | None = None) -> dict[str, DataFrame]:
    """Path of each level -> flat table. ``key`` identifies a row of ``df``. The table of ``a.b`` has the key columns, the
    ordinals ``a_no`` and ``a.b``'s own ``b_no``, the scalar fields of its elements (``value`` for an array of scalars) and
    ``<array>_size`` for each array below. ``carry`` names, for a path, columns that its table takes over from the parent's element (for what
    would otherwise need a join with it). Lazy: a table that isn't used costs nothing, and a scan reads its fields only."""
    carry = carry or {}
    tables: dict[str, DataFrame] = {}

    def table(path: str, rows: DataFrame, keys: list[str], at: str | None, kind: T.StructType) -> None:
        taken, flat, below = set(keys), [], []

        def fields(col: Column, struct: T.StructType, prefix: str, dotted: str) -> None:
            for f in struct.fields:
                if at is None and not prefix and f.name in key:
                    continue
                c = col.getField(f.name) if col is not None else F.col(f"`{f.name}`")
                if isinstance(f.dataType, T.StructType):
                    fields(c, f.dataType, f"{prefix}{f.name}_", f"{dotted}{f.name}.")
                elif isinstance(f.dataType, T.ArrayType):
                    flat.append(F.when(c.isNotNull(), F.size(c)).alias(_free(f"{prefix}{f.name}_size", taken)))
                    below.append((f"{dotted}{f.name}", c, f.name, f.dataType.elementType))
                else:
                    flat.append(c.alias(_free(prefix + f.name, taken)))

        fields(F.col(at) if at else None, kind, "", "")
        tables[path] = rows.select(*keys, *flat)
        for name, c, short, element in below:
            child = name if path == root else f"{path}.{name}"
            no = _free(f"{short}_no", set(keys))
            over = {n: f(F.col(at)) for n, f in carry.get(child, {}).items()} if at else {}
            step = rows.select(*keys, *[x.alias(n) for n, x in over.items()], F.posexplode(c).alias(no, "_e"))
            if isinstance(element, T.StructType):
                table(child, step, [*keys, no, *over], "_e", element)
            elif isinstance(element, T.ArrayType):
                inner = step.select(*keys, no, F.struct(F.col("_e").alias("items")).alias("_e"))
                table(child, inner, [*keys, no], "_e", T.StructType([T.StructField("items", element)]))
            else:
                tables[child] = step.select(*keys, no, F.col("_e").alias(_free("value", {*keys, no})))

    table(root, df, list(key), None, df.schema)
    return tables


#: What a mention's row takes over from its sentence, so that its tokens need no join.
OF_SENTENCE = {"sentences.mentions": {"_n": lambda s: s["tokens_size"], "_heads": lambda s: s["deptree"]["head"]}}


def sentence_parts(sentences: Column) -> Column:
    """What ``mention_tokens`` needs of an array of parsed sentences: the number of tokens in place of the tokens, the mentions' places and the
    heads. Null sentences keep their place."""
    mention = lambda m: F.struct(m["id"].alias("id"), m["tok_from"].alias("tok_from"), m["tok_to"].alias("tok_to"))
    size = lambda s: F.when(s["tokens"].isNotNull(), F.size(s["tokens"]))
    one = lambda s: F.struct(size(s).alias("tokens_size"), F.transform(s["mentions"], mention).alias("mentions"), F.struct(s["deptree"]["head"].alias("head")).alias("deptree"))
    return F.transform(sentences, lambda s: F.when(s.isNotNull(), one(s)))


def mention_tokens(docs: DataFrame, key: str) -> DataFrame:
    """(key, sent_no, mention_id, tok_no, head_no) of each token inside a mention of its sentence. ``docs`` has the key and ``sentences`` as
    ``sentence_parts`` gives them, so that no more than that need be shuffled before.

    The mention table takes the number of tokens and the heads over from the sentence it stands in; its places, cut at that number, are listed
    and each takes its head by place. So nothing is joined, and no mention is compared with the tokens outside it. The null ``key`` is one like
    any other.
    """
    spans = flatten(docs.select(key, "sentences"), [key], "documents", OF_SENTENCE)["sentences.mentions"]
    lo, hi = F.greatest("tok_from", F.lit(0)), F.least("tok_to", "_n")
    places = spans.filter(F.col("tok_from").isNotNull() & F.col("tok_to").isNotNull() & (F.col("_n") > 0) & (lo < hi))
    out = places.select(key, "sentences_no", F.col("id").alias("mention_id"), "_heads", F.explode(F.sequence(lo, hi - 1)).alias("tok_no"))
    return out.select(key, F.col("sentences_no").alias("sent_no"), "mention_id", "tok_no", F.coalesce(F.get("_heads", F.col("tok_no")), F.lit(-1)).alias("head_no"))
