"""Length-delimited protocol-buffer files as nested rows.

Spark's own protobuf functions need a jar that PySpark doesn't bundle and read one message of each value; these files are streams of
messages with a length before each. A message type is described by its fields, decoding follows the public wire format.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import tune

# The message types, by field number: name, kind (string, int or a message type) and whether it repeats.
TOKEN = {1: ("word", "string", False), 2: ("tag", "string", False), 3: ("ner", "string", False)}
MENTION = {1: ("id", "int", False), 2: ("entityGuid", "string", False), 3: ("from", "int", False), 4: ("to", "int", False), 5: ("label", "string", False)}
TREE = {1: ("root", "int", False), 2: ("head", "int", True), 3: ("relType", "string", True)}
SENTENCE = {1: ("tokens", TOKEN, True), 2: ("mentions", MENTION, True), 3: ("depTree", TREE, False)}
DOCUMENT = {1: ("filename", "string", False), 2: ("sentences", SENTENCE, True)}
RELATION_REF = {1: ("filename", "string", False), 2: ("sourceId", "int", False), 3: ("destId", "int", False), 4: ("feature", "string", True), 5: ("sentence", "string", False)}
RELATION = {1: ("sourceGuid", "string", False), 2: ("destGuid", "string", False), 3: ("relType", "string", False), 4: ("mention", RELATION_REF, True)}
ENTITY_REF = {1: ("filename", "string", False), 2: ("id", "int", False), 3: ("feature", "string", True)}
ENTITY = {1: ("guid", "string", False), 2: ("name", "string", False), 3: ("type", "string", False), 4: ("pred", "string", False), 5: ("mention", ENTITY_REF, True)}


def schema_of(message: dict) -> T.StructType:
    """Spark type of a message."""
    out = T.StructType()
    for name, kind, many in message.values():
        t = T.StringType() if kind == "string" else T.IntegerType() if kind == "int" else schema_of(kind)
        out.add(name, T.ArrayType(t) if many else t)
    return out


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _int32(v: int) -> int:
    v &= 0xFFFFFFFF
    return v - (1 << 32) if v >= 1 << 31 else v


def decode(data: bytes, message: dict) -> dict:
    """One message; unknown fields are skipped, packed numbers accepted, missing fields None or empty lists."""
    out: dict = {name: [] if many else None for name, _, many in message.values()}
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field ends beyond its message")
            raw, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            raw, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} isn't supported")
        if number not in message:
            continue
        name, kind, many = message[number]
        if kind == "int" and wire == 2:
            values, i = [], 0
            while i < len(raw):
                v, i = _varint(raw, i)
                values.append(_int32(v))
        else:
            values = [raw.decode("utf-8", "replace") if kind == "string" else _int32(raw) if kind == "int" else decode(raw, kind)]
        if many:
            out[name] += values
        elif values:
            out[name] = values[-1]
    return out


def encode(row: dict, message: dict) -> bytes:
    """The reverse of ``decode``, without the length."""

    def varint(v: int) -> bytes:
        v &= (1 << 64) - 1
        out = bytearray()
        while v > 0x7F:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        return bytes([*out, v])

    parts = []
    for number, (name, kind, many) in message.items():
        value = row.get(name)
        for v in (value or []) if many else [] if value is None else [value]:
            if kind == "int":
                parts.append(varint(number << 3) + varint(v))
            else:
                body = v.encode() if kind == "string" else encode(v, kind)
                parts.append(varint(number << 3 | 2) + varint(len(body)) + body)
    return b"".join(parts)


def delimited(rows: list[dict], message: dict) -> bytes:
    """A stream of messages, each behind its length."""
    out = []
    for r in rows:
        body = encode(r, message)
        n, size = len(body), bytearray()
        while n > 0x7F:
            size.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(bytes([*size, n]) + body)
    return b"".join(out)


def encoded(df: DataFrame, message: dict, keys: list[str], name: str = "data") -> DataFrame:
    """[S13] The keys and each row's fields as one message in the binary column ``name``. Missing fields are left out."""
    tune(df.sparkSession)
    schema = T.StructType([df.schema[k] for k in keys]).add(name, T.BinaryType())
    fields = [n for n, _, _ in message.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(fields).to_pylist()
            data = pa.array([encode(r, message) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], data], names=[*keys, name])

    return df.select(*keys, *fields).mapInArrow(run, schema)


def decoded(df: DataFrame, message: dict, keys: list[str], name: str = "data") -> DataFrame:
    """[S13] The keys and the fields of the message in the binary column ``name``; a null message has null fields."""
    tune(df.sparkSession)
    schema = T.StructType([*[df.schema[k] for k in keys], *schema_of(message).fields])
    own = to_arrow_schema(schema_of(message))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict.fromkeys(own.names) if x is None else decode(x, message) for x in batch.column(name).to_pylist()]
            part = pa.Table.from_pylist(rows, schema=own).combine_chunks()
            columns = [part.column(c).chunk(0) if len(rows) else pa.array([], own.field(c).type) for c in own.names]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *columns], names=[*keys, *own.names])

    return df.select(*keys, name).mapInArrow(run, schema)


def read(spark: SparkSession, path: str, message: dict) -> DataFrame:
    """[S13] (file, no, fields of the message): all messages of the files below ``path``, numbered within each file.

    A file is decoded by one task, message by message, in batches of 1000 rows; files are spread over tasks.
    """
    tune(spark)
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("no", T.LongType()), *schema_of(message).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                data, at, no, rows = bytes(data), 0, 0, []
                while at < len(data):
                    size, at = _varint(data, at)
                    rows.append({"file": file, "no": no, **decode(data[at : at + size], message)})
                    at, no = at + size, no + 1
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=schema.names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, schema)
