"""Semantic documents in their binary form (protocol buffers, proto3) and as block tables.

A document holds lists of blocks; every kind of block is a table here. The wire format is small, so it is read and written here
without the runtime library, and fields that are not known survive a round trip.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names, numbers and types of the fields; ? marks one that may be absent, * a list.
MESSAGES = {
    "BBox": "x 1 float, y 2 float, w 3 float, h 4 float",
    "PixelRef": "t_start 1 int64, t_end 2 int64, frame_id 3 int64?, bbox 4 BBox",
    "Entity": "id 1 uint64, type 2 string, first_seen 3 int64, last_seen 4 int64, layer 14 enum, pixel_ref 15 PixelRef",
    "ObjectBlock": "entity_id 1 uint64, class 2 string, bbox 3 BBox, confidence 4 float?, timestamp 5 int64, layer 14 enum, pixel_ref 15 PixelRef",
    "TextBlock": "content 1 string, bbox 2 BBox, confidence 3 float?, timestamp 4 int64, layer 14 enum, pixel_ref 15 PixelRef",
    "ActionBlock": "subject_id 1 uint64, action 2 string, start 3 int64, end 4 int64, confidence 5 float?, layer 14 enum, pixel_ref 15 PixelRef",
    "EventBlock": "type 1 string, start 2 int64, end 3 int64, entity_ids 4 uint64*, region 5 BBox, confidence 6 float?, layer 14 enum, pixel_ref 15 PixelRef",
    "RelationBlock": "subject_id 1 uint64, relation 2 string, object_id 3 uint64, start 4 int64, end 5 int64, confidence 6 float?, id 7 uint64, layer 14 enum, pixel_ref 15 PixelRef",
    "AttributeBlock": "entity_id 1 uint64, key 2 string, value 3 string, start 4 int64, end 5 int64, confidence 6 float?, layer 14 enum, pixel_ref 15 PixelRef",
    "SceneBlock": "label 1 string, context 2 string, start 3 int64, end 4 int64, layer 14 enum, pixel_ref 15 PixelRef",
    "TemporalBlock": "kind 1 enum, t_start 2 int64, t_end 3 int64, base_t 4 int64, active_entity_ids 5 uint64*, added_entity_ids 6 uint64*, removed_entity_ids 7 uint64*, active_relation_ids 8 uint64*, added_relation_ids 9 uint64*, removed_relation_ids 10 uint64*, layer 14 enum, pixel_ref 15 PixelRef",
    "EmbeddingBlock": "model 1 string, vector 2 float*, caption 3 string, timestamp 4 int64, layer 14 enum, pixel_ref 15 PixelRef",
    "Document": "schema_major 1 uint32, schema_minor 2 uint32, layer 3 enum, t_start 4 int64, t_end 5 int64, entities 10 Entity*, objects 11 ObjectBlock*, texts 12 TextBlock*, actions 13 ActionBlock*, events 14 EventBlock*, relations 15 RelationBlock*, scenes 16 SceneBlock*, temporals 17 TemporalBlock*, embeddings 18 EmbeddingBlock*, attributes 19 AttributeBlock*",
}
VERSION = (0, 1)
OTHER = "unknown_fields"


def _fields(spec: str) -> list[tuple[str, int, str, str]]:
    """(name, number, type, mark) of a message."""
    parts = [f.split() for f in spec.split(", ")]
    return [(name, int(number), kind.rstrip("?*"), kind[len(kind.rstrip("?*")) :]) for name, number, kind in parts]


FIELDS = {name: _fields(spec) for name, spec in MESSAGES.items()}
KINDS = {name: kind for name, _, kind, mark in FIELDS["Document"] if kind in FIELDS}


def _varint(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _take(raw: memoryview, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("the document is cut short or damaged")
        v |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return v & ((1 << 64) - 1), at


def _told(v, kind: str) -> bytes:
    """A value without its tag."""
    if kind == "float":
        return struct.pack("<f", v)
    if kind in ("string", *FIELDS):
        body = v.encode() if kind == "string" else encode(v, kind)
        return _varint(len(body)) + body
    return _varint(int(v))


def _wire(kind: str) -> int:
    return 5 if kind == "float" else 2 if kind in ("string", *FIELDS) else 0


def encode(message: dict, kind: str = "Document") -> bytes:
    """The fields in order of their numbers, so equal messages have equal bytes. Lists of numbers are packed; plain fields at their default are left out."""
    out = []
    for name, number, type_, mark in FIELDS[kind]:
        v = message.get(name)
        if v is None or (mark != "?" and type_ not in FIELDS and mark != "*" and not v and str(v) != "-0.0"):
            continue
        if mark != "*":
            out.append(_varint(number << 3 | _wire(type_)) + _told(v, type_))
        elif _wire(type_) == 2:
            out += [_varint(number << 3 | 2) + _told(x, type_) for x in v]
        elif len(v):
            body = b"".join(_told(x, type_) for x in v)
            out.append(_varint(number << 3 | 2) + _varint(len(body)) + body)
    return b"".join(out) + (message.get(OTHER) or b"")


def _read(v, kind: str):
    if kind == "float":
        return struct.unpack("<f", v)[0]
    if kind == "string":
        return bytes(v).decode()
    if kind in FIELDS:
        return decode(v, kind)
    return v - (1 << 64) if kind == "int64" and v >> 63 else v & 0xFFFFFFFF if kind == "uint32" else v


def decode(raw: bytes, kind: str = "Document") -> dict:
    """Every field of the message: defaults where plain ones are absent, None for absent marked ones and messages."""
    raw = memoryview(bytes(raw))
    known = {number: (name, type_, mark) for name, number, type_, mark in FIELDS[kind]}
    out = {name: [] if mark == "*" else None if mark or type_ in FIELDS else "" if type_ == "string" else 0.0 if type_ == "float" else 0 for name, _, type_, mark in FIELDS[kind]}
    parts: dict[str, bytes] = {}
    at, other = 0, b""
    while at < len(raw):
        start = at
        tag, at = _take(raw, at)
        wire = tag & 7
        if wire == 0:
            v, at = _take(raw, at)
        elif wire in (1, 2, 5):
            n = 8 if wire == 1 else 4
            if wire == 2:
                n, at = _take(raw, at)
            v, at = raw[at : at + n], at + n
            if at > len(raw):
                raise ValueError("the document is cut short or damaged")
        else:
            raise ValueError("the document is cut short or damaged")
        name, type_, mark = known.get(tag >> 3, (None, "", ""))
        if name is None or (wire != _wire(type_) and not (wire == 2 and mark == "*")):
            other += bytes(raw[start:at])
        elif mark != "*":
            if type_ in FIELDS:  # a message that comes in parts is their sum
                parts[name] = parts.get(name, b"") + bytes(v)
            else:
                out[name] = _read(v, type_)
        elif wire == 2 and _wire(type_) == 5:
            out[name] += struct.unpack(f"<{len(v) // 4}f", v)
        elif wire == 2 and _wire(type_) == 0:
            i = 0
            while i < len(v):
                x, i = _take(v, i)
                out[name].append(_read(x, type_))
        else:
            out[name].append(_read(v, type_))
    out |= {name: decode(body, known_type) for name, body in parts.items() for n, _, known_type, _ in FIELDS[kind] if n == name}
    return out | ({OTHER: other} if other else {})


def spark_type(kind: str, mark: str = "") -> str:
    if kind in FIELDS:
        inner = "struct<" + ",".join(f"`{n}`:{spark_type(k, m)}" for n, _, k, m in FIELDS[kind]) + ">"
    else:
        inner = {"float": "float", "string": "string", "enum": "int"}.get(kind, "bigint")  # ids above the signed range are refused
    return f"array<{inner}>" if mark == "*" else inner


def blocks(documents: DataFrame, name: str, content: str = "content", keys: tuple[str, ...] = ("video",)) -> DataFrame:
    """documents(keys, content: bytes) -> a row for each block of the list `name`, with the keys, its place and its fields."""
    import pyarrow as pa

    kind = KINDS[name]
    schema = documents.select(*keys).schema
    for field in ("place bigint", *(f"`{n}` {spark_type(k, m)}" for n, _, k, m in FIELDS[kind])):
        schema = schema.add(documents.sparkSession.createDataFrame([], field).schema[0])

    def run(batches):
        for b in batches:
            rows = [{**{k: row[k] for k in keys}, "place": i, **block} for row in b.to_pylist() if row[content] is not None for i, block in enumerate(decode(row[content])[name])]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return documents.select(*keys, content).mapInArrow(run, schema)


def documents(tables: dict[str, DataFrame], heads: DataFrame, key: str = "video") -> DataFrame:
    """Tables of blocks(key, place, fields...) by list name, heads(key, layer, t_start, t_end) -> (key, content). Blocks are encoded where they
    are; only their bytes meet, in order of list and place. A document's bytes have to fit in a row, as they are one section of a file.
    """
    import pandas as pd

    numbers = {n: number for n, number, _, _ in FIELDS["Document"]}
    parts = []
    for name, table in tables.items():
        kind, tag = KINDS[name], _varint(numbers[name] << 3 | 2)

        def run(batches, kind=kind, tag=tag, at=numbers[name]):
            for b in batches:
                out = [(row["key"], at, row["place"], tag + _told(row["block"], kind)) for row in b.to_pylist()]
                yield _batch(out)

        present = [n for n, _, _, _ in FIELDS[kind] if n in table.columns]
        parts.append(table.select(F.col(key).alias("key"), F.col("place").cast("bigint").alias("place"), F.struct(*[F.col(f"`{n}`") for n in present]).alias("block")).mapInArrow(run, "key bigint, list int, place bigint, told binary"))

    def head(batches):
        for b in batches:
            yield _batch([(row["key"], 0, 0, encode({"schema_major": VERSION[0], "schema_minor": VERSION[1], "layer": row["layer"], "t_start": row["t_start"], "t_end": row["t_end"]})) for row in b.to_pylist()])

    rows = heads.select(F.col(key).alias("key"), "layer", "t_start", "t_end").mapInArrow(head, "key bigint, list int, place bigint, told binary")
    for p in parts:
        rows = rows.unionByName(p)
    told = F.array_sort(F.collect_list(F.struct("list", "place", F.hex("told").alias("told"))))
    return rows.groupBy("key").agg(F.unhex(F.array_join(F.transform(told, lambda x: x["told"]), "")).alias("content")).withColumnRenamed("key", key)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["key", "list", "place", "told"])


# The names of numbered values, from 0.
NAMES = {"layer": "LAYER_UNSPECIFIED L0_ENTITY L1_EVENT L2_TEXT L3_EMBEDDING".split(), "kind": "TEMPORAL_KIND_UNSPECIFIED TEMPORAL_KEY TEMPORAL_DELTA".split()}


def merge(parts: list[dict]) -> dict:
    """The blocks of several documents in one new document, repeats included; one document stays as it is."""
    if len(parts) == 1:
        return parts[0]
    return {"schema_major": VERSION[0], "schema_minor": VERSION[1]} | {n: [b for p in parts for b in p.get(n) or []] for n in KINDS}


def as_plain(message: dict, kind: str = "Document") -> dict:
    """The message as JSON has it: 64-bit numbers as strings, numbered values by name, nothing for defaults and absent fields."""
    import numpy as np

    def one(name, type_, v):
        if type_ in FIELDS:
            return as_plain(v, type_)
        if type_ == "enum":
            return NAMES[name][v] if 0 <= v < len(NAMES[name]) else v
        if type_ == "float":
            return float(str(np.float32(v))) if np.isfinite(v) else "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
        return str(v) if type_.endswith("64") else v

    out = {}
    for name, _, type_, mark in FIELDS[kind]:
        v = message.get(name)
        if mark == "*":
            if v is not None and len(v):
                out[name] = [one(name, type_, x) for x in v]
        elif v is not None and (mark or type_ in FIELDS or v):
            out[name] = one(name, type_, v)
    return out


def from_plain(found: dict, kind: str = "Document") -> dict:
    """as_plain() back; a name that is not known is an error."""
    known = {name: (type_, mark) for name, _, type_, mark in FIELDS[kind]}
    if strange := set(found) - set(known):
        raise ValueError(f"unknown fields: {', '.join(sorted(strange))}")

    def one(name, type_, v):
        if type_ in FIELDS:
            return from_plain(v, type_)
        if type_ == "enum":
            return NAMES[name].index(v) if isinstance(v, str) else int(v)
        return float(v) if type_ == "float" else v if type_ == "string" else int(v)

    empty = decode(b"", kind)
    return empty | {name: [one(name, known[name][0], x) for x in v] if known[name][1] == "*" else one(name, known[name][0], v) for name, v in found.items() if v is not None}


def normalized(document: dict) -> dict:
    """The document with every block's layer filled in where it has none."""
    from framelore.operators.document import LAYERS

    kind = {"entities": "entity"}
    fill = lambda name, b: b | {"layer": b.get("layer") or LAYERS[kind.get(name, name.removesuffix("s"))]}
    return document | {n: [fill(n, b) for b in document.get(n) or []] for n in KINDS}


def by_layer(document: dict) -> dict[int, dict]:
    """A normalized document's blocks in a document for each layer that has some; times and version are kept."""
    held = normalized(document)
    layers = sorted({b["layer"] for n in KINDS for b in held[n]})
    return {x: held | {"layer": x} | {n: [b for b in held[n] if b["layer"] == x] for n in KINDS} for x in layers}


def example(timescale: int, seconds: float) -> dict:
    """A made-up document with a block of every kind, to try containers and tools without a model."""
    at = lambda s: int(s * timescale)
    half, end = at(seconds / 2), at(seconds)
    box = {"x": 0.25, "y": 0.25, "w": 0.125, "h": 0.5}
    seen = lambda a, b, frame=0, bbox=None: {"t_start": a, "t_end": b, "frame_id": frame, "bbox": bbox}
    return normalized({
        "schema_major": VERSION[0], "schema_minor": VERSION[1], "t_start": 0, "t_end": end,
        "entities": [{"id": 1, "type": "person", "first_seen": 0, "last_seen": end, "pixel_ref": seen(0, end)}, {"id": 2, "type": "cup", "first_seen": half, "last_seen": end, "pixel_ref": seen(half, end, 1)}],
        "objects": [{"entity_id": 1, "class": "person", "bbox": box, "confidence": 0.75, "timestamp": 0, "pixel_ref": seen(0, 0, 0, box)}],
        "texts": [{"content": "Way out", "bbox": box, "confidence": 0.5, "timestamp": half, "pixel_ref": seen(half, end, 1, box)}],
        "actions": [{"subject_id": 1, "action": "standing", "start": 0, "end": half, "confidence": 0.75, "pixel_ref": seen(0, half)}],
        "events": [{"type": "cup_appeared", "start": half, "end": half, "entity_ids": [2], "region": box, "confidence": 0.5, "pixel_ref": seen(half, half, 1, box)}],
        "relations": [{"id": 1, "subject_id": 1, "relation": "holding", "object_id": 2, "start": half, "end": end, "pixel_ref": seen(half, end, 1)}],
        "scenes": [{"label": "shot_01", "context": "", "start": 0, "end": end, "pixel_ref": seen(0, end)}],
        "temporals": [{"kind": 1, "t_start": 0, "t_end": half, "active_entity_ids": [1], "pixel_ref": seen(0, half)}, {"kind": 2, "t_start": half, "t_end": end, "base_t": 0, "added_entity_ids": [2], "added_relation_ids": [1], "pixel_ref": seen(half, end, 1)}],
        "attributes": [{"entity_id": 2, "key": "name", "value": "cup_01", "start": half, "end": end, "pixel_ref": seen(half, end, 1)}],
        "embeddings": [{"model": "made up", "vector": [0.5, 0.25], "caption": "A person with a cup", "timestamp": half, "pixel_ref": seen(half, half, 1)}],
    })
