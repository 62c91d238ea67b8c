"""Avro records decoded by columns: numpy walks a whole batch field by field, from the writer's schema to the reader's.

A plan says, for each field of the writer in wire order, what becomes of it: a column of the reader, promoted where the specification allows
it, or nothing. Fields that only the reader has take their defaults.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Promotions of the Avro specification, from writer to reader.
PROMOTIONS = {
    "int": {"int", "long", "float", "double"}, "long": {"long", "float", "double"}, "float": {"float", "double"}, "double": {"double"},
    "string": {"string", "bytes"}, "bytes": {"bytes", "string"}, "boolean": {"boolean"},
}
ARROW = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "bytes": pa.binary(), "boolean": pa.bool_()}
FIXED = {"float": "<f4", "double": "<f8", "boolean": "u1"}
_NONE = object()


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = False
    null_second: bool = False  # the union's order on the wire
    default: object = _NONE
    aliases: tuple[str, ...] = ()


def schema_fields(schema: str) -> list[Field]:
    """The fields of a record schema in JSON: primitives, and unions of null and a primitive in either order."""
    out = []
    for f in json.loads(schema)["fields"]:
        kind = f["type"]
        nullable = isinstance(kind, list) and len(kind) == 2 and "null" in kind
        second = nullable and kind[1] == "null"
        kind = (kind[0] if second else kind[1]) if nullable else kind
        kind = kind["type"] if isinstance(kind, dict) else kind  # a logical type is read as what it is built on
        if not isinstance(kind, str) or kind not in PROMOTIONS:
            raise ValueError(f"field {f['name']}: {kind!r} is not supported without the connector")
        out.append(Field(f["name"], kind, nullable, second, f.get("default", _NONE), tuple(f.get("aliases", ()))))
    return out


def canonical_form(schema: str | dict | list, space: str = "") -> str:
    """The parsing canonical form of a schema: full names, no attributes that don't touch the wire, a fixed order, no white space."""
    return _canonical(json.loads(schema) if isinstance(schema, str) else schema, space)


def _canonical(x: object, space: str) -> str:
    if isinstance(x, list):
        return "[" + ",".join(_canonical(e, space) for e in x) + "]"
    if isinstance(x, str):
        return json.dumps(x if x in PROMOTIONS or x == "null" or "." in x or not space else f"{space}.{x}")
    kind = x["type"]
    if kind in PROMOTIONS or kind == "null" or not isinstance(kind, str):
        return _canonical(kind, space)
    parts = []
    if "name" in x:
        name = x["name"]
        inner = name.rpartition(".")[0] if "." in name else x.get("namespace", space)
        parts.append('"name":' + json.dumps(name if "." in name or not inner else f"{inner}.{name}"))
        space = inner
    parts.append('"type":' + json.dumps(kind))
    if "fields" in x:
        parts.append('"fields":[' + ",".join('{"name":' + json.dumps(f["name"]) + ',"type":' + _canonical(f["type"], space) + "}" for f in x["fields"]) + "]")
    if "symbols" in x:
        parts.append('"symbols":[' + ",".join(json.dumps(s) for s in x["symbols"]) + "]")
    for key in ("items", "values"):
        if key in x:
            parts.append(f'"{key}":' + _canonical(x[key], space))
    if "size" in x:
        parts.append(f'"size":{int(x["size"])}')
    return "{" + ",".join(parts) + "}"


class Plan:
    """How records of a writer's fields become columns of a reader's. ValueError if the schemas don't resolve."""

    def __init__(self, writer: list[Field], reader: list[Field]):
        self.reader, self.steps = reader, []
        names = {f.name: i for i, f in enumerate(reader)} | {a: i for i, f in enumerate(reader) for a in f.aliases}
        found = set()
        for f in writer:
            i = names.get(f.name)
            if i is not None and reader[i].kind not in PROMOTIONS[f.kind]:
                raise ValueError(f"field {f.name}: {f.kind} does not become {reader[i].kind}")
            self.steps.append((f, i))
            found.add(i)
        self.missing = [i for i in range(len(reader)) if i not in found]
        for i in self.missing:
            if reader[i].default is _NONE:
                raise ValueError(f"field {reader[i].name}: the writer doesn't have it, and it has no default")


class Bodies:
    """A batch of messages as one array of bytes with the place where each is read on. Rows that turn out malformed stay where they are."""

    def __init__(self, bodies: pa.Array):
        bodies = bodies.cast(pa.large_binary())
        offsets = np.frombuffer(bodies.buffers()[1], np.int64, len(bodies) + 1, 8 * bodies.offset) if len(bodies) else np.zeros(1, np.int64)
        data = bodies.buffers()[2]
        self.data = np.append(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8))
        self.at, self.end = offsets[:-1].copy(), offsets[1:].copy()
        self.bad = np.asarray(bodies.is_null().to_numpy(zero_copy_only=False))

    def byte(self, ahead: int = 0) -> np.ndarray:
        return self.data[np.minimum(self.at + ahead, len(self.data) - 1)]

    def skip(self, n: np.ndarray | int, rows: np.ndarray | None = None) -> np.ndarray:
        """Goes n bytes on in the rows meant; returns where they began."""
        rows = ~self.bad if rows is None else rows & ~self.bad
        n = np.where(rows, n, 0)
        wrong = rows & ((n < 0) | (n > self.end - self.at))
        self.bad |= wrong
        start = self.at.copy()
        self.at += np.where(wrong, 0, n)
        return start

    def varint(self, rows: np.ndarray) -> np.ndarray:
        """Unsigned variable-length numbers of the rows meant, 0 elsewhere."""
        out, live = np.zeros(len(self.at), np.uint64), rows & ~self.bad
        for i in range(10):
            short = live & (self.at >= self.end)
            self.bad |= short
            live &= ~short
            b = self.byte().astype(np.uint64)
            out |= np.where(live, (b & np.uint64(0x7F)) << np.uint64(7 * i), np.uint64(0))
            self.at += live
            live &= b >= 0x80
            if not live.any():
                return out
        self.bad |= live
        return out

    def zigzag(self, rows: np.ndarray) -> np.ndarray:
        n = self.varint(rows)
        return (n >> np.uint64(1)).astype(np.int64) ^ -(n & np.uint64(1)).astype(np.int64)

    def blobs(self, rows: np.ndarray, text: bool) -> pa.Array:
        """Length-prefixed bytes of the rows meant."""
        n = self.zigzag(rows)
        start = self.skip(n, rows)
        return gather(self.data, start, np.where(rows & ~self.bad, n, 0), rows & ~self.bad, text, self.bad)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, valid: np.ndarray, text: bool, bad: np.ndarray) -> pa.Array:
    """The slices of data as an array of binary or string; rows of text that is no UTF-8 become null and `bad`."""
    ends = np.cumsum(size)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    taken = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])] if len(size) else data[:0]
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    found = pa.Array.from_buffers(pa.large_binary(), len(size), [mask, pa.py_buffer(offsets), pa.py_buffer(taken.tobytes())])
    if not text:
        return found.cast(pa.binary())
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:
        out = []
        for i, b in enumerate(found.to_pylist()):
            try:
                out.append(None if b is None else b.decode())
            except UnicodeDecodeError:
                out.append(None)
                bad[i] = True
        return pa.array(out, pa.string())


def _column(wire: Bodies, f: Field, rows: np.ndarray) -> pa.Array:
    if f.kind in ("string", "bytes"):
        return wire.blobs(rows, f.kind == "string")
    if f.kind in FIXED:
        kind = np.dtype(FIXED[f.kind])
        start = wire.skip(kind.itemsize, rows)
        at = np.minimum(start, len(wire.data) - kind.itemsize)
        got = np.stack([wire.data[at + i] for i in range(kind.itemsize)], axis=1).copy().view(kind)[:, 0]
        return pa.array(got.astype(bool) if f.kind == "boolean" else got, ARROW[f.kind])
    n = wire.zigzag(rows)
    if f.kind == "int":
        wire.bad |= rows & ((n < -(2**31)) | (n >= 2**31))
        n = np.where(wire.bad, 0, n)
    return pa.array(n, pa.int64()).cast(ARROW[f.kind])


def decode(wire: Bodies, plan: Plan, kinds: list[pa.Field]) -> pa.StructArray:
    """The records from where `wire` stands to the end of each body. Malformed ones are null, and marked in wire.bad."""
    columns: dict[int, tuple[pa.Array, np.ndarray]] = {}
    count = len(wire.at)
    for f, i in plan.steps:
        rows = ~wire.bad
        if f.nullable:
            branch = wire.zigzag(rows)
            wire.bad |= rows & (branch != 0) & (branch != 1)
            rows &= branch == (0 if f.null_second else 1)
        column = _column(wire, f, rows)
        if i is not None:
            columns[i] = column, rows
            if not plan.reader[i].nullable and f.nullable:
                wire.bad |= ~rows
    wire.bad |= wire.at != wire.end
    arrays = []
    for i, (f, kind) in enumerate(zip(plan.reader, kinds, strict=True)):
        if i in plan.missing:
            default = f.default.encode("latin-1") if f.kind == "bytes" and isinstance(f.default, str) else f.default
            arrays.append(pa.array([default], ARROW[f.kind]).take(pa.array(np.zeros(count, np.int64))).cast(kind.type))
            continue
        column, rows = columns[i]
        keep = pa.array(rows & ~wire.bad)
        if pa.types.is_binary(column.type) and kind.type == pa.string():
            column = gather(*_slices(column), np.asarray(column.is_valid()), True, wire.bad)
        column = column.cast(kind.type, safe=False) if column.type != kind.type else column
        arrays.append(pa.compute.if_else(keep, column, pa.scalar(None, kind.type)))
    return pa.StructArray.from_arrays(arrays, fields=kinds, mask=pa.array(wire.bad))


def _slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and sizes of a binary array."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets[:-1], np.diff(offsets)
