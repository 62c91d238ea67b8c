"""Messages of several schema versions: by the version id of a registry's header, or by the fingerprint of Avro's single-object framing.

A registry header is a version byte (3), a compression byte (0: none, 5: zlib) and the 16 bytes of the schema version's id. Protobuf bodies then begin with
the index of the message among those of its schema, ordered by full name. Fixed values.

A batch is grouped by version, each group decoded by its writer's schema into the one struct of the reader, and put together again in order; rows of unknown
versions are null, or fail the query, by mode.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import codecs
from .avro_columns import Bodies, Field, Plan, canonical_form, decode, gather, schema_fields

VERSION, PLAIN, ZLIB = 3, 0, 5


@dataclass(frozen=True)
class Registry:
    """Schema versions by the bytes of their ids: Avro schemas as text, Protobuf descriptor sets as bytes."""

    versions: dict[bytes, str | bytes]

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Registry:
        """From files named by their version's id, such as 0b7e….avsc or .desc, in any file system that Spark reads."""
        rows = spark.read.format("binaryFile").load(folder).select("path", "content").collect()
        named = [(r["path"].rsplit("/", 1)[1].rpartition("."), bytes(r["content"])) for r in rows]
        return cls({uuid.UUID(stem).bytes: content.decode() if kind in ("avsc", "json") else content for (stem, _, kind), content in named})

    @classmethod
    def of_fingerprints(cls, schemas: list[str]) -> Registry:
        """Avro schemas by the fingerprints of their canonical forms."""
        return cls({codecs.fingerprint_of(canonical_form(s)): s for s in schemas})


def frame(body: Column, version_id: bytes, compress: bool = False, index: int | None = None) -> Column:
    """The body with a registry header. index: of the Protobuf message."""
    if len(version_id) != 16:
        raise ValueError("a schema version id has 16 bytes")
    whole = body if index is None else F.concat(F.lit(_unsigned(index)), body)
    return F.concat(F.lit(bytes([VERSION, ZLIB if compress else PLAIN]) + version_id), _deflate(whole) if compress else whole)


def _unsigned(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _deflate(body: Column) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for bodies in batches:
            yield pa.array([None if b is None else zlib.compress(b) for b in bodies.to_pylist()], pa.binary())

    return run(body)


def body_of(value: Column) -> Column:
    """The body of a framed message, inflated; null if the header is none. For JSON, whose bodies name their fields."""

    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield unframe(values)[1]

    return run(value)


def cut(values: pa.Array, n: int) -> tuple[list[bytes | None], pa.Array]:
    """The first n bytes of each message, and the rest."""
    wire = Bodies(values)
    middle, valid = np.minimum(wire.at + n, wire.end), ~wire.bad
    part = lambda a, b: gather(wire.data, a, b - a, valid, False, wire.bad)
    return part(wire.at, middle).to_pylist(), part(middle, wire.end)


def unframe(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The version id and the inflated body of each message; both null where there is no header or the body can't be inflated."""
    head, bodies = cut(values, codecs.REGISTRY_HEADER)
    ids = np.array([h[2:] if h is not None and len(h) == 18 and h[0] == VERSION and h[1] in (PLAIN, ZLIB) else None for h in head], object)
    packed = [i for i, h in enumerate(head) if ids[i] is not None and h[1] == ZLIB]
    if packed:
        listed = bodies.to_pylist()
        for i in packed:
            try:
                listed[i] = zlib.decompress(listed[i])
            except zlib.error:
                listed[i] = ids[i] = None
        bodies = pa.array(listed, pa.binary())
    return ids, pc.if_else(pa.array([i is not None for i in ids], pa.bool_()), bodies, pa.scalar(None, bodies.type))


def by_version(ids: np.ndarray, bodies: pa.Array, one: Callable[[bytes, pa.Array], pa.Array | None], kind: pa.DataType, failfast: bool) -> pa.Array:
    """Decodes each version's rows together. one: gives None for an unknown version."""
    parts, places = [pa.nulls(0, kind)], [np.zeros(0, np.int64)]
    names = {i for i in ids if i is not None}
    for version in sorted(names):
        at = np.flatnonzero([i == version for i in ids])
        found = one(version, bodies.take(pa.array(at)))
        if found is None:
            if failfast:
                raise ValueError(f"no schema of version {version.hex()}")
            continue
        parts.append(found)
        places.append(at)
    order = np.concatenate(places)
    back = np.full(len(ids), -1)
    back[order] = np.arange(len(order))
    lost = back < 0
    if failfast and (lost & np.asarray(bodies.is_valid())).any():
        raise ValueError("a message without a header")
    return pa.concat_arrays(parts).take(pa.array(back, pa.int64(), mask=lost))


def struct_of(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, codecs.AVRO_KINDS[f.kind]) for f in fields])


def avro_batches(split: Callable[[pa.Array], tuple[np.ndarray, pa.Array]], registry: Registry, reader: str, mode: str):
    """The function of an Arrow UDF from messages to structs of the reader schema."""
    fields = schema_fields(reader)
    kinds = [pa.field(f.name, to_arrow_type(k.dataType)) for f, k in zip(fields, struct_of(fields), strict=True)]
    failfast = mode != "PERMISSIVE"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plans = {i: Plan(schema_fields(s), fields) for i, s in registry.versions.items()}

        def one(version: bytes, bodies: pa.Array) -> pa.Array | None:
            if version not in plans:
                return None
            wire = Bodies(bodies)
            null = wire.bad.copy()
            found = decode(wire, plans[version], kinds)
            if failfast and (wire.bad & ~null).any():
                raise ValueError("a malformed Avro message")
            return found

        for values in batches:
            yield by_version(*split(values), one, pa.struct(kinds), failfast)

    return struct_of(fields), run


def from_registry_avro(value: Column, registry: Registry, reader: str, mode: str = "PERMISSIVE") -> Column:
    """Framed Avro records of any version in the registry as structs of the reader schema. PERMISSIVE: unknown versions and malformed messages are null."""
    if (spark := codecs.connector("avro")) is not None:
        body, version = body_of(value), F.substring(value, 3, 16)
        cases = [(F.lit(i) == version, spark.from_avro(body, s, {"mode": mode, "avroSchema": reader})) for i, s in registry.versions.items()]
        return _cases(cases, mode)
    kind, run = avro_batches(unframe, registry, reader, mode)
    return F.arrow_udf(kind)(_typed(run))(value)


def from_single_object(value: Column, schemas: list[str], reader: str, mode: str = "PERMISSIVE") -> Column:
    """Avro records in single-object framing, by the fingerprint of their writer's schema, as structs of the reader schema."""
    registry = Registry.of_fingerprints(schemas)
    if (spark := codecs.connector("avro")) is not None:
        body, version = F.substring(value, 11, 2**31 - 1), F.substring(value, 1, 10)
        cases = [(F.lit(codecs.SINGLE_OBJECT + i) == version, spark.from_avro(body, s, {"mode": mode, "avroSchema": reader})) for i, s in registry.versions.items()]
        return _cases(cases, mode)

    def split(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
        head, bodies = cut(values, 10)
        ids = np.array([h[2:] if h is not None and len(h) == 10 and h[:2] == codecs.SINGLE_OBJECT else None for h in head], object)
        return ids, bodies

    kind, run = avro_batches(split, registry, reader, mode)
    return F.arrow_udf(kind)(_typed(run))(value)


def _cases(cases: list[tuple[Column, Column]], mode: str) -> Column:
    (first, then), *more = cases
    found = F.when(first, then)
    for condition, decoded in more:
        found = found.when(condition, decoded)
    return found if mode == "PERMISSIVE" else found.otherwise(F.raise_error(F.lit("a message of an unknown schema version")))


def _typed(run: Callable) -> Callable:
    def decode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return decode_batches


def message_names(descriptors: bytes) -> list[str]:
    """Full names of all messages of a descriptor set but those of the well-known files, in the order of the message index."""
    from google.protobuf import descriptor_pb2

    found: list[str] = []

    def walk(prefix: str, messages) -> None:
        for m in messages:
            if not m.options.map_entry:
                found.append(f"{prefix}{m.name}")
            walk(f"{prefix}{m.name}.", m.nested_type)

    for f in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
        if f.package != "google.protobuf":
            walk(f"{f.package}." if f.package else "", f.message_type)
    return sorted(found)


def from_registry_protobuf(value: Column, registry: Registry, descriptors: bytes, message: str = "Employee", mode: str = "PERMISSIVE") -> Column:
    """Framed Protobuf messages of any version in the registry as structs of `message` in the reader's descriptor set.

    The index must name that message in the version's own schema; its fields then go by their numbers, so fields that only one side knows do no harm. PERMISSIVE: unknown
    versions, other messages and malformed ones are null.
    """
    (wanted,) = [n for n in message_names(descriptors) if message in (n, n.rpartition(".")[2])]

    @F.arrow_udf(T.BinaryType())
    def inner(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = {i: message_names(d) for i, d in registry.versions.items()}

        def one(version: bytes, bodies: pa.Array) -> pa.Array | None:
            if version not in names:
                return None
            wire = Bodies(bodies)
            null = wire.bad.copy()
            index = wire.varint(~wire.bad)
            right = index == names[version].index(wanted) if wanted in names[version] else np.zeros(len(index), bool)
            wire.bad |= ~right
            if mode != "PERMISSIVE" and (wire.bad & ~null).any():
                raise ValueError(f"a message that is no {wanted}")
            listed = [None if bad else bytes(wire.data[a:b]) for a, b, bad in zip(wire.at, wire.end, wire.bad, strict=True)]
            return pa.array(listed, pa.binary())

        for values in batches:
            yield by_version(*unframe(values), one, pa.binary(), mode != "PERMISSIVE")

    return codecs.from_protobuf(inner(value), descriptors, message, mode)
