"""Payload codecs: delimited changes, JSON, Avro records, Protobuf messages and registry framing.

CSV and JSON stay in built-in functions. Avro and Protobuf are decoded by Spark's own connector functions where their jars are on the
session's class path; elsewhere Arrow-batched UDFs give the same structs (`connector` tells which), by columns.
"""

from __future__ import annotations

import importlib
import json
import struct
from collections.abc import Callable, Iterator
from types import ModuleType

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schemas import AVRO_EMPLOYEE, JSON_EMPLOYEE
from .avro_columns import Bodies, Field, Plan
from .avro_columns import decode as decode_columns
from .proto_columns import decode_bodies, reader_of

#: Registry framing: version byte, compression byte, 16 bytes of schema version id.
REGISTRY_HEADER = 18
#: Single-object framing: C3 01 and an 8-byte fingerprint.
SINGLE_OBJECT = b"\xc3\x01"


def connector(name: str) -> ModuleType | None:
    """Spark's functions for 'avro' or 'protobuf', or None where the connector's jar is absent."""
    needed = {"avro": "org.apache.spark.sql.avro.AvroDataToCatalyst", "protobuf": "org.apache.spark.sql.protobuf.ProtobufDataToCatalyst"}[name]
    try:
        SparkSession.getActiveSession()._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(needed)
    except Py4JError:
        return None
    return importlib.import_module(f"pyspark.sql.{name}.functions")


def read_bytes(path: str) -> bytes:
    """A small file of any file system that Spark reads, such as a descriptor set or a schema."""
    return bytes(SparkSession.getActiveSession().read.format("binaryFile").load(path).first()["content"])


def _structs(rows: list[dict | None], kind: T.StructType) -> pa.Array:
    return pa.array(rows, to_arrow_type(kind, timestamp_utc=True))


# Delimited changes: operation,account_id,balance,last_updated in epoch milliseconds.


def parse_change(value: Column) -> list[Column]:
    """Missing fields and what isn't a number in range become null; further fields are ignored."""
    parts = F.split(value.cast("string"), ",")
    field = lambda i: F.get(parts, F.lit(i))
    return [
        field(0).alias("operation"),
        field(1).try_cast("int").alias("account_id"),
        field(2).try_cast("int").alias("balance"),
        F.timestamp_millis(field(3).try_cast("bigint")).alias("last_updated"),
    ]


def format_change(operation: Column, account_id: Column, balance: Column, millis: Column) -> Column:
    text = F.concat_ws(",", F.coalesce(operation, F.lit("")), account_id.cast("string"), balance.cast("string"), millis.cast("string"))
    return text.cast("binary")


def parse_json(value: Column, schema: str = JSON_EMPLOYEE) -> Column:
    return F.from_json(value.cast("string"), schema)


def strip_registry(value: Column) -> Column:
    """The body of a registry-framed message."""
    return F.substring(value, REGISTRY_HEADER + 1, 2**31 - 1)


def add_registry(value: Column, version_id: bytes) -> Column:
    if len(version_id) != 16:
        raise ValueError("a schema version id has 16 bytes")
    return F.concat(F.lit(b"\x03\x00" + version_id), value)


# Avro records of primitive fields

AVRO_KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(),
}


def avro_fields(schema: str) -> list[tuple[str, str]]:
    """(name, kind) of the fields of a record schema in JSON; a union of null and a primitive is its kind with '?'."""
    out = []
    for f in json.loads(schema)["fields"]:
        kind = f["type"]
        null = isinstance(kind, list) and kind[:1] == ["null"] and len(kind) == 2
        kind = kind[1] if null else kind
        kind = kind["type"] if isinstance(kind, dict) else kind  # a logical type is read as what it is built on
        if kind not in AVRO_KINDS:
            raise ValueError(f"field {f['name']}: {kind!r} is not supported without the connector")
        out.append((f["name"], kind + "?" * null))
    return out


def avro_schema(fields=AVRO_EMPLOYEE) -> str:
    """The JSON schema of a record with these fields."""
    kinds = [{"name": n, "type": ["null", k[:-1]] if k.endswith("?") else k} for n, k in fields]
    return json.dumps({"type": "record", "name": "Record", "fields": kinds})


def _varint(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


_FIXED = {"float": struct.Struct("<f"), "double": struct.Struct("<d"), "boolean": struct.Struct("<?")}


def avro_encode_record(values: tuple, fields=AVRO_EMPLOYEE, fingerprint: bytes | None = None) -> bytes:
    out = [SINGLE_OBJECT + fingerprint] if fingerprint else []
    for (_, kind), v in zip(fields, values, strict=True):
        if kind.endswith("?"):
            out.append(_varint(int(v is not None)))
            if v is None:
                continue
            kind = kind[:-1]
        if kind in ("string", "bytes"):
            data = v.encode() if kind == "string" else bytes(v)
            out += [_varint(len(data)), data]
        else:
            out.append(_FIXED[kind].pack(v) if kind in _FIXED else _varint(int(v)))
    return b"".join(out)


def avro_decode_record(data: bytes, fields=AVRO_EMPLOYEE) -> tuple:
    """A raw or single-object body; anything else raises ValueError."""
    at = 10 if data[:2] == SINGLE_OBJECT else 0
    out: list = []

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("bad number")
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def take(n: int) -> bytes:
        nonlocal at
        if n < 0 or at + n > len(data):
            raise ValueError("bad length")
        at += n
        return data[at - n : at]

    for _, kind in fields:
        if kind.endswith("?"):
            branch, kind = number(), kind[:-1]
            if branch not in (0, 1):
                raise ValueError("bad union")
            if not branch:
                out.append(None)
                continue
        if kind in ("string", "bytes"):
            body = take(number())
            out.append(body.decode() if kind == "string" else body)
        elif kind in _FIXED:
            out.append(_FIXED[kind].unpack(take(_FIXED[kind].size))[0])
        else:
            n = number()
            if kind == "int" and not -(2**31) <= n < 2**31:
                raise ValueError("not an int")
            out.append(n)
    if at != len(data):
        raise ValueError("bytes left over")
    return tuple(out)


def from_avro(value: Column, fields=AVRO_EMPLOYEE, mode: str = "PERMISSIVE") -> Column:
    """A record, raw or in single-object framing. PERMISSIVE: a malformed message gives nulls; FAILFAST: it fails the query."""
    if (spark := connector("avro")) is not None:
        framed = F.substring(value, 1, len(SINGLE_OBJECT)) == F.lit(SINGLE_OBJECT)
        body = F.when(framed, F.substring(value, len(SINGLE_OBJECT) + 9, 2**31 - 1)).otherwise(value)
        return spark.from_avro(body, avro_schema(fields), {"mode": mode})
    kind = T.StructType([T.StructField(n, AVRO_KINDS[k.removesuffix("?")]) for n, k in fields])
    own = [Field(n, k.removesuffix("?"), k.endswith("?")) for n, k in fields]

    @F.arrow_udf(kind)
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plan, kinds = Plan(own, own), list(to_arrow_type(kind))
        for bodies in batches:
            wire = Bodies(bodies)
            null = wire.bad.copy()
            single = (wire.byte() == SINGLE_OBJECT[0]) & (wire.byte(1) == SINGLE_OBJECT[1]) & (wire.end - wire.at >= 2)
            wire.skip(10, single)
            found = decode_columns(wire, plan, kinds)
            if mode != "PERMISSIVE" and (wire.bad & ~null).any():
                raise ValueError("a malformed Avro message")
            yield found

    return decode(value)


def to_avro(columns: list[Column], fields=AVRO_EMPLOYEE, fingerprint: bytes | None = None) -> Column:
    @F.pandas_udf(T.BinaryType())
    def encode(*parts: pd.Series) -> pd.Series:
        return pd.Series([avro_encode_record(r, fields, fingerprint) for r in zip(*parts, strict=True)], dtype=object)

    return encode(*columns)


# Protobuf messages, by a serialized descriptor set


def descriptor_bytes(path: str | None = None, hexadecimal: str | None = None) -> bytes:
    if hexadecimal is not None:
        return bytes.fromhex(hexadecimal)
    return read_bytes(path)


def employee_descriptor_set() -> bytes:
    """The descriptor set of the employee message, built in code."""
    from google.protobuf import descriptor_pb2, timestamp_pb2, wrappers_pb2

    files = descriptor_pb2.FileDescriptorSet()
    for module in (wrappers_pb2, timestamp_pb2):
        module.DESCRIPTOR.CopyToProto(files.file.add())
    f = files.file.add(name="employee.proto", package="lake", syntax="proto3", dependency=[x.name for x in files.file][:2])
    kind = descriptor_pb2.FieldDescriptorProto
    team = f.message_type.add(name="Team")
    for i, name in enumerate(("name", "location")):
        team.field.add(name=name, number=i + 1, type=kind.TYPE_STRING, label=kind.LABEL_OPTIONAL)
    role = f.enum_type.add(name="Role")
    for i, name in enumerate(("MANAGER", "DEVELOPER", "ARCHITECT")):
        role.value.add(name=name, number=i)
    e = f.message_type.add(name="Employee")
    for number, (name, type_, type_name) in enumerate(
        [
            ("id", kind.TYPE_INT32, None),
            ("name", kind.TYPE_STRING, None),
            ("address", kind.TYPE_STRING, None),
            ("employee_age", kind.TYPE_MESSAGE, ".google.protobuf.Int32Value"),
            ("start_date", kind.TYPE_MESSAGE, ".google.protobuf.Timestamp"),
            ("team", kind.TYPE_MESSAGE, ".lake.Team"),
            ("role", kind.TYPE_ENUM, ".lake.Role"),
        ],
        1,
    ):
        e.field.add(name=name, number=number, type=type_, type_name=type_name, label=kind.LABEL_OPTIONAL)
    return files.SerializeToString()


def message_class(descriptors: bytes, name: str):
    """The class of a message, looked up by full or unqualified name."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    files = descriptor_pb2.FileDescriptorSet.FromString(descriptors)
    pool = descriptor_pool.DescriptorPool()
    found = name
    for f in files.file:
        pool.Add(f)
        for m in f.message_type:
            if name in (m.name, f"{f.package}.{m.name}"):
                found = f"{f.package}.{m.name}" if f.package else m.name
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(found))


def _field(field) -> tuple[T.DataType, Callable]:
    """The Spark type of one value of a Protobuf field, and what makes it of the value."""
    kinds = {
        field.CPPTYPE_INT32: T.IntegerType(), field.CPPTYPE_UINT32: T.LongType(), field.CPPTYPE_INT64: T.LongType(), field.CPPTYPE_UINT64: T.DecimalType(20, 0),
        field.CPPTYPE_DOUBLE: T.DoubleType(), field.CPPTYPE_FLOAT: T.FloatType(), field.CPPTYPE_BOOL: T.BooleanType(),
    }
    if field.cpp_type in kinds:
        return kinds[field.cpp_type], lambda v: v
    if field.cpp_type == field.CPPTYPE_STRING:
        return (T.BinaryType() if field.type == field.TYPE_BYTES else T.StringType()), lambda v: v
    if field.cpp_type == field.CPPTYPE_ENUM:
        names = {n: x.name for n, x in field.enum_type.values_by_number.items()}
        return T.StringType(), lambda v: names.get(v) or str(v)
    if field.message_type.full_name == "google.protobuf.Timestamp":
        return T.TimestampType(), lambda v: v.seconds * 1_000_000 + v.nanos // 1000
    return message_reader(field.message_type)


def message_reader(descriptor) -> tuple[T.StructType, Callable]:
    """The struct of a Protobuf message, and a function from a message to its values by name.

    Absent messages (wrappers among them) and unset optional scalars are null, other unset scalars have their defaults, enums their names.
    """
    kinds, readers = [], []
    for field in descriptor.fields:
        name, repeated = field.name, field.is_repeated if hasattr(field, "is_repeated") else field.label == field.LABEL_REPEATED
        if repeated and field.message_type is not None and field.message_type.GetOptions().map_entry:
            (key, _), (kind, one) = (_field(field.message_type.fields_by_name[x]) for x in ("key", "value"))
            kinds.append(T.StructField(name, T.MapType(key, kind)))
            readers.append((name, lambda m, name=name, one=one: [(k, one(v)) for k, v in getattr(m, name).items()]))
            continue
        kind, one = _field(field)
        if repeated:
            kinds.append(T.StructField(name, T.ArrayType(kind)))
            readers.append((name, lambda m, name=name, one=one: [one(v) for v in getattr(m, name)]))
        else:
            kinds.append(T.StructField(name, kind))
            presence = field.has_presence
            readers.append((name, lambda m, name=name, one=one, presence=presence: None if presence and not m.HasField(name) else one(getattr(m, name))))
    return T.StructType(kinds), lambda m: {name: read(m) for name, read in readers}


def from_protobuf(value: Column, descriptors: bytes, message: str = "Employee", mode: str = "FAILFAST") -> Column:
    """A message of a descriptor set as a struct, see `message_reader`. FAILFAST: a malformed message fails the query; PERMISSIVE: it gives nulls."""
    if (spark := connector("protobuf")) is not None:
        return spark.from_protobuf(value, message, options={"mode": mode, "emit.default.values": "true"}, binaryDescriptorSet=descriptors)
    kind, _ = message_reader(message_class(descriptors, message).DESCRIPTOR)

    @F.arrow_udf(kind)
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from google.protobuf.message import DecodeError

        made = message_class(descriptors, message)
        _, read = message_reader(made.DESCRIPTOR)

        def one(body: bytes | None) -> dict | None:
            try:
                return None if body is None else read(made.FromString(body))
            except DecodeError:
                if mode != "PERMISSIVE":
                    raise
                return None

        columns = reader_of(made.DESCRIPTOR)
        for bodies in batches:
            if columns is None:
                yield _structs([one(b) for b in bodies.to_pylist()], kind)
            else:
                yield decode_bodies(bodies, columns, to_arrow_type(kind, timestamp_utc=True), one, lambda rows: _structs(rows, kind))

    return decode(value)


def to_protobuf(employee_id: Column, name: Column, address: Column, age: Column, start_date: Column, team: Column, role: Column) -> Column:
    """Employee messages. A role is the name of one, or the number of an unknown one; anything else raises ValueError."""
    descriptors = employee_descriptor_set()

    @F.pandas_udf(T.BinaryType())
    def encode(
        ids: pd.Series,
        names: pd.Series,
        addresses: pd.Series,
        ages: pd.Series,
        micros: pd.Series,
        teams: pd.Series,
        roles: pd.Series,
    ) -> pd.Series:
        made = message_class(descriptors, "Employee")
        numbers = {x.name: n for n, x in made.DESCRIPTOR.fields_by_name["role"].enum_type.values_by_number.items()}
        out = []
        for i, n, a, g, s, t, r in zip(ids, names, addresses, ages, micros, teams, roles, strict=True):
            m = made(id=int(i), name=n or "", address=a or "", role=numbers[r] if r in numbers else int(r or 0))
            if not pd.isna(g):
                m.employee_age.value = int(g)
            if not pd.isna(s):
                m.start_date.seconds, m.start_date.nanos = int(s) // 1_000_000, int(s) % 1_000_000 * 1000
            if t is not None:
                m.team.name = t
            out.append(m.SerializeToString())
        return pd.Series(out, dtype=object)

    return encode(employee_id, name, address, age, F.unix_micros(start_date.cast("timestamp")), team, role)


def flatten_employee(decoded: DataFrame, struct_column: str = "Employee") -> DataFrame:
    """The employee table's columns from a decoded message."""
    e = decoded.select(f"{struct_column}.*")
    return e.select(
        F.col("id").cast("bigint").alias("employee_id"), F.col("employee_age.value").alias("age"), "start_date", F.col("team.name").alias("team"), "role", "address", "name"
    )


def register_name_udf(spark, descriptors: bytes, name: str = "proto") -> None:
    """A SQL function from message bytes to the employee's name; null and malformed messages give null."""

    @F.pandas_udf(T.StringType())
    def employee_name(bodies: pd.Series) -> pd.Series:
        from google.protobuf.message import DecodeError

        made = message_class(descriptors, "Employee")

        def one(b):
            try:
                return None if b is None else made.FromString(bytes(b)).name
            except DecodeError:
                return None

        return bodies.map(one)

    spark.udf.register(name, employee_name)


def fingerprint_of(schema_json: str) -> bytes:
    """CRC-64-AVRO of a schema text in canonical form, little-endian. Fixed value: the empty fingerprint of the Avro specification."""
    empty = 0xC15D213AA4D7A795
    table = []
    for i in range(256):
        fp = i
        for _ in range(8):
            fp = (fp >> 1) ^ (empty & -(fp & 1))
        table.append(fp)
    fp = empty
    for b in schema_json.encode():
        fp = (fp >> 8) ^ table[(fp ^ b) & 0xFF]
    return struct.pack("<Q", fp)
