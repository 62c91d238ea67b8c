"""Decoding by columns against decoding record by record; schema versions by registry header and by fingerprint."""

import json
import uuid
import zlib

import pyarrow as pa
import pytest
from google.protobuf import descriptor_pb2
from google.protobuf.message import DecodeError
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluice.functions import codecs
from sluice.functions.avro_columns import Bodies, Field, Plan, canonical_form, decode, schema_fields
from sluice.functions.proto_columns import decode_bodies, reader_of
from sluice.functions.registry import Registry, body_of, frame, from_registry_avro, from_registry_protobuf, from_single_object, message_names

KINDS = [("a", "long"), ("b", "string?"), ("c", "double"), ("d", "boolean"), ("e", "bytes"), ("f", "int?"), ("g", "float")]
OWN = [Field(n, k.rstrip("?"), k.endswith("?")) for n, k in KINDS]
record = st.tuples(
    st.integers(-(2**63), 2**63 - 1), st.none() | st.text(max_size=8), st.floats(allow_nan=False), st.booleans(), st.binary(max_size=6), st.none() | st.integers(-(2**31), 2**31 - 1),
    st.floats(allow_nan=False, width=32),
)


def columns(bodies):
    kinds = [pa.field(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bytes": pa.binary(), "int": pa.int32(), "float": pa.float32()}[k.rstrip("?")]) for n, k in KINDS]
    return [None if r is None else tuple(r.values()) for r in decode(Bodies(pa.array(bodies, pa.binary())), Plan(OWN, OWN), kinds).to_pylist()]


def alone(body):
    try:
        return None if body is None else codecs.avro_decode_record(body, KINDS)
    except (ValueError, UnicodeDecodeError):
        return None


@settings(max_examples=60, deadline=None)
@given(st.lists(record, max_size=8), st.lists(st.none() | st.binary(max_size=30), max_size=8), st.integers(0, 60), st.integers(0, 255))
def test_avro_columns_are_the_records(records, junk, at, byte):
    bodies = [codecs.avro_encode_record(r, KINDS) for r in records]
    broken = [b[: at % (len(b) + 1)] for b in bodies] + [b[: at % len(b)] + bytes([byte]) + b[at % len(b) + 1 :] for b in bodies]
    every = bodies + [x for x in broken + junk if x is None or x[:2] != codecs.SINGLE_OBJECT]
    assert repr(columns(every)) == repr([alone(b) for b in every])  # broken bytes may be numbers that don't equal themselves
    assert columns(bodies) == records


def sample_descriptors():
    kind = descriptor_pb2.FieldDescriptorProto
    files = descriptor_pb2.FileDescriptorSet()
    f = files.file.add(name="m.proto", package="p", syntax="proto3")
    inner = f.message_type.add(name="Inner")
    inner.field.add(name="x", number=1, type=kind.TYPE_SINT64, label=kind.LABEL_OPTIONAL)
    inner.field.add(name="s", number=2, type=kind.TYPE_STRING, label=kind.LABEL_OPTIONAL)
    e = f.enum_type.add(name="Color")
    for i, n in enumerate(("RED", "GREEN")):
        e.value.add(name=n, number=i)
    m = f.message_type.add(name="M")
    types = ["INT32", "INT64", "UINT32", "SINT32", "SINT64", "BOOL", "FIXED32", "SFIXED32", "SFIXED64", "FLOAT", "DOUBLE", "STRING", "BYTES"]
    for i, t in enumerate(types, 1):
        m.field.add(name=t.lower(), number=i, type=getattr(kind, f"TYPE_{t}"), label=kind.LABEL_OPTIONAL)
    m.field.add(name="color", number=20, type=kind.TYPE_ENUM, type_name=".p.Color", label=kind.LABEL_OPTIONAL)
    m.field.add(name="inner", number=21, type=kind.TYPE_MESSAGE, type_name=".p.Inner", label=kind.LABEL_OPTIONAL)
    m.field.add(name="maybe", number=22, type=kind.TYPE_INT32, label=kind.LABEL_OPTIONAL, proto3_optional=True, oneof_index=0)
    m.oneof_decl.add(name="_maybe")
    return files.SerializeToString()


SET = sample_descriptors()
MADE = codecs.message_class(SET, "M")
i32, i64 = st.integers(-(2**31), 2**31 - 1), st.integers(-(2**63), 2**63 - 1)
fields = st.fixed_dictionaries(
    {},
    optional={
        "int32": i32, "int64": i64, "uint32": st.integers(0, 2**32 - 1), "sint32": i32, "sint64": i64, "bool": st.booleans(), "fixed32": st.integers(0, 2**32 - 1), "sfixed32": i32, "sfixed64": i64,
        "float": st.floats(width=32, allow_nan=False), "double": st.floats(allow_nan=False), "string": st.text(max_size=6), "bytes": st.binary(max_size=6), "color": st.integers(0, 3), "maybe": i32,
        "inner": st.fixed_dictionaries({}, optional={"x": i64, "s": st.text(max_size=5)}),
    },
)


@settings(max_examples=60, deadline=None)
@given(st.lists(fields, min_size=1, max_size=8), st.lists(st.binary(max_size=12), max_size=4), st.integers(0, 99), st.integers(0, 255))
def test_protobuf_columns_are_the_messages(values, junk, at, byte):
    kind, read = codecs.message_reader(MADE.DESCRIPTOR)
    arrow = to_arrow_type(kind, timestamp_utc=True)
    bodies = [MADE(**v).SerializeToString() for v in values]
    twice = [a + b for a, b in zip(bodies, bodies[::-1], strict=True)]  # later values win, nested messages merge
    broken = [b[: at % (len(b) + 1)] for b in bodies] + [b[:at] + bytes([byte]) + b[at:] for b in bodies]
    every = [*bodies, *twice, *broken, *junk, None]

    def one(b):
        try:
            return read(MADE.FromString(b))
        except DecodeError:
            return None

    structs = lambda rows: pa.array(rows, arrow)
    got = decode_bodies(pa.array(every, pa.binary()), reader_of(MADE.DESCRIPTOR), arrow, one, structs)
    assert repr(got.to_pylist()) == repr(structs([None if b is None else one(b) for b in every]).to_pylist())


def test_messages_without_columns_are_read_one_by_one():
    files = descriptor_pb2.FileDescriptorSet()
    kind = descriptor_pb2.FieldDescriptorProto
    f = files.file.add(name="r.proto", package="r", syntax="proto3")
    m = f.message_type.add(name="Node")
    m.field.add(name="next", number=1, type=kind.TYPE_MESSAGE, type_name=".r.Node", label=kind.LABEL_OPTIONAL)
    n = f.message_type.add(name="Many")
    n.field.add(name="xs", number=1, type=kind.TYPE_INT32, label=kind.LABEL_REPEATED)
    for name in ("Node", "Many"):
        assert reader_of(codecs.message_class(files.SerializeToString(), name).DESCRIPTOR) is None


OLD = json.dumps({"type": "record", "name": "E", "namespace": "x", "doc": "old", "fields": [{"name": "id", "type": "int"}, {"name": "name", "type": "string"}, {"name": "gone", "type": ["double", "null"]}]})
NEW = json.dumps({"type": "record", "name": "E", "namespace": "x", "fields": [{"name": "id", "type": "long"}, {"name": "title", "type": "string", "aliases": ["name"]}, {"name": "age", "type": ["null", "int"], "default": None}, {"name": "k", "type": "double", "default": 1.5}]})


def old(i, name, gone):
    tail = b"\x02" if gone is None else b"\x00" + codecs.avro_encode_record((gone,), [("g", "double")])
    return codecs.avro_encode_record((i, name), [("id", "int"), ("name", "string")]) + tail


def new(*values):
    return codecs.avro_encode_record(values, [("id", "long"), ("title", "string"), ("age", "int?"), ("k", "double")])


A, B = uuid.UUID(int=5).bytes, uuid.UUID(int=6).bytes


def test_two_versions_in_one_topic(spark, tmp_path):
    for name, schema in ((A, OLD), (B, NEW)):
        (tmp_path / f"{uuid.UUID(bytes=name)}.avsc").write_text(schema)
    registry = Registry.load(spark, str(tmp_path))
    assert registry == Registry({A: OLD, B: NEW})
    framed = lambda i, body, packed=False: b"\x03" + (b"\x05" + i + zlib.compress(body) if packed else b"\x00" + i + body)
    values = [framed(A, old(1, "a", None)), framed(B, new(2**40, "b", 7, 0.5)), framed(A, old(3, "c", 2.0), True), framed(bytes(16), b""), b"\x03", None, framed(A, b"\xff"), b"\x03\x05" + A + b"no zlib"]
    rows = spark.createDataFrame([(None if v is None else bytearray(v),) for v in values], "v binary").coalesce(1)
    got = [None if r.e is None else tuple(r.e) for r in rows.select(from_registry_avro(F.col("v"), registry, NEW).alias("e")).collect()]
    assert got == [(1, "a", None, 1.5), (2**40, "b", 7, 0.5), (3, "c", None, 1.5), None, None, None, None, None]
    for v in (values[3], values[6]):
        with pytest.raises(Exception, match="version|malformed"):
            spark.createDataFrame([(bytearray(v),)], "v binary").select(from_registry_avro(F.col("v"), registry, NEW, "FAILFAST")).collect()
    whole = spark.createDataFrame([(bytearray(x),) for x in values[:3]], "v binary").select(from_registry_avro(F.col("v"), registry, NEW, "FAILFAST").alias("e"))
    assert whole.count() == 3
    made = spark.createDataFrame([("{}",), (None,)], "v string").select(frame(F.col("v").cast("binary"), A, compress=True).alias("v"))
    assert [r.b for r in made.select(body_of(F.col("v")).cast("string").alias("b")).collect()] == ["{}", None]


def test_fingerprints_find_the_writers_schema(spark):
    assert codecs.fingerprint_of('"int"')[::-1].hex() == "7275d51a3f395c8f" and codecs.fingerprint_of('"null"')[::-1].hex() == "63dd24e7cc258f8a"  # of the specification
    assert canonical_form(OLD) == '{"name":"x.E","type":"record","fields":[{"name":"id","type":"int"},{"name":"name","type":"string"},{"name":"gone","type":["double","null"]}]}'
    nested = {"type": "record", "name": "a.R", "fields": [{"name": "f", "type": {"type": "fixed", "name": "F", "size": "4"}}, {"name": "g", "type": {"type": "map", "values": "F"}}, {"name": "s", "type": {"type": "string", "x": 1}}]}
    assert canonical_form(nested) == '{"name":"a.R","type":"record","fields":[{"name":"f","type":{"name":"a.F","type":"fixed","size":4}},{"name":"g","type":{"type":"map","values":"a.F"}},{"name":"s","type":"string"}]}'
    mark = lambda s: codecs.SINGLE_OBJECT + codecs.fingerprint_of(canonical_form(s))
    values = [mark(OLD) + old(1, "é", 0.0), mark(NEW) + new(2, "b", None, 9.0), codecs.SINGLE_OBJECT + bytes(8) + b"x", b"plain", None]
    rows = spark.createDataFrame([(None if v is None else bytearray(v),) for v in values], "v binary").coalesce(1)
    got = [None if r.e is None else tuple(r.e) for r in rows.select(from_single_object(F.col("v"), [OLD, NEW], NEW).alias("e")).collect()]
    assert got == [(1, "é", None, 1.5), (2, "b", None, 9.0), None, None, None]
    with pytest.raises(Exception, match="no schema of version"):
        rows.select(from_single_object(F.col("v"), [NEW], NEW, "FAILFAST")).collect()


def test_schemas_that_do_not_resolve():
    reader = schema_fields(NEW)
    with pytest.raises(ValueError, match="no default"):
        Plan([Field("title", "string")], [*reader[:2]])
    with pytest.raises(ValueError, match="does not become"):
        Plan([Field("id", "string")], reader)
    with pytest.raises(ValueError, match="not supported"):
        schema_fields(json.dumps({"fields": [{"name": "m", "type": {"type": "map", "values": "int"}}]}))
    promoted = Plan([Field("id", "int"), Field("name", "bytes")], reader)
    kinds = [pa.field("id", pa.int64()), pa.field("title", pa.string()), pa.field("age", pa.int32()), pa.field("k", pa.float64())]
    bodies = pa.array([b"\x02\x02a", b"\x02\x02\xff"], pa.binary())
    assert decode(Bodies(bodies), promoted, kinds).to_pylist() == [{"id": 1, "title": "a", "age": None, "k": 1.5}, None]


def test_protobuf_versions_and_message_index(spark):
    one, two = codecs.employee_descriptor_set(), descriptor_pb2.FileDescriptorSet.FromString(codecs.employee_descriptor_set())
    f = two.file[-1]
    f.message_type.add(name="Account")
    f.message_type[1].field.add(name="shoe", number=99, type=descriptor_pb2.FieldDescriptorProto.TYPE_INT32, label=descriptor_pb2.FieldDescriptorProto.LABEL_OPTIONAL)
    two = two.SerializeToString()
    assert message_names(one) == ["lake.Employee", "lake.Team"] and message_names(two) == ["lake.Account", "lake.Employee", "lake.Team"]
    body1 = codecs.message_class(one, "Employee")(id=1, name="a").SerializeToString()
    body2 = codecs.message_class(two, "Employee")(id=2, name="b", shoe=44).SerializeToString()
    values = [b"\x03\x00" + A + b"\x00" + body1, b"\x03\x05" + B + zlib.compress(b"\x01" + body2), b"\x03\x00" + B + b"\x00", b"\x03\x00" + bytes(16) + b"\x00" + body1]
    rows = spark.createDataFrame([(bytearray(v),) for v in values], "v binary").coalesce(1)
    got = rows.select(from_registry_protobuf(F.col("v"), Registry({A: one, B: two}), one).alias("e")).collect()
    assert [None if r.e is None else (r.e.id, r.e.name) for r in got] == [(1, "a"), (2, "b"), None, None]
    with pytest.raises(Exception, match="no schema|is no"):
        rows.select(from_registry_protobuf(F.col("v"), Registry({A: one, B: two}), one, mode="FAILFAST")).collect()


def test_inputs_by_versions_through_a_job(spark, tmp_path):
    from sluice import __main__ as cli
    from sluice.plans.queries import proto_value
    from sluice.schemas import EMPLOYEE
    from sluice.sources.log import append_messages
    from sluice.sources.snapshot_table import SnapshotTable

    (tmp_path / "schemas").mkdir()
    (tmp_path / "schemas" / f"{uuid.UUID(bytes=A)}.desc").write_bytes(codecs.employee_descriptor_set())
    rows = spark.sql("SELECT 1L AS employee_id, 30 AS age, TIMESTAMP '2024-01-01 00:00:00' AS start_date, 'a' AS team, 'DEVELOPER' AS role, '1 Quay' AS address, 'n' AS name")
    assert rows.schema.names == [x.split()[0] for x in EMPLOYEE.split(", ")]
    append_messages(rows, str(tmp_path / "log"), topic="e", value=frame(proto_value(), A, True, 0))
    words = ["ingest-watermark", "--log", tmp_path / "log", "--table", tmp_path / "t", "--checkpoint", tmp_path / "c", "--registry", tmp_path / "schemas"]
    cli.run(spark, cli.parser().parse_args([str(w) for w in words]))
    assert [r.name for r in SnapshotTable(spark, str(tmp_path / "t")).scan().collect()] == ["n"]
