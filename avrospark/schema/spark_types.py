"""Avro types as Spark and Arrow types, and DataFrame schemas as Avro schemas."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from .model import Array, AvroSchema, Enum, Fixed, Map, Node, Primitive, Record, Union, branch_name, is_null, optional, parse_schema

#: How deep a type may hold itself; deeper data raises.
DEPTH = 3
SIMPLE = {"null": pa.null(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "bytes": pa.binary(), "string": pa.string()}
#: What a value of a primitive or fixed type with a logical type becomes.
LOGICAL = {
    ("int", "date"): pa.date32(),
    ("long", "timestamp-millis"): pa.timestamp("us", "UTC"),
    ("long", "timestamp-micros"): pa.timestamp("us", "UTC"),
    ("long", "local-timestamp-millis"): pa.timestamp("us"),
    ("long", "local-timestamp-micros"): pa.timestamp("us"),
}


def is_decimal(node: Node) -> bool:
    return node.logical == "decimal" and node.precision is not None and node.precision <= 38 and (isinstance(node, Fixed) or isinstance(node, Primitive) and node.type == "bytes")


def arrow_type(schema: AvroSchema, node: Node | None = None, depth: dict | None = None) -> pa.DataType:
    """The type in which the kernels hold values of a node."""
    node = schema.root if node is None else node
    depth = depth or {}
    real = schema.get(node)
    if isinstance(real, Record):
        deeper = {**depth, real.name: depth.get(real.name, 0) + 1}
        if deeper[real.name] > DEPTH:
            return pa.null()
        return pa.struct([pa.field(f.name, arrow_type(schema, f.type, deeper)) for f in real.fields])
    if is_decimal(real):
        return pa.decimal128(real.precision, real.scale)
    if isinstance(real, Primitive):
        return LOGICAL.get((real.type, real.logical), SIMPLE[real.type])
    if isinstance(real, Fixed):
        return pa.binary()
    if isinstance(real, Enum):
        return pa.string()
    if isinstance(real, Array):
        return pa.list_(arrow_type(schema, real.items, depth))
    if isinstance(real, Map):
        return pa.map_(pa.string(), arrow_type(schema, real.values, depth))
    assert isinstance(real, Union)
    if (one := optional(real)) is not None:
        return arrow_type(schema, one[1], depth)
    if len(real.branches) == 1:
        return arrow_type(schema, real.branches[0], depth)
    return pa.struct([("tag", pa.string()), *((f"member{i}", arrow_type(schema, b, depth)) for i, b in enumerate(real.branches))])


def _spark(t: pa.DataType) -> T.DataType:
    if pa.types.is_struct(t):
        return T.StructType([T.StructField(f.name, _spark(f.type)) for f in t])
    if pa.types.is_map(t):
        return T.MapType(T.StringType(), _spark(t.item_type))
    if pa.types.is_list(t):
        return T.ArrayType(_spark(t.value_type))
    if pa.types.is_decimal(t):
        return T.DecimalType(t.precision, t.scale)
    if pa.types.is_timestamp(t):
        return T.TimestampType() if t.tz else T.TimestampNTZType()
    return {pa.null(): T.NullType(), pa.bool_(): T.BooleanType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.float32(): T.FloatType(), pa.float64(): T.DoubleType(), pa.binary(): T.BinaryType(), pa.string(): T.StringType(), pa.date32(): T.DateType()}[t]


def to_spark_type(schema: Any) -> T.DataType:
    """The Spark type of a schema. Unions: null and T is T; others are struct<tag, member0, ...> with one member set."""
    return _spark(arrow_type(parse_schema(schema)))


def from_spark_type(kind: T.DataType, name: str = "topLevelRecord", namespace: str = "", nullable: bool = False) -> Any:
    """The Avro JSON of a Spark type; nullable fields are unions with null, their default."""
    made = _avro(kind, f"{namespace}.{name}" if namespace else name)
    return ["null", made] if nullable else made


def _avro(kind: T.DataType, name: str) -> Any:
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            one = {"name": f.name, "type": _avro(f.dataType, f"{name}.{f.name}")}
            if f.nullable and one["type"] != "null":
                one |= {"type": ["null", one["type"]], "default": None}
            fields.append(one)
        return {"type": "record", "name": name, "fields": fields}
    if isinstance(kind, T.ArrayType):
        item = _avro(kind.elementType, f"{name}.element")
        return {"type": "array", "items": ["null", item] if kind.containsNull and item != "null" else item}
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise ValueError(f"map keys must be strings, not {kind.keyType.simpleString()}")
        value = _avro(kind.valueType, f"{name}.value")
        return {"type": "map", "values": ["null", value] if kind.valueContainsNull and value != "null" else value}
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    simple = {
        T.NullType: "null", T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double",
        T.BinaryType: "bytes", T.StringType: "string", T.DateType: {"type": "int", "logicalType": "date"}, T.TimestampType: {"type": "long", "logicalType": "timestamp-micros"},
        T.TimestampNTZType: {"type": "long", "logicalType": "local-timestamp-micros"},
    }
    if hasattr(T, "TimeType") and isinstance(kind, T.TimeType):
        return {"type": "int", "logicalType": "time-millis"} if kind.precision <= 3 else {"type": "long", "logicalType": "time-micros"}
    for k, v in simple.items():
        if type(kind) is k or isinstance(kind, k):
            return v
    raise ValueError(f"no Avro type for {kind.simpleString()}")


__all__ = ["DEPTH", "arrow_type", "branch_name", "from_spark_type", "is_decimal", "is_null", "to_spark_type"]
