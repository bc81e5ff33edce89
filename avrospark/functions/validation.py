"""Validation of typed columns: predicates and lists of errors."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema.model import MISSING, Array, AvroSchema, Enum, Fixed, Map, Node, Primitive, Record, Union, branch_name, is_null, optional, parse_schema
from ..schema.spark_types import is_decimal

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = {"date": (T.DateType,), "timestamp-millis": (T.TimestampType,), "timestamp-micros": (T.TimestampType,), "local-timestamp-millis": (T.TimestampNTZType,), "local-timestamp-micros": (T.TimestampNTZType,)}


class _Checker:
    """Compiles (value, its Spark type, schema) to (field, is it wrong, value as text, what was expected)."""

    def __init__(self, schema: AvroSchema, strict: bool):
        self.schema, self.strict = schema, strict

    def ok(self, c: Column, kind: T.DataType, node: Node) -> Column:
        node = self.schema.get(node)
        if isinstance(node, Union):
            if isinstance(kind, T.StructType) and "tag" in kind.names and optional(node) is None:
                out = F.lit(False)
                for i, b in enumerate(node.branches):
                    member = F.lit(True) if is_null(b) else self.ok(c.getField(f"member{i}"), kind[f"member{i}"].dataType, b) if f"member{i}" in kind.names else F.lit(False)
                    out = out | ((c.getField("tag") == branch_name(self.schema, b)) & member)
                return F.coalesce(out, F.lit(any(map(is_null, node.branches))))
            out = F.lit(False)
            for b in node.branches:
                out = out | self.ok(c, kind, b)
            return out
        if is_null(node):
            return c.isNull()
        return c.isNotNull() & F.coalesce(self.typed(c, kind, node), F.lit(False))

    def typed(self, c: Column, kind: T.DataType, node: Node) -> Column:
        if isinstance(node, Record):
            if not isinstance(kind, T.StructType):
                return F.lit(False)
            out = F.lit(True)
            for f in node.fields:
                if f.name in kind.names:
                    out = out & self.ok(c.getField(f.name), kind[f.name].dataType, f.type)
                elif self.strict:
                    return F.lit(False)
                elif f.default is MISSING:
                    out = out & self.ok(F.lit(None), T.NullType(), f.type)
            if self.strict and set(kind.names) - {f.name for f in node.fields}:
                return F.lit(False)
            return out
        if isinstance(node, Array):
            return F.forall(c, lambda x: self.ok(x, kind.elementType, node.items)) if isinstance(kind, T.ArrayType) else F.lit(False)
        if isinstance(node, Map):
            return F.forall(F.map_values(c), lambda x: self.ok(x, kind.valueType, node.values)) if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) else F.lit(False)
        if isinstance(node, Enum):
            return c.isin(*node.symbols) if isinstance(kind, T.StringType) else F.lit(False)
        if is_decimal(node) and isinstance(kind, T.DecimalType):
            return (c.cast(f"decimal({node.precision},{node.scale})") == c) if kind.precision <= 38 else F.lit(False)
        if isinstance(node, Fixed):
            return (F.octet_length(c) == node.size) if isinstance(kind, T.BinaryType) else F.lit(False)
        assert isinstance(node, Primitive)
        if node.logical in TIMES and isinstance(kind, TIMES[node.logical]):
            return F.lit(True)
        simple = {"boolean": (T.BooleanType,), "string": (T.StringType,), "bytes": (T.BinaryType,), "float": (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType), "double": (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)}
        if node.type in simple:
            return F.lit(isinstance(kind, simple[node.type]))
        if not isinstance(kind, INTEGERS):
            return F.lit(False)
        return c.between(-(1 << 31), (1 << 31) - 1) if node.type == "int" else F.lit(True)

    def errors(self, c: Column, kind: T.DataType, node: Node, at: str) -> list[Column]:
        real = self.schema.get(node)
        if isinstance(real, Record) and isinstance(kind, T.StructType):
            out = [self.error(c.isNull(), c, real, at)]
            for f in real.fields:
                where = f"{at}.{f.name}" if at else f.name
                if f.name in kind.names:
                    out += [F.when(c.isNotNull(), e) for e in self.errors(c.getField(f.name), kind[f.name].dataType, f.type, where)]
                elif self.strict or f.default is MISSING:
                    out.append(self.error(c.isNotNull() & (F.lit(self.strict) | ~self.ok(F.lit(None), T.NullType(), f.type)), F.lit(None), self.schema.get(f.type), where))
            return out
        return [self.error(~self.ok(c, kind, real), c, real, at)]

    def error(self, bad: Column, c: Column, node: Node, at: str) -> Column:
        name = ", ".join(branch_name(self.schema, b) for b in node.branches) if isinstance(node, Union) else branch_name(self.schema, node)
        return F.when(bad, F.struct(F.lit(at).alias("field"), c.cast("string").alias("value"), F.lit(name).alias("expected")))


def avro_valid(col: Column, kind: T.DataType, schema: Any, *, strict: bool = False) -> Column:
    """Whether each value of ``col``, of the Spark type ``kind``, is data of the schema."""
    parsed = parse_schema(schema)
    return _Checker(parsed, strict).ok(col, kind, parsed.root)


def avro_errors(col: Column, kind: T.DataType, schema: Any, *, strict: bool = False) -> Column:
    """array<struct<field, value, expected>>: what is wrong with each value."""
    parsed = parse_schema(schema)
    return F.filter(F.array(*_Checker(parsed, strict).errors(col, kind, parsed.root, "")), lambda e: e.isNotNull())
