"""Avro's JSON encoding as Catalyst expressions: unions name their branch, bytes are Latin-1 text."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.resolve import constant, resolve
from ..schema.model import MISSING, Array, AvroSchema, Enum, Fixed, Map, Node, Primitive, Record, Union, branch_name, is_null, optional, parse_schema
from ..schema.spark_types import DEPTH, _spark, arrow_type, is_decimal


def quoted(text: Column) -> Column:
    """A string as JSON."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _number(c: Column, node: Node) -> Column:
    """The number behind a logical type."""
    logical = node.logical or ""
    if logical == "date":
        return F.unix_date(c)
    if logical.startswith("local-timestamp"):
        c = F.expr("timestamp'1970-01-01 00:00:00 UTC'") + (c - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.unix_millis(c) if logical.endswith("millis") else F.unix_micros(c)


class _Writer:
    def __init__(self, schema: AvroSchema, write_union_type: bool):
        self.schema, self.named = schema, write_union_type

    def text(self, c: Column, node: Node, depth: dict) -> Column:
        node = self.schema.get(node)
        if isinstance(node, Union):
            return self.union(c, node, depth)
        if isinstance(node, Record):
            deeper = {**depth, node.name: depth.get(node.name, 0) + 1}
            if deeper[node.name] > DEPTH:
                return F.lit("null")
            parts = [x for i, f in enumerate(node.fields) for x in (F.lit(("," if i else "") + f'"{f.name}":'), self.text(c.getField(f.name), f.type, deeper))]
            return F.concat(F.lit("{"), *parts, F.lit("}"))
        if isinstance(node, Array):
            return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: self.text(x, node.items, depth)), ","), F.lit("]"))
        if isinstance(node, Map):
            return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(quoted(e["key"]), F.lit(":"), self.text(e["value"], node.values, depth))), ","), F.lit("}"))
        if isinstance(node, Enum):
            return quoted(c)
        if is_decimal(node):
            from .payload import avro_encode

            raw = avro_encode(c, _standalone(self.schema, node))
            return quoted(F.decode(raw if isinstance(node, Fixed) else _after_length(raw), "ISO-8859-1"))
        if isinstance(node, Fixed):
            return quoted(F.decode(c, "ISO-8859-1"))
        assert isinstance(node, Primitive)
        if node.type == "null":
            return F.lit("null")
        if node.type == "bytes":
            return quoted(F.decode(c, "ISO-8859-1"))
        if node.type == "string":
            return quoted(c)
        if _spark(arrow_type(self.schema, node)) != _spark(arrow_type(self.schema, Primitive(type=node.type))):
            return _number(c, node).cast("string")
        return c.cast("string")

    def union(self, c: Column, node: Union, depth: dict) -> Column:
        def named(value: Column, b: Node) -> Column:
            body = self.text(value, b, depth)
            return body if is_null(b) or not self.named else F.concat(F.lit(f'{{"{branch_name(self.schema, b)}":'), body, F.lit("}"))

        if len(node.branches) == 1:
            return named(c, node.branches[0])
        out = F.when(c.isNull(), F.lit("null"))
        if (one := optional(node)) is not None:
            return out.otherwise(named(c, one[1]))
        for i, b in enumerate(node.branches):
            out = out.when(c.getField("tag") == branch_name(self.schema, b), named(c.getField(f"member{i}"), b))
        return out


def _after_length(raw: Column) -> Column:
    """The bytes behind a one-byte length: decimals have at most 17."""
    return F.substring(raw, F.lit(2), F.length(raw))


def _standalone(schema: AvroSchema, node: Node) -> AvroSchema:
    return AvroSchema(node, schema.names)


def avro_to_json(col: Column, schema: Any, *, write_union_type: bool = True) -> Column:
    """Each value as Avro JSON."""
    parsed = parse_schema(schema)
    return _Writer(parsed, write_union_type).text(col, parsed.root, {})


class _Reader:
    """From the text of a JSON value to a typed column. ``from_json`` into strings gives strings bare and all else as JSON text."""

    def __init__(self, schema: AvroSchema):
        self.schema = schema

    def value(self, c: Column, node: Node, depth: dict) -> Column:
        node = self.schema.get(node)
        kind = _spark(arrow_type(self.schema, node, depth))
        if isinstance(node, Union):
            return self.union(c, node, depth, kind)
        if isinstance(node, Record):
            deeper = {**depth, node.name: depth.get(node.name, 0) + 1}
            if deeper[node.name] > DEPTH:
                return F.lit(None)
            return self.with_map(c, lambda m: self.record(m, node, deeper, kind))
        if isinstance(node, Array):
            return F.transform(F.from_json(c, "array<string>"), lambda x: self.value(x, node.items, depth))
        if isinstance(node, Map):
            return F.transform_values(F.from_json(c, "map<string,string>"), lambda _, x: self.value(x, node.values, depth))
        if isinstance(node, Enum):
            return c
        if is_decimal(node):
            return self.number_of(F.encode(c, "ISO-8859-1"), node, kind)
        if isinstance(node, Fixed) or node.type == "bytes":
            return F.encode(c, "ISO-8859-1")
        assert isinstance(node, Primitive)
        if node.type == "string":
            return c
        if node.type == "null":
            return F.lit(None)
        if isinstance(kind, T.DateType):
            return F.date_from_unix_date(c.cast("int"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            n = c.cast("long")
            made = F.timestamp_millis(n) if node.logical.endswith("millis") else F.timestamp_micros(n)
            if isinstance(kind, T.TimestampType):
                return made
            return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + (made - F.expr("timestamp'1970-01-01 00:00:00 UTC'"))
        return c.cast(kind)

    @staticmethod
    def number_of(raw: Column, node: Node, kind: T.DataType) -> Column:
        hex_ = F.hex(raw)
        unsigned = F.aggregate(F.sequence(F.lit(1), F.length(hex_)), F.lit(0).cast("decimal(38,0)"), lambda acc, i: (acc * 16 + F.conv(F.substring(hex_, i, F.lit(1)), 16, 10).cast("decimal(2,0)")).cast("decimal(38,0)"))
        top = F.substring(hex_, 1, 1).isin(*"89ABCDEF")
        power = F.aggregate(F.sequence(F.lit(1), F.length(hex_)), F.lit(1).cast("decimal(38,0)"), lambda acc, _: (acc * 16).cast("decimal(38,0)"))
        exact = F.when(top, unsigned - power).otherwise(unsigned)
        shifted = F.concat(F.when(exact < 0, "-").otherwise(""), F.regexp_replace(F.lpad(F.abs(exact).cast("string"), 39, "0"), f"(.{{{node.scale}}})$", ".$1"))
        return shifted.cast(kind)

    @staticmethod
    def with_map(c: Column, make: Callable[[Column], Column]) -> Column:
        """``make`` over the parsed object, which is parsed once."""
        return F.element_at(F.transform(F.array(F.from_json(c, "map<string,string>")), make), 1)

    def record(self, m: Column, node: Record, depth: dict, kind: T.StructType) -> Column:
        fields = []
        for f in node.fields:
            absent = constant(self.schema, f.type, f.default) if f.default is not MISSING else F.raise_error(F.lit(f"no value and no default for {f.name}")).cast(kind[f.name].dataType)
            there = self.value(F.element_at(m, f.name), f.type, depth).cast(kind[f.name].dataType)
            fields.append(F.when(F.map_contains_key(m, f.name), there).otherwise(absent).alias(f.name))
        return F.when(m.isNotNull(), F.struct(*fields))

    def union(self, c: Column, node: Union, depth: dict, kind: T.DataType) -> Column:
        one = optional(node)

        def pick(m: Column) -> Column:
            out = F.when(m.isNull(), F.lit(None).cast(kind)) if one is not None or len(node.branches) == 1 else F.when(m.isNull(), self.tagged(node, None, None, kind))
            for i, b in enumerate(node.branches):
                if not is_null(b):
                    name = branch_name(self.schema, b)
                    got = self.value(F.element_at(m, name), b, depth)
                    out = out.when(F.map_contains_key(m, name), got.cast(kind) if one is not None or len(node.branches) == 1 else self.tagged(node, i, got, kind))
            return out.otherwise(F.raise_error(F.lit("no branch of the union is named")).cast(kind))

        return self.with_map(c, pick)

    def tagged(self, node: Union, at: int | None, value: Column | None, kind: T.StructType) -> Column:
        name = branch_name(self.schema, node.branches[at]) if at is not None else "null"
        return F.struct(F.lit(name).alias("tag"), *((value if i == at else F.lit(None)).cast(kind[f"member{i}"].dataType).alias(f"member{i}") for i in range(len(node.branches)))).cast(kind)


def avro_from_json(col: Column, schema: Any, reader_schema: Any = None) -> Column:
    """Values from Avro JSON; absent fields take their defaults, and ``reader_schema`` is resolved like for binary data."""
    parsed = parse_schema(schema)
    reader = _Reader(parsed)
    root = parsed.get(parsed.root)
    text = col if isinstance(root, (Record, Union, Array, Map)) else F.element_at(F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>"), 1)
    out = reader.value(text, parsed.root, {})
    return resolve(out, parsed, reader_schema) if reader_schema is not None else out
