"""Test data for a schema: columns from hashes of (seed, row, place), so any task makes the same rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema.model import Array, AvroSchema, Enum, Fixed, Map, Node, Primitive, Record, Union, branch_name, is_null, optional, parse_schema
from ..schema.spark_types import DEPTH, _spark, arrow_type, is_decimal

#: Items of a list or map.
ITEMS = 10
DAY, YEAR = 86_400_000_000, 365 * 86_400_000_000


class _Maker:
    def __init__(self, schema: AvroSchema, seed: int):
        self.schema, self.seed, self.place = schema, seed, 0

    def hash(self, row: Column) -> Column:
        self.place += 1
        return F.xxhash64(row, F.lit(self.seed), F.lit(self.place))

    def below(self, row: Column, n: int) -> Column:
        return F.pmod(self.hash(row), F.lit(n))

    def make(self, row: Column, node: Node, depth: dict) -> Column:
        node = self.schema.get(node)
        kind = _spark(arrow_type(self.schema, node, depth))
        if isinstance(node, Union):
            # a branch that would nest too deeply is not taken
            open_ = [i for i, b in enumerate(node.branches) if is_null(b) or not isinstance(_spark(arrow_type(self.schema, b, depth)), T.NullType)]
            pick = self.below(row, len(open_))
            out = None
            for k, i in enumerate(open_):
                b = node.branches[i]
                value = F.lit(None) if is_null(b) else self.make(row, b, depth)
                if optional(node) is None and len(node.branches) > 1:
                    value = F.struct(F.lit(branch_name(self.schema, b)).alias("tag"), *((value if j == i else F.lit(None)).cast(kind[f"member{j}"].dataType).alias(f"member{j}") for j in range(len(node.branches))))
                out = F.when(pick == k, value.cast(kind)) if out is None else out.when(pick == k, value.cast(kind))
            return out
        if isinstance(node, Record):
            deeper = {**depth, node.name: depth.get(node.name, 0) + 1}
            if deeper[node.name] > DEPTH:
                return F.lit(None)
            return F.struct(*(self.make(row, f.type, deeper).cast(kind[f.name].dataType).alias(f.name) for f in node.fields))
        if isinstance(node, Array):
            return F.transform(F.sequence(F.lit(1), F.lit(ITEMS)), lambda i: self.make(F.xxhash64(row, i), node.items, depth)).cast(kind)
        if isinstance(node, Map):
            keys = F.transform(F.sequence(F.lit(1), F.lit(ITEMS)), lambda i: F.concat(F.lit("k"), i.cast("string"), F.lit("_"), F.hex(F.xxhash64(row, i))))
            return F.map_from_arrays(keys, F.transform(F.sequence(F.lit(1), F.lit(ITEMS)), lambda i: self.make(F.xxhash64(row, i), node.values, depth))).cast(kind)
        if isinstance(node, Enum):
            return F.element_at(F.array(*map(F.lit, node.symbols)), (self.below(row, len(node.symbols)) + 1).cast("int"))
        if is_decimal(node):
            digits = min(node.precision, 18)
            n = self.below(row, 10**digits).cast("decimal(19,0)")
            return (n.cast(f"decimal({max(node.precision, 19)},0)") / F.lit(10**node.scale).cast(f"decimal({node.scale + 1},0)")).cast(kind)
        if isinstance(node, Fixed):
            whole = F.concat(*(F.unhex(F.lpad(F.hex(self.hash(row)), 16, "0")) for _ in range(-(-max(1, node.size) // 8))))
            return F.substring(whole, 1, node.size) if node.size else F.lit(b"")
        assert isinstance(node, Primitive)
        return self.primitive(row, node)

    def primitive(self, row: Column, node: Primitive) -> Column:
        if node.logical == "uuid":
            return F.regexp_replace(F.lower(F.concat(*(F.lpad(F.hex(self.hash(row)), 16, "0") for _ in range(2)))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        if node.logical == "date":
            return F.date_from_unix_date(self.below(row, 40_000).cast("int"))
        if node.logical in ("timestamp-millis", "timestamp-micros"):
            return F.timestamp_millis(self.below(row, 60 * YEAR // 1000)) if node.logical.endswith("millis") else F.timestamp_micros(self.below(row, 60 * YEAR))
        if node.logical in ("local-timestamp-millis", "local-timestamp-micros"):
            step = 1000 if node.logical.endswith("millis") else 1
            return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (self.below(row, 60 * YEAR // step) * step / F.lit(1_000_000)).cast("decimal(18,6)"))
        if node.logical == "time-millis":
            return self.below(row, DAY // 1000).cast("int")
        if node.logical == "time-micros":
            return self.below(row, DAY)
        made = {
            "null": lambda: F.lit(None),
            "boolean": lambda: self.below(row, 2) == 1,
            "int": lambda: (self.below(row, 1 << 32) - (1 << 31)).cast("int"),
            "long": lambda: self.hash(row),
            "float": lambda: (self.below(row, 1 << 24) / F.lit(float(1 << 24))).cast("float"),
            "double": lambda: self.below(row, 1 << 53) / F.lit(float(1 << 53)),
            "bytes": lambda: F.unhex(F.lpad(F.hex(self.hash(row)), 16, "0")),
            "string": lambda: F.lower(F.conv(F.hex(self.hash(row)), 16, 36)),
        }
        return made[node.type]()


def generate(spark: SparkSession, schema: Any, count: int, seed: int = 0) -> DataFrame:
    """``count`` rows of data of a schema; a record's fields are the columns, other data is in ``value``."""
    parsed = parse_schema(schema)
    row = spark.range(count)
    made = _Maker(parsed, seed).make(F.col("id"), parsed.root, {}).alias("value")
    out = row.select(made)
    return out.select("value.*") if isinstance(parsed.get(parsed.root), Record) else out
