"""Custom logical types: Column functions by the key ``<avro type>-<logical type>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema.model import Array, AvroSchema, Enum, Fixed, Map, Node, Primitive, Record, Union, branch_name, optional

READERS: dict[str, Callable[[Column], Column]] = {}
WRITERS: dict[str, Callable[[Column], Column]] = {}


def register(key: str, *, reader: Callable[[Column], Column] | None = None, writer: Callable[[Column], Column] | None = None) -> None:
    """From now on fields of this logical type pass through ``reader`` after decoding and ``writer`` before encoding."""
    if reader is not None:
        READERS[key] = reader
    if writer is not None:
        WRITERS[key] = writer


def _key(node: Node) -> str | None:
    kind = node.type if isinstance(node, Primitive) else "fixed" if isinstance(node, Fixed) else None
    return f"{kind}-{node.logical}" if kind and getattr(node, "logical", None) else None


class Walk:
    """Rebuilds a column along a schema where ``change(column, node)`` gives a new one; what it does not touch stays as it is."""

    def __init__(self, schema: AvroSchema, change: Callable[[Column, Node], Column | None], touches: Callable[[Node], bool], tagged: bool = True):
        self.schema, self.change, self.touched, self.tagged = schema, change, touches, tagged

    def reaches(self, node: Node, inside: tuple = ()) -> bool:
        node = self.schema.get(node)
        if self.touched(node):
            return True
        if isinstance(node, Record):
            return node.name not in inside and any(self.reaches(f.type, (*inside, node.name)) for f in node.fields)
        if isinstance(node, Array):
            return self.reaches(node.items, inside)
        if isinstance(node, Map):
            return self.reaches(node.values, inside)
        if isinstance(node, Union):
            return (optional(node) is not None or len(node.branches) == 1 or self.tagged) and any(self.reaches(b, inside) for b in node.branches)
        return False

    def run(self, c: Column, node: Node, inside: tuple = ()) -> Column:
        node = self.schema.get(node)
        if not self.reaches(node, inside):
            return c
        if isinstance(node, Record):
            for f in node.fields:
                if self.reaches(f.type, (*inside, node.name)):
                    c = c.withField(f.name, self.run(c.getField(f.name), f.type, (*inside, node.name)))
        elif isinstance(node, Array):
            c = F.transform(c, lambda x: self.run(x, node.items, inside))
        elif isinstance(node, Map):
            c = F.transform_values(c, lambda _, x: self.run(x, node.values, inside))
        elif isinstance(node, Union):
            one = optional(node)
            if one is not None or len(node.branches) == 1:
                c = self.run(c, one[1] if one is not None else node.branches[0], inside)
            else:
                for i, b in enumerate(node.branches):
                    if self.reaches(b, inside):
                        c = c.withField(f"member{i}", self.run(c.getField(f"member{i}"), b, inside))
        made = self.change(c, node)
        return c if made is None else made


def _custom(c: Column, schema: AvroSchema, table: dict, tagged: bool) -> Column:
    def change(x: Column, node: Node) -> Column | None:
        fn = table.get(_key(node))
        return fn(x) if fn else None

    return Walk(schema, change, lambda n: _key(n) in table, tagged).run(c, schema.root) if table else c


def custom_reader(c: Column, schema: AvroSchema) -> Column:
    """A decoded column with its custom logical types read, however deep they lie."""
    return _custom(c, schema, READERS, True)


def custom_writer(c: Column, schema: AvroSchema) -> Column:
    """A column ready for encoding; fields of custom logical types must be there. Untagged unions of several branches stay as they are."""
    return _custom(c, schema, WRITERS, False)


def named_unions(c: Column, schema: AvroSchema, *, records: bool = False, named: bool = False) -> Column:
    """Unions of null and a record (``named``: or another named type) as struct<tag, member>, as wider unions always are."""
    kinds = (Record, Enum, Fixed) if named else (Record,)

    def wraps(node: Node) -> bool:
        return isinstance(node, Union) and (one := optional(node)) is not None and isinstance(schema.get(one[1]), kinds)

    def change(x: Column, node: Node) -> Column | None:
        if not wraps(node):
            return None
        at, real = optional(node)
        return F.when(x.isNotNull(), F.struct(F.lit(branch_name(schema, real)).alias("tag"), x.alias(f"member{1 - at}")))

    return Walk(schema, change, wraps).run(c, schema.root) if records or named else c


def time_of_day(c: Column, logical: str) -> Column:
    """A time-millis or time-micros number as TIME; needs ``spark.sql.timeType.enabled``."""
    micros = c.cast("long") * (1000 if logical == "time-millis" else 1)
    seconds = micros / F.lit(1_000_000)
    return F.make_time((micros / 3_600_000_000).cast("int"), ((micros % 3_600_000_000) / 60_000_000).cast("int"), (seconds % 60).cast("decimal(16,6)"))
