"""Schema resolution as a projection.

``resolve`` turns (writer, reader) into one Column over data decoded in the writer's shape: pruning,
renames, promotions, defaults, enum defaults and union branches become casts, struct fields, literals and CASE.
What the rules settle from the schemas alone fails here, on the driver; what depends on a row (a branch
that the reader lacks, an unknown symbol) becomes ``raise_error`` behind its condition.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.literal import default_value
from ..schema.model import MISSING, Array, AvroSchema, Enum, Field, Fixed, Map, Named, Node, Primitive, Record, SchemaResolutionError, Union, branch_name, is_null, optional, parse_schema
from ..schema.spark_types import _spark, arrow_type

# Fixed values of the format: which primitive types a writer's type may be read as.
PROMOTIONS = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}


def _short(name: str) -> str:
    return name.rpartition(".")[2]


def same_name(w: Named, r: Named) -> bool:
    """Names match without their namespaces, or by one of the reader's aliases."""
    return _short(w.name) == _short(r.name) or w.name in r.aliases or _short(w.name) in {_short(a) for a in r.aliases}


def matches(ws: AvroSchema, w: Node, rs: AvroSchema, r: Node) -> bool:
    """Whether a writer's type can be read as a reader's. With a union on either side that is settled row by row."""
    w, r = ws.get(w), rs.get(r)
    if isinstance(w, Union) or isinstance(r, Union):
        return True
    if isinstance(w, Primitive) and isinstance(r, Primitive):
        return w.type == r.type or r.type in PROMOTIONS.get(w.type, ())
    if isinstance(w, Named) and isinstance(r, Named) and type(w) is type(r):
        return same_name(w, r) and (not isinstance(w, Fixed) or w.size == r.size)
    if isinstance(w, Array) and isinstance(r, Array):
        return matches(ws, w.items, rs, r.items)
    return isinstance(w, Map) and isinstance(r, Map) and matches(ws, w.values, rs, r.values)


def _branch(ws: AvroSchema, w: Node, rs: AvroSchema, r: Union) -> int | None:
    """The first branch of a reader's union that can take a writer's type."""
    return next((i for i, b in enumerate(r.branches) if matches(ws, w, rs, b)), None)


def _kind(s: AvroSchema, n: Node) -> T.DataType:
    return _spark(arrow_type(s, n))


def _fail(text: str, kind: T.DataType) -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


def _text(s: AvroSchema, n: Node) -> str:
    n = s.get(n)
    return f"[{', '.join(_text(s, b) for b in n.branches)}]" if isinstance(n, Union) else branch_name(s, n)


def constant(schema: AvroSchema, node: Node, value: Any) -> Column:
    """A JSON default as a literal of the node's type."""
    return literal(default_value(schema, node, value), _kind(schema, node))


def literal(value: Any, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*(literal(value.get(f.name), f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return F.array(*(literal(x, kind.elementType) for x in value)).cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*(c for k, x in value.items() for c in (F.lit(k), literal(x, kind.valueType)))).cast(kind)
    return F.lit(value).cast(kind)


def _source(w: Record, f: Field) -> Field | None:
    """The writer's field that a reader's field takes: of its name, else of an alias."""
    by_name = {x.name: x for x in w.fields}
    return next((by_name[n] for n in (f.name, *f.aliases) if n in by_name), None)


def needed_fields(ws: AvroSchema, rs: AvroSchema) -> list[str] | None:
    """The top-level fields of the writer that the reader takes; None if all are needed."""
    w, r = ws.get(ws.root), rs.get(rs.root)
    if not (isinstance(w, Record) and isinstance(r, Record)):
        return None
    return [s.name for f in r.fields if (s := _source(w, f)) is not None]


class _Resolver:
    def __init__(self, ws: AvroSchema, rs: AvroSchema):
        self.ws, self.rs = ws, rs

    def column(self, c: Column, w: Node, r: Node, depth: int = 0) -> Column:
        w, r = self.ws.get(w), self.rs.get(r)
        if isinstance(w, Union):
            return self.of_union(c, w, r, depth)
        if isinstance(r, Union):
            return self.to_union(c, w, r, depth)
        if not matches(self.ws, w, self.rs, r):
            raise SchemaResolutionError(f"Schema mismatch: {_text(self.ws, w)} is not {_text(self.rs, r)}")
        if isinstance(w, Primitive):
            return self.primitive(c, w, r)
        if isinstance(w, Fixed):
            return c
        if isinstance(w, Enum):
            return self.enum(c, w, r)
        if isinstance(w, Array):
            return F.transform(c, lambda x: self.column(x, w.items, r.items, depth))
        if isinstance(w, Map):
            return F.transform_values(c, lambda _, x: self.column(x, w.values, r.values, depth))
        assert isinstance(w, Record) and isinstance(r, Record)
        return self.record(c, w, r, depth)

    def primitive(self, c: Column, w: Primitive, r: Primitive) -> Column:
        if w.logical and _kind(self.ws, w) != _kind(self.ws, Primitive(type=w.type)):
            return c  # the writer's logical type comes first
        if w.type == "string" and r.type == "bytes":
            return F.encode(c, "UTF-8")
        if w.type == "bytes" and r.type == "string":
            return F.decode(c, "UTF-8")
        return c if w.type == r.type else c.cast(_kind(self.rs, Primitive(type=r.type)))

    def enum(self, c: Column, w: Enum, r: Enum) -> Column:
        if set(w.symbols) <= set(r.symbols):
            return c
        known = F.lit(", ".join(r.symbols))
        other = F.lit(r.default) if r.default else F.raise_error(F.concat(c, F.lit(f" is no symbol of the reader's {r.name}, which has ["), known, F.lit("]"))).cast("string")
        return F.when(c.isNull() | c.isin(*r.symbols), c).otherwise(other)

    def record(self, c: Column, w: Record, r: Record, depth: int) -> Column:
        if depth > 16:
            raise SchemaResolutionError(f"{r.name} is nested too deeply")
        kind = _kind(self.rs, r)
        have = _kind(self.ws, w)
        fields = []
        for f in r.fields:
            source = _source(w, f)
            if source is not None:
                inner = have[source.name].dataType if isinstance(have, T.StructType) else T.NullType()
                made = F.lit(None) if isinstance(inner, T.NullType) and isinstance(self.ws.get(source.type), (Record, Union)) else self.column(c.getField(source.name), source.type, f.type, depth + 1)
            elif f.default is not MISSING:
                made = constant(self.rs, f.type, f.default)
            else:
                raise SchemaResolutionError(f"No default value for field {f.name} in {r.name}")
            fields.append(made.cast(kind[f.name].dataType).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*fields))

    def to_union(self, c: Column, w: Node, r: Union, depth: int) -> Column:
        at = _branch(self.ws, w, self.rs, r)
        if at is None:
            raise SchemaResolutionError(f"Schema mismatch: {_text(self.ws, w)} not found in {_text(self.rs, r)}")
        return self.member(self.column(c, w, r.branches[at], depth), r, at)

    def member(self, value: Column, r: Union, at: int) -> Column:
        """A branch's value in the shape of the reader's union."""
        if optional(r) is not None or len(r.branches) == 1:
            return value
        kind = _kind(self.rs, r)
        assert isinstance(kind, T.StructType)
        members = [(value if i == at and not is_null(b) else F.lit(None)).cast(kind[f"member{i}"].dataType).alias(f"member{i}") for i, b in enumerate(r.branches)]
        return F.struct(F.lit(branch_name(self.rs, r.branches[at])).alias("tag"), *members)

    def of_union(self, c: Column, w: Union, r: Node, depth: int) -> Column:
        kind = _kind(self.rs, r)

        def branch(value: Column, b: Node) -> Column:
            if isinstance(r, Union):
                at = _branch(self.ws, b, self.rs, r)
                return _fail(f"Schema mismatch: {_text(self.ws, b)} not found in {_text(self.rs, r)}", kind) if at is None else self.member(self.column(value, b, r.branches[at], depth), r, at).cast(kind)
            if not matches(self.ws, b, self.rs, r):
                return _fail(f"Schema mismatch: {_text(self.ws, b)} is not {_text(self.rs, r)}", kind)
            return self.column(value, b, r, depth).cast(kind)

        if len(w.branches) == 1:
            return branch(c, w.branches[0])
        null = Primitive(type="null")
        if (one := optional(w)) is not None:
            return F.when(c.isNull(), branch(F.lit(None), null)).otherwise(branch(c, one[1]))
        out = F.when(c.isNull(), F.lit(None).cast(kind))
        for i, b in enumerate(w.branches):
            out = out.when(c.getField("tag") == branch_name(self.ws, b), branch(F.lit(None) if is_null(b) else c.getField(f"member{i}"), b))
        return out


def resolve(c: Column, writer: Any, reader: Any) -> Column:
    """``c``, decoded with ``writer``, as data of ``reader``."""
    ws, rs = parse_schema(writer), parse_schema(reader)
    if ws.json() == rs.json():
        return c
    return _Resolver(ws, rs).column(c, ws.root, rs.root)
