"""The schema tree and its parser.

A parsed schema is a tree of frozen nodes plus the table of its named types; a use of a named type is a
``Ref``. ``AvroSchema.json()`` gives the normalised form: full names, no namespaces, extra attributes kept.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

# Fixed values of the format: the primitive types.
PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class SchemaParseException(Exception):
    """A schema that breaks a rule of the format."""


class SchemaResolutionError(Exception):
    """Data of the writer's schema can't be read as the reader's."""


class UnknownType(Exception):
    """A name that no type declares."""

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Missing:
    def __repr__(self) -> str:
        return "<missing>"

    def __reduce__(self):
        return "MISSING"


MISSING = _Missing()


@dataclass(frozen=True)
class Node:
    """What all schema nodes have: a logical type with its attributes, and attributes of no meaning here."""

    logical: str | None = field(default=None, kw_only=True)
    precision: int | None = field(default=None, kw_only=True)
    scale: int = field(default=0, kw_only=True)
    extra: tuple = field(default=(), kw_only=True)
    wrapped: bool = field(default=False, kw_only=True)  # written as {"type": ...}


@dataclass(frozen=True)
class Primitive(Node):
    type: str = "null"


@dataclass(frozen=True)
class Named(Node):
    name: str = ""
    aliases: tuple[str, ...] = field(default=(), kw_only=True)


@dataclass(frozen=True)
class Fixed(Named):
    size: int = field(default=0, kw_only=True)


@dataclass(frozen=True)
class Enum(Named):
    symbols: tuple[str, ...] = field(default=(), kw_only=True)
    default: Any = field(default=None, kw_only=True)


@dataclass(frozen=True)
class Field:
    name: str
    type: Node
    default: Any = MISSING
    aliases: tuple[str, ...] = ()
    extra: tuple = ()


@dataclass(frozen=True)
class Record(Named):
    fields: tuple[Field, ...] = field(default=(), kw_only=True)
    error: bool = field(default=False, kw_only=True)


@dataclass(frozen=True)
class Array(Node):
    items: Node = field(default_factory=Primitive, kw_only=True)


@dataclass(frozen=True)
class Map(Node):
    values: Node = field(default_factory=Primitive, kw_only=True)


@dataclass(frozen=True)
class Union(Node):
    branches: tuple[Node, ...] = field(default=(), kw_only=True)


@dataclass(frozen=True)
class Ref(Node):
    name: str = ""


@dataclass
class AvroSchema:
    root: Node
    names: dict[str, Named]

    def get(self, node: Node) -> Node:
        """The node, or the type that a reference names."""
        return self.names[node.name] if isinstance(node, Ref) else node

    def json(self) -> Any:
        return _json(self.root)

    def text(self) -> str:
        return json.dumps(self.json())


def fullname(schema: Mapping) -> str:
    """The full name of a named schema in its own namespace."""
    return _full(schema, "")[1]


def _full(schema: Mapping, namespace: str) -> tuple[str, str]:
    """(namespace for what is inside, full name). A null or empty namespace clears what is inherited."""
    if "name" not in schema:
        raise SchemaParseException(f'"name" is a required field missing from the schema: {dict(schema)}')
    name = schema["name"]
    if "." in name:
        return name.rpartition(".")[0], name
    inside = (schema["namespace"] or "") if "namespace" in schema else namespace
    return inside, f"{inside}.{name}" if inside else name


def _qualified(name: str, namespace: str) -> str:
    return name if "." in name or not namespace else f"{namespace}.{name}"


def parse_schema(schema: Any, names: dict[str, Named] | None = None, *, ignore_default_errors: bool = False) -> AvroSchema:
    """Parses JSON text or the loaded JSON of a schema. ``names`` are types known from before; new ones are added."""
    if isinstance(schema, AvroSchema):
        return schema
    if isinstance(schema, str):
        text = schema.strip()
        if text[:1] in '{["' and text not in PRIMITIVES:
            schema = json.loads(text)
    known = names if names is not None else {}
    return AvroSchema(_Parser(known, ignore_default_errors).node(schema, ""), known)


#: Attributes that have a meaning; all others are kept as they are.
_KNOWN = {"type", "name", "namespace", "aliases", "fields", "symbols", "size", "items", "values", "logicalType", "precision", "scale"}


class _Parser:
    def __init__(self, names: dict[str, Named], lenient: bool):
        self.names, self.lenient = names, lenient

    def node(self, schema: Any, namespace: str) -> Node:
        if isinstance(schema, list):
            return Union(branches=tuple(self.node(x, namespace) for x in schema))
        if isinstance(schema, str):
            if schema in PRIMITIVES:
                return Primitive(type=schema)
            name = _qualified(schema, namespace)
            if name not in self.names:
                raise UnknownType(name)
            return Ref(name=name)
        if not isinstance(schema, Mapping):
            raise SchemaParseException(f"not a schema: {schema!r}")
        kind = schema.get("type")
        if isinstance(kind, (Mapping, list)):
            return self.node(kind, namespace)
        about = {"extra": tuple((k, _freeze(v)) for k, v in schema.items() if k not in _KNOWN), "wrapped": True}
        about |= self.logical(schema, kind)
        if kind in PRIMITIVES:
            return Primitive(type=kind, **about)
        if kind == "array":
            return Array(items=self.node(self.need(schema, "items"), namespace), **about)
        if kind == "map":
            return Map(values=self.node(self.need(schema, "values"), namespace), **about)
        if kind in ("record", "error"):
            return self.record(schema, namespace, about)
        if kind in ("enum", "fixed"):
            inside, name = _full(schema, namespace)
            about |= {"name": name, "aliases": self.aliases(schema, inside)}
            if kind == "enum":
                symbols = self.need(schema, "symbols")
                self.check_symbols(symbols, schema)
                made: Named = Enum(symbols=tuple(symbols), default=schema.get("default"), **about)
            else:
                made = Fixed(size=self.need(schema, "size"), **about)
            self.declare(made)
            return made
        if isinstance(kind, str):
            return self.node(kind, namespace)
        raise UnknownType(str(kind))

    @staticmethod
    def need(schema: Mapping, key: str) -> Any:
        if key not in schema:
            raise SchemaParseException(f'"{key}" is a required field missing from the schema: {dict(schema)}')
        return schema[key]

    def declare(self, made: Named) -> None:
        if made.name in self.names:
            raise SchemaParseException(f"redefined named type: {made.name}")
        self.names[made.name] = made

    @staticmethod
    def aliases(schema: Mapping, namespace: str) -> tuple[str, ...]:
        given = schema.get("aliases") or ()
        return tuple(_qualified(a, namespace) for a in ([given] if isinstance(given, str) else given))

    @staticmethod
    def check_symbols(symbols: list, schema: Mapping) -> None:
        for s in symbols:
            if not (isinstance(s, str) and NAME.match(s)):
                raise SchemaParseException("Every symbol must match the regular expression [A-Za-z_][A-Za-z0-9_]*")
        if len(set(symbols)) != len(symbols):
            raise SchemaParseException("All symbols in an enum must be unique")
        if "default" in schema and schema["default"] not in symbols:
            raise SchemaParseException("Default value for enum must be in symbols list")

    @staticmethod
    def logical(schema: Mapping, kind: Any) -> dict:
        name = schema.get("logicalType")
        if name is None:
            return {}
        about: dict = {"logical": name}
        if name == "decimal":
            scale, precision = schema.get("scale", 0), schema.get("precision")
            if not (isinstance(scale, int) and scale >= 0):
                raise SchemaParseException(f"decimal scale must be a non-negative integer, not {scale}")
            if precision is None:
                return {**about, "scale": scale}
            if not (isinstance(precision, int) and precision > 0):
                raise SchemaParseException(f"decimal precision must be a positive integer, not {precision}")
            if kind == "fixed" and precision > math.floor(math.log10(2) * (8 * schema.get("size", 0) - 1)):
                raise SchemaParseException(f"decimal precision of {precision} doesn't fit into array of length {schema.get('size')}")
            if scale > precision:
                raise SchemaParseException(f"decimal scale must be less than or equal to precision, {scale} > {precision}")
            about |= {"scale": scale, "precision": precision}
        return about

    def record(self, schema: Mapping, namespace: str, about: dict) -> Record:
        inside, name = _full(schema, namespace)
        about |= {"name": name, "aliases": self.aliases(schema, inside), "error": schema["type"] == "error"}
        made = Record(**about)
        self.declare(made)  # its fields may name it
        fields = []
        for f in schema.get("fields", ()):
            self.need(f, "name")
            kind = self.node(self.need(f, "type"), inside)
            aliases = f.get("aliases", ())
            if not isinstance(aliases, (list, tuple)):
                raise SchemaParseException(f"aliases must be a list, not {aliases!r}")
            default = f.get("default", MISSING)
            if default is not MISSING and not self.lenient and not fits_default(kind, default):
                raise SchemaParseException(f"Default value <{default}> must match schema type: {json.dumps(_json(kind))}")
            extra = tuple((k, _freeze(v)) for k, v in f.items() if k not in ("name", "type", "default", "aliases"))
            fields.append(Field(f["name"], kind, default, tuple(aliases), extra))
        made = Record(fields=tuple(fields), **about)
        self.names[name] = made
        return made


def fits_default(node: Node, value: Any) -> bool:
    """Whether a JSON default may stand for the type. References are not looked into; any branch of a union will do."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(node, Union):
        return any(fits_default(b, value) for b in node.branches)
    if isinstance(node, Array):
        return isinstance(value, list)
    if isinstance(node, (Map, Record)):
        return isinstance(value, Mapping)
    if isinstance(node, (Enum, Fixed)):
        return isinstance(value, str)
    if isinstance(node, Primitive):
        if node.type in ("float", "double"):
            return isinstance(value, float) or (number and not node.wrapped) or value in ("nan", "NaN", "inf", "-inf", "Infinity", "-Infinity")
        return {"null": value is None, "boolean": isinstance(value, bool), "int": number and isinstance(value, int), "long": number and isinstance(value, int)}.get(node.type, isinstance(value, str))
    return True


def _freeze(x: Any) -> Any:
    return json.dumps(x)


def _json(node: Node) -> Any:
    if isinstance(node, Ref):
        return node.name
    if isinstance(node, Union):
        return [_json(b) for b in node.branches]
    about = {k: json.loads(v) for k, v in node.extra}
    if node.logical is not None:
        about["logicalType"] = node.logical
        if node.logical == "decimal":
            about |= {"scale": node.scale} | ({"precision": node.precision} if node.precision is not None else {})
    if isinstance(node, Primitive):
        return {"type": node.type, **about} if about or node.wrapped else node.type
    if isinstance(node, Array):
        return {"type": "array", "items": _json(node.items), **about}
    if isinstance(node, Map):
        return {"type": "map", "values": _json(node.values), **about}
    assert isinstance(node, Named)
    about = {"name": node.name, **({"aliases": list(node.aliases)} if node.aliases else {}), **about}
    if isinstance(node, Fixed):
        return {"type": "fixed", **about, "size": node.size}
    if isinstance(node, Enum):
        return {"type": "enum", **about, "symbols": list(node.symbols)}
    assert isinstance(node, Record)
    fields = []
    for f in node.fields:
        one = {"name": f.name, "type": _json(f.type)}
        if f.default is not MISSING:
            one["default"] = f.default
        if f.aliases:
            one["aliases"] = list(f.aliases)
        fields.append(one | {k: json.loads(v) for k, v in f.extra})
    return {"type": "error" if node.error else "record", **about, "fields": fields}


def branch_name(schema: AvroSchema, node: Node) -> str:
    """How a branch of a union is told from the others: its full name or its type."""
    if isinstance(node, (Ref, Named)):
        return node.name
    if isinstance(node, Primitive):
        return node.type
    return "array" if isinstance(node, Array) else "map"


def is_null(node: Node) -> bool:
    return isinstance(node, Primitive) and node.type == "null"


def optional(node: Node) -> tuple[int, Node] | None:
    """(index of null, the other branch) of a union of null and one more."""
    if isinstance(node, Union) and len(node.branches) == 2 and sum(map(is_null, node.branches)) == 1:
        at = 0 if is_null(node.branches[0]) else 1
        return at, node.branches[1 - at]
    return None
