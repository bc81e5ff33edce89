"""Values of JSON defaults, as typed Python values and as bytes."""

from __future__ import annotations

import datetime as dt
import struct
from decimal import Decimal
from typing import Any

from ..schema.model import Array, AvroSchema, Enum, Fixed, Map, MISSING, Node, Primitive, Record, Union, branch_name, fits_default, is_null, optional
from ..schema.spark_types import is_decimal


def zigzag(n: int) -> bytes:
    z, out = n << 1 if n >= 0 else (-n << 1) - 1, bytearray()
    while z > 127:
        out.append(z & 0x7F | 0x80)
        z >>= 7
    out.append(z)
    return bytes(out)


def pick(schema: AvroSchema, node: Union, value: Any) -> int:
    """The first branch that a default fits."""
    for i, b in enumerate(node.branches):
        if fits_default(schema.get(b), value):
            return i
    raise ValueError(f"default {value!r} fits no branch")


def default_bytes(schema: AvroSchema, node: Node, value: Any) -> bytes:
    """The encoding of a JSON default."""
    node = schema.get(node)
    if isinstance(node, Union):
        i = pick(schema, node, value)
        return zigzag(i) + default_bytes(schema, node.branches[i], value)
    if isinstance(node, Record):
        out = b""
        for f in node.fields:
            v = value.get(f.name, f.default)
            if v is MISSING:
                raise ValueError(f"the default lacks {f.name}")
            out += default_bytes(schema, f.type, v)
        return out
    if isinstance(node, Array):
        return (zigzag(len(value)) + b"".join(default_bytes(schema, node.items, x) for x in value) if value else b"") + b"\0"
    if isinstance(node, Map):
        return (zigzag(len(value)) + b"".join(zigzag(len(k.encode())) + k.encode() + default_bytes(schema, node.values, x) for k, x in value.items()) if value else b"") + b"\0"
    if isinstance(node, Enum):
        return zigzag(node.symbols.index(value))
    if isinstance(node, Fixed):
        return value.encode("latin-1")
    assert isinstance(node, Primitive)
    if node.type == "null":
        return b""
    if node.type == "boolean":
        return bytes([bool(value)])
    if node.type in ("int", "long"):
        return zigzag(int(value))
    if node.type in ("float", "double"):
        return struct.pack("<f" if node.type == "float" else "<d", float(value))
    raw = value.encode("latin-1" if node.type == "bytes" else "utf-8")
    return zigzag(len(raw)) + raw


def default_value(schema: AvroSchema, node: Node, value: Any) -> Any:
    """A JSON default as the Python value of the node's Spark type."""
    node = schema.get(node)
    if isinstance(node, Union):
        i = pick(schema, node, value)
        inner = default_value(schema, node.branches[i], value)
        if optional(node) is not None or len(node.branches) == 1:
            return inner
        return {"tag": branch_name(schema, node.branches[i]), **{f"member{k}": inner if k == i and not is_null(b) else None for k, b in enumerate(node.branches)}}
    if isinstance(node, Record):
        return {f.name: default_value(schema, f.type, value.get(f.name, f.default)) for f in node.fields}
    if isinstance(node, Array):
        return [default_value(schema, node.items, x) for x in value]
    if isinstance(node, Map):
        return {k: default_value(schema, node.values, x) for k, x in value.items()}
    if isinstance(node, Enum) or value is None:
        return value
    if is_decimal(node):
        return Decimal(int.from_bytes(value.encode("latin-1"), "big", signed=True)).scaleb(-node.scale)
    if isinstance(node, Fixed):
        return value.encode("latin-1")
    assert isinstance(node, Primitive)
    if node.type == "bytes":
        return value.encode("latin-1")
    if node.type in ("float", "double"):
        return float(value)
    if node.logical == "date":
        return dt.date(1970, 1, 1) + dt.timedelta(days=value)
    if node.logical in ("timestamp-millis", "timestamp-micros", "local-timestamp-millis", "local-timestamp-micros"):
        zone = None if node.logical.startswith("local") else dt.timezone.utc
        return dt.datetime(1970, 1, 1, tzinfo=zone) + dt.timedelta(microseconds=value * (1000 if node.logical.endswith("millis") else 1))
    return value
