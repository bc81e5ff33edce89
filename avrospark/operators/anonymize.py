"""Schemas and data without names that tell anything: md5 of names, symbols and docs."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema.model import MISSING, Array, AvroSchema, Enum, Fixed, Map, Named, Node, Primitive, Record, Ref, Union, optional, parse_schema


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def _named(name: str) -> str:
    return f"A_{_md5(name)}"


def anonymize_schema(schema: Any) -> Any:
    """The schema's JSON with hashed names; logical types, namespaces and aliases of types go, defaults stay."""
    return _hide(parse_schema(schema), parse_schema(schema).root)


def _hide(schema: AvroSchema, node: Node) -> Any:
    if isinstance(node, Ref):
        return _named(node.name)
    if isinstance(node, Union):
        return [_hide(schema, b) for b in node.branches]
    if isinstance(node, Primitive):
        return node.type
    doc = {"doc": _md5(json.loads(dict(node.extra)["doc"]))} if "doc" in dict(node.extra) else {}
    if isinstance(node, Array):
        return {"type": "array", "items": _hide(schema, node.items), **doc}
    if isinstance(node, Map):
        return {"type": "map", "values": _hide(schema, node.values), **doc}
    assert isinstance(node, Named)
    base = {"name": _named(node.name), **doc}
    if isinstance(node, Fixed):
        return {"type": "fixed", **base, "size": node.size}
    if isinstance(node, Enum):
        return {"type": "enum", **base, "symbols": [_named(s) for s in node.symbols]}
    assert isinstance(node, Record)
    fields = []
    for f in node.fields:
        about = dict(f.extra)
        one = {"name": _md5(f.name), "type": _hide(schema, f.type)}
        if f.default is not MISSING:
            one["default"] = f.default
        if f.aliases:
            one["aliases"] = [_md5(a) for a in f.aliases]
        if "doc" in about:
            one["doc"] = _md5(json.loads(about["doc"]))
        fields.append(one)
    return {"type": "error" if node.error else "record", **base, "fields": fields}


def _rename(schema: AvroSchema, c: Column, node: Node) -> Column:
    node = schema.get(node)
    if isinstance(node, Union) and (one := optional(node)) is not None:
        return F.when(c.isNotNull(), _rename(schema, c, one[1]))
    if isinstance(node, Record):
        return F.when(c.isNotNull(), F.struct(*(_rename(schema, c.getField(f.name), f.type).alias(_md5(f.name)) for f in node.fields)))
    if isinstance(node, Array):
        return F.transform(c, lambda x: _rename(schema, x, node.items))
    if isinstance(node, Map):
        return F.transform_values(c, lambda _, x: _rename(schema, x, node.values))
    if isinstance(node, Enum):
        return F.when(c.isNotNull(), F.concat(F.lit("A_"), F.md5(c.cast("binary"))))
    return c


def anonymize(df: DataFrame, schema: Any) -> DataFrame:
    """The data of a record schema under its anonymised names. Values stay, but for enum symbols."""
    parsed = parse_schema(schema)
    root = parsed.get(parsed.root)
    assert isinstance(root, Record)
    return df.select(*(_rename(parsed, F.col(f.name), f.type).alias(_md5(f.name)) for f in root.fields))
