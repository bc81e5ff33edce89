"""Parsing canonical form and fingerprints."""

from __future__ import annotations

import hashlib
from typing import Any

from .model import Array, Enum, Fixed, Map, Node, Primitive, Record, Ref, Union, parse_schema

# The names of fingerprint algorithms, of which these two are those of another naming.
RABIN = "CRC-64-AVRO"
OTHER_NAMES = {"SHA-256": "sha256", "MD5": "md5"}
FINGERPRINTS = frozenset({RABIN, *OTHER_NAMES, *(n for n in hashlib.algorithms_guaranteed if not n.startswith("shake"))})
EMPTY = 0xC15D213AA4D7A795


def canonical_form(schema: Any) -> str:
    """The parsing canonical form: full names, only what matters to readers, no white space, no escapes."""
    return _form(parse_schema(schema).root)


def _form(node: Node) -> str:
    if isinstance(node, Ref):
        return f'"{node.name}"'
    if isinstance(node, Union):
        return f"[{','.join(map(_form, node.branches))}]"
    if isinstance(node, Primitive):
        return f'"{node.type}"'
    if isinstance(node, Array):
        return f'{{"type":"array","items":{_form(node.items)}}}'
    if isinstance(node, Map):
        return f'{{"type":"map","values":{_form(node.values)}}}'
    if isinstance(node, Fixed):
        return f'{{"name":"{node.name}","type":"fixed","size":{node.size}}}'
    if isinstance(node, Enum):
        symbols = ",".join(f'"{s}"' for s in node.symbols)
        return f'{{"name":"{node.name}","type":"enum","symbols":[{symbols}]}}'
    assert isinstance(node, Record)
    fields = ",".join(f'{{"name":"{f.name}","type":{_form(f.type)}}}' for f in node.fields)
    return f'{{"name":"{node.name}","type":"record","fields":[{fields}]}}'


def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (EMPTY if i & 1 else 0)
        out.append(i)
    return out


_TABLE = _table()


def rabin(data: bytes) -> str:
    """CRC-64-AVRO, as little-endian hex."""
    x = EMPTY
    for b in data:
        x = x >> 8 ^ _TABLE[(x ^ b) & 0xFF]
    return x.to_bytes(8, "little").hex()


def fingerprint(form: str, algorithm: str) -> str:
    if algorithm not in FINGERPRINTS:
        raise ValueError(f"no fingerprint is called {algorithm}; there are {', '.join(sorted(FINGERPRINTS))}")
    if algorithm == RABIN:
        return rabin(form.encode())
    return hashlib.new(OTHER_NAMES.get(algorithm, algorithm), form.encode()).hexdigest()


