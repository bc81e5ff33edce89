"""Schemas from files: one type a file, found by full name, and expansion of references."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any, Protocol

from .model import AvroSchema, Named, Node, Ref, UnknownType, _json, _qualified, parse_schema


class SchemaRepositoryError(Exception):
    """A repository has no readable schema of that name."""


class Repository(Protocol):
    def load(self, name: str) -> Any:
        """The JSON of the schema with this full name."""


class FlatDirectory:
    """``<full name>.avsc`` files in one folder."""

    def __init__(self, path: str, extension: str = "avsc"):
        self.path, self.extension = Path(path), extension

    def load(self, name: str) -> Any:
        try:
            return json.loads((self.path / f"{name}.{self.extension}").read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise SchemaRepositoryError(f"Failed to load '{name}' schema: {e}") from e


def _mentioned(schema: Any, namespace: str, own: set[str]) -> list[str]:
    """Full names that a schema uses, in order; what it declares goes to ``own``."""
    from .model import PRIMITIVES, _full

    if isinstance(schema, str):
        return [] if schema in PRIMITIVES else [_qualified(schema, namespace)]
    if isinstance(schema, list):
        return [n for s in schema for n in _mentioned(s, namespace, own)]
    kind = schema.get("type")
    if kind in ("record", "error"):
        inside, name = _full(schema, namespace)
        own.add(name)
        return [n for f in schema.get("fields", ()) for n in _mentioned(f["type"], inside, own)]
    if kind in ("enum", "fixed"):
        own.add(_full(schema, namespace)[1])
        return []
    if kind == "array":
        return _mentioned(schema["items"], namespace, own)
    if kind == "map":
        return _mentioned(schema["values"], namespace, own)
    return _mentioned(kind, namespace, own) if isinstance(kind, (dict, list)) or kind not in PRIMITIVES else []


def load_schema(path: str, *, repository: Repository | None = None, names: dict[str, Named] | None = None) -> AvroSchema:
    """The schema in a file (or of a name in ``repository``) with all types that it needs, each loaded once, before its use."""
    known = names if names is not None else {}
    if repository is None:
        repository, name = FlatDirectory(str(Path(path).parent)), Path(path).name.removesuffix(".avsc")
    else:
        name = path
    loading: list[str] = []

    def load(name: str) -> AvroSchema:
        text = repository.load(name)
        loading.append(name)
        own: set[str] = set()
        for n in _mentioned(text, "", own):
            if n not in known and n not in own and n not in loading:
                try:
                    load(n)
                except SchemaRepositoryError as e:
                    raise UnknownType(n) from e
        loading.pop()
        return parse_schema(text, known)

    try:
        return load(name)
    except UnknownType as e:
        raise SchemaRepositoryError(f"Failed to load '{e.name}' schema") from e


def load_schema_ordered(paths: list[str]) -> AvroSchema:
    """The last file's schema; each file may use the types of those before it."""
    if not paths:
        raise ValueError("no schema files are given")
    known: dict[str, Named] = {}
    for p in paths:
        made = parse_schema(json.loads(Path(p).read_text(encoding="utf-8")), known)
    return made


def expand_schema(schema: Any) -> Any:
    """The JSON of a schema with every reference replaced by its type; a type inside itself stays a name."""
    parsed = parse_schema(schema)

    def expand(x: Any, inside: tuple[str, ...]) -> Any:
        if isinstance(x, list):
            return [expand(b, inside) for b in x]
        if isinstance(x, str):
            if x not in parsed.names or x in inside:
                return x
            return expand(_json(parsed.names[x]), inside)
        here = (*inside, x["name"]) if "name" in x else inside
        out = dict(x)
        if x.get("type") in ("record", "error"):
            out["fields"] = [{**f, "type": expand(f["type"], here)} for f in x["fields"]]
        for key in ("items", "values"):
            if key in x:
                out[key] = expand(x[key], here)
        return out

    return expand(parsed.json(), ())


def whole(schema: AvroSchema) -> Any:
    """Self-contained JSON: each type is written out where it is used first."""
    seen: set[str] = set()

    def walk(x: Any) -> Any:
        if isinstance(x, list):
            return [walk(b) for b in x]
        if isinstance(x, str):
            if x in schema.names and x not in seen:
                return walk(_json(schema.names[x]))
            return x
        if "name" in x:
            seen.add(x["name"])
        out = dict(x)
        if x.get("type") in ("record", "error"):
            out["fields"] = [{**f, "type": walk(f["type"])} for f in x["fields"]]
        for key in ("items", "values"):
            if key in x:
                out[key] = walk(x[key])
        return out

    return walk(schema.json())


def node_schema(schema: AvroSchema, node: Node) -> AvroSchema:
    return AvroSchema(schema.get(node) if isinstance(node, Ref) else node, schema.names)
