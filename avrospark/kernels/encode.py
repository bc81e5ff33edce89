"""Arrow arrays to Avro bytes, column by column.

A column becomes the lengths of its rows' bytes and those bytes behind one another; the columns of
a record are then woven together with one scatter each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..schema.model import Array, AvroSchema, Enum, Fixed, Map, Node, Primitive, Record, Union, branch_name, is_null, optional
from ..schema.spark_types import arrow_type, is_decimal
from .runs import copy_runs, pieces


@dataclass
class Rows:
    """Bytes of rows: how many each has, and all of them."""

    sizes: np.ndarray
    data: np.ndarray

    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)

    def binary(self) -> pa.Array:
        at = np.concatenate([[0], self.ends()])
        if at[-1] >= 1 << 31:
            raise ValueError("a batch of encoded rows exceeds 2 GB")
        return pa.Array.from_buffers(pa.binary(), self.sizes.size, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.data))])


def varint(values: np.ndarray) -> Rows:
    """Zigzag varints of int64 values."""
    v = values.astype(np.int64, copy=False)
    z = ((v << 1) ^ (v >> 63)).view(np.uint64)
    sizes = np.ones(z.size, np.int64)
    for k in range(1, 10):
        more = z >> np.uint64(7 * k) != 0
        if not more.any():
            break
        sizes += more
    width = int(sizes.max(initial=1))
    out = np.empty((z.size, width), np.uint8)
    for k in range(width):
        out[:, k] = (z >> np.uint64(7 * k)) & np.uint64(0x7F) | np.where(sizes > k + 1, 0x80, 0).astype(np.uint64)
    return Rows(sizes, out[np.arange(width) < sizes[:, None]])


def fixed_width(values: np.ndarray) -> Rows:
    width = values.dtype.itemsize
    return Rows(np.full(values.size, width, np.int64), values.astype(values.dtype.newbyteorder("<"), copy=False).view(np.uint8).ravel())


def weave(parts: list[Rows], n: int) -> Rows:
    """Row-wise concatenation."""
    if len(parts) == 1:
        return parts[0]
    sizes = sum((p.sizes for p in parts), np.zeros(n, np.int64))
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for p in parts:
        if p.data.size:
            if p.data.size == n and p.sizes.max() == 1:
                out[at] = p.data
            else:
                copy_runs(p.data, None, out, at, p.sizes)
        at = at + p.sizes
    return Rows(sizes, out)


def spread(rows: Rows, where: np.ndarray, n: int) -> Rows:
    """``rows`` for the rows of ``n`` that ``where`` names; the others are empty."""
    sizes = np.zeros(n, np.int64)
    sizes[where] = rows.sizes
    return Rows(sizes, rows.data)


def grouped(items: Rows, counts: np.ndarray) -> Rows:
    """Items gathered into rows of ``counts`` items each."""
    ends = np.concatenate([[0], items.ends()])
    stop = np.cumsum(counts)
    return Rows(ends[stop] - ends[stop - counts], items.data)


def raw(arr: pa.Array) -> Rows:
    """The bytes of a binary or string array without nulls."""
    big = arr.cast(pa.large_binary())
    at = np.frombuffer(big.buffers()[1], np.int64, len(big) + 1, big.offset * 8) if len(big) else np.zeros(1, np.int64)
    data = np.frombuffer(big.buffers()[2], np.uint8)[at[0] : at[-1]] if big.buffers()[2] is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return Rows(np.diff(at), data)


def counted(rows: Rows) -> Rows:
    return weave([varint(rows.sizes), rows], rows.sizes.size)


def _numbers(arr: pa.Array, kind: pa.DataType) -> np.ndarray:
    return pc.cast(arr, kind).to_numpy(zero_copy_only=False)


class Encoder:
    """Encodes arrays of one schema's values. ``strict`` rejects fields that a record doesn't have and fields it lacks;
    ``strict_allow_default`` lets defaults stand for what is lacking."""

    def __init__(self, schema: AvroSchema, strict: bool = False, strict_allow_default: bool = False):
        self.schema, self.strict, self.allow = schema, strict, strict_allow_default

    def messages(self, arr: pa.Array | pa.ChunkedArray) -> pa.Array:
        """The bytes of each value, encoded piece by piece."""
        arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
        made = [self.rows(piece).binary() for piece in pieces(arr)]
        return made[0] if len(made) == 1 else pa.concat_arrays(made)

    def rows(self, arr: pa.Array | pa.ChunkedArray, node: Node | None = None, at: str = "") -> Rows:
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        node = self.schema.get(self.schema.root if node is None else node)
        n = len(arr)
        if not n:
            return Rows(np.zeros(0, np.int64), np.empty(0, np.uint8))
        if isinstance(node, Union):
            return self.union(arr, node, at)
        if isinstance(node, Primitive) and node.type == "null":
            if arr.null_count != n and not pa.types.is_null(arr.type):
                raise ValueError(f"a value for null{_on(at)}")
            return Rows(np.zeros(n, np.int64), np.empty(0, np.uint8))
        if arr.null_count:
            raise ValueError(f"null for {branch_name(self.schema, node)}{_on(at)}")
        if is_decimal(node):
            return self.decimal(arr, node, at)
        if isinstance(node, Primitive):
            return self.primitive(arr, node, at)
        if isinstance(node, Fixed):
            rows = raw(arr)
            if (rows.sizes != node.size).any():
                raise ValueError(f"fixed {node.name} takes {node.size} bytes{_on(at)}")
            return rows
        if isinstance(node, Enum):
            index = pc.index_in(arr.cast(pa.string()), pa.array(node.symbols, pa.string()))
            if index.null_count:
                raise ValueError(f"not a symbol of {node.name}{_on(at)}")
            return varint(index.to_numpy(zero_copy_only=False).astype(np.int64))
        if isinstance(node, (Array, Map)):
            return self.repeated(arr, node, at)
        assert isinstance(node, Record)
        return self.record(arr, node, at)

    def primitive(self, arr: pa.Array, node: Primitive, at: str) -> Rows:
        if node.type == "boolean":
            return fixed_width(arr.to_numpy(zero_copy_only=False).astype(np.uint8))
        if node.type in ("float", "double"):
            return fixed_width(_numbers(arr, pa.float32() if node.type == "float" else pa.float64()))
        if node.type in ("bytes", "string"):
            if node.logical == "uuid":
                arr = pc.utf8_lower(arr.cast(pa.string()))
            return counted(raw(arr))
        if pa.types.is_timestamp(arr.type):
            micros = _numbers(arr.cast(pa.timestamp("us", arr.type.tz)), pa.int64())
            return varint(micros // 1000 if node.logical and node.logical.endswith("millis") else micros)
        if pa.types.is_time(arr.type):
            micros = _numbers(arr.cast(pa.time64("us")), pa.int64())
            return varint(micros // 1000 if node.logical == "time-millis" else micros)
        if pa.types.is_date(arr.type):
            return varint(_numbers(_cast32(arr), pa.int32()))
        return varint(_numbers(arr, pa.int32() if node.type == "int" else pa.int64()))

    def decimal(self, arr: pa.Array, node: Primitive | Fixed, at: str) -> Rows:
        exact = arr.cast(pa.decimal128(38, node.scale))
        limit = 10**node.precision
        two = np.frombuffer(exact.buffers()[1], "<u8", 2 * len(exact), exact.offset * 16).reshape(-1, 2) if len(exact) else np.empty((0, 2), np.uint64)
        low, high = two[:, 0].astype(np.int64), two[:, 1].astype(np.int64)
        if (high == low >> 63).all() and limit < 1 << 63:
            if (np.abs(low) >= limit).any():
                raise ValueError(f"a decimal exceeds precision {node.precision}{_on(at)}")
            big = low.astype(">i8").view(np.uint8).reshape(-1, 8)
            size = np.abs(low)
            bits = np.zeros(low.size, np.int64)
            for k in range(63):
                bits += size >> k != 0
            need = (bits + 8) // 8
            if isinstance(node, Fixed):
                if node.size >= 8:
                    out = np.empty((low.size, node.size), np.uint8)
                    out[:, node.size - 8 :] = big
                    out[:, : node.size - 8] = np.where(low < 0, 255, 0)[:, None]
                else:
                    out = big[:, 8 - node.size :]
                    if (need > node.size).any():
                        raise ValueError(f"a decimal doesn't fit {node.size} bytes{_on(at)}")
                return Rows(np.full(low.size, node.size, np.int64), out.ravel())
            return counted(Rows(need, big[np.arange(8) >= 8 - need[:, None]]))
        out = []
        for x in exact.to_pylist():
            v = int(x.scaleb(node.scale))
            if abs(v) >= limit:
                raise ValueError(f"a decimal exceeds precision {node.precision}{_on(at)}")
            out.append(v.to_bytes(node.size if isinstance(node, Fixed) else (abs(v).bit_length() + 8) // 8, "big", signed=True))
        rows = raw(pa.array(out, pa.binary()))
        return rows if isinstance(node, Fixed) else counted(rows)

    def union(self, arr: pa.Array, node: Union, at: str) -> Rows:
        n = len(arr)
        if (one := optional(node)) is not None:
            null_at, other = one
            if not arr.null_count:
                return weave([varint(np.full(n, 1 - null_at)), self.rows(arr, other, at)], n)
            there = arr.is_valid().to_numpy(zero_copy_only=False)
            body = self.rows(arr.drop_null(), other, at)
            return weave([varint(np.where(there, 1 - null_at, null_at)), spread(body, np.flatnonzero(there), n)], n)
        if len(node.branches) == 1:
            return weave([varint(np.zeros(n, np.int64)), self.rows(arr, node.branches[0], at)], n)
        if not (pa.types.is_struct(arr.type) and arr.type.get_field_index("tag") >= 0):
            return self.guessed(arr, node, at)
        names = [branch_name(self.schema, b) for b in node.branches]
        tags = pc.fill_null(pc.struct_field(arr, "tag"), "null")
        index = pc.index_in(tags, pa.array(names, pa.string()))
        if index.null_count:
            raise ValueError(f"no branch of the union has the tag{_on(at)}")
        index = index.to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [varint(index)]
        for i, b in enumerate(node.branches):
            where = np.flatnonzero(index == i)
            if where.size and not is_null(b):
                member = pc.struct_field(arr, f"member{i}").take(pa.array(where))
                parts.append(spread(self.rows(member, b, at), where, n))
        return weave(parts, n)

    def guessed(self, arr: pa.Array, node: Union, at: str) -> Rows:
        """A plain column for a union of several types: the first branch of its type takes its values, null the nulls."""
        n, there = len(arr), arr.is_valid().to_numpy(zero_copy_only=False)
        null_at = next((i for i, b in enumerate(node.branches) if is_null(b)), None)
        if arr.null_count and null_at is None:
            raise ValueError(f"null for a union without null{_on(at)}")
        for i, b in sorted(enumerate(node.branches), key=lambda x: arrow_type(self.schema, x[1]) != arr.type):
            if is_null(b):
                continue
            try:
                body = self.rows(arr.drop_null(), b, at)
            except (ValueError, pa.ArrowException):
                continue
            return weave([varint(np.where(there, i, null_at or 0)), spread(body, np.flatnonzero(there), n)], n)
        raise ValueError(f"no branch of the union takes {arr.type}{_on(at)}")

    def repeated(self, arr: pa.Array, node: Array | Map, at: str) -> Rows:
        n = len(arr)
        if pa.types.is_map(arr.type):
            offsets = np.frombuffer(arr.buffers()[1], np.int32, n + 1, arr.offset * 4) if n else np.zeros(1, np.int32)
            keys, items = arr.keys, arr.items
            if len(keys) != offsets[-1] - offsets[0]:
                keys, items = keys[offsets[0] : offsets[-1]], items[offsets[0] : offsets[-1]]
            counts = np.diff(offsets).astype(np.int64)
            body = weave([counted(raw(keys.cast(pa.string()))), self.rows(items, node.values, at)], len(keys))
        else:
            counts = pc.list_value_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)
            body = self.rows(arr.flatten(), node.items if isinstance(node, Array) else node.values, at)
        some = np.flatnonzero(counts)
        end = fixed_width(np.zeros(n, np.uint8))
        if not some.size:
            return end
        return weave([spread(varint(counts[some]), some, n), grouped(body, counts), end], n)

    def record(self, arr: pa.Array, node: Record, at: str) -> Rows:
        n = len(arr)
        if not pa.types.is_struct(arr.type):
            raise ValueError(f"{arr.type} for record {node.name}{_on(at)}")
        have = {arr.type.field(i).name: i for i in range(arr.type.num_fields)}
        extra = have.keys() - {f.name for f in node.fields}
        if extra and (self.strict or self.allow):
            raise ValueError(f"record {node.name} has no field {', '.join(sorted(extra))}{_on(at)}")
        parts = []
        for f in node.fields:
            where = f"{at}.{f.name}" if at else f.name
            if f.name in have:
                parts.append(self.rows(pc.struct_field(arr, [have[f.name]]), f.type, where))
                continue
            from ..schema.model import MISSING

            if self.strict or (self.allow and f.default is MISSING):
                raise ValueError(f"record {node.name} lacks field {f.name}{_on(at)}")
            if f.default is not MISSING:
                from .literal import default_bytes

                one = np.frombuffer(default_bytes(self.schema, f.type, f.default), np.uint8)
            else:
                null = _null_bytes(self.schema, f.type)
                if null is None:
                    raise ValueError(f"no value and no default for {where}")
                one = np.frombuffer(null, np.uint8)
            parts.append(Rows(np.full(n, one.size, np.int64), np.tile(one, n)))
        return weave(parts, n) if parts else Rows(np.zeros(n, np.int64), np.empty(0, np.uint8))


def _null_bytes(schema: AvroSchema, node: Node) -> bytes | None:
    node = schema.get(node)
    if is_null(node):
        return b""
    if isinstance(node, Union):
        return next((bytes([2 * i]) for i, b in enumerate(node.branches) if is_null(b)), None)
    return None


def _cast32(arr: pa.Array) -> pa.Array:
    return arr.cast(pa.date32()).cast(pa.int32())


def _on(at: str) -> str:
    return f" on field {at}" if at else ""
