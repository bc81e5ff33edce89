"""Avro bytes to Arrow arrays, all lanes together.

A lane is an independent run of bytes with its own cursor: a message, or a block of a file. A plan
walks the schema field by field and moves every lane's cursor at once; lists go item by item over the lanes
that still have one, or in one step if items have one width. Fields that are not wanted are skipped.
"""

from __future__ import annotations

from collections.abc import Collection
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..schema.model import Array, AvroSchema, Enum, Fixed, Map, Node, Primitive, Record, Union, branch_name, is_null, optional
from ..schema.spark_types import DEPTH, arrow_type, is_decimal
from . import runs

PAD = 16
WIDTHS = {"float": np.dtype("<f4"), "double": np.dtype("<f8")}


class Lanes:
    """The bytes of all lanes and where each lane ends."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data = np.concatenate([data, np.zeros(PAD, np.uint8)])
        self.size = data.size
        self.ends = ends

    def long(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A zigzag varint at each cursor, and the cursors behind it."""
        if pos.size and int(pos.max()) >= self.size:
            raise EOFError("the data ends inside a value")
        b = self.data[pos]
        more = b > 127
        pos = pos + 1
        if not more.any():
            small = b.astype(np.int64)
            return (small >> 1) ^ -(small & 1), pos
        z = (b & 0x7F).astype(np.uint64)
        at, shift = np.flatnonzero(more), 7
        while at.size:
            if shift > 63:
                raise ValueError("a varint has more than 10 bytes")
            b = self.data[np.minimum(pos[at], self.size)]
            z[at] |= (b & 0x7F).astype(np.uint64) << np.uint64(shift)
            pos[at] += 1
            at, shift = at[b > 127], shift + 7
        return ((z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))).view(np.int64), pos

    def behind_long(self, pos: np.ndarray) -> np.ndarray:
        """The cursors behind a varint at each cursor."""
        if pos.size and int(pos.max()) >= self.size:
            raise EOFError("the data ends inside a value")
        at, out = np.flatnonzero(self.data[pos] > 127), pos + 1
        for _ in range(9):
            if not at.size:
                return out
            more = self.data[np.minimum(out[at], self.size)] > 127
            out[at] += 1
            at = at[more]
        if at.size:
            raise ValueError("a varint has more than 10 bytes")
        return out

    def runs(self, pos: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """``sizes`` bytes from each cursor, as a binary array."""
        if sizes.size and (int(sizes.min()) < 0 or int((pos + sizes).max()) > self.size):
            raise EOFError("the data ends inside a value")
        at = np.concatenate([[0], np.cumsum(sizes)])
        if at[-1] >= 1 << 31:
            raise ValueError("a batch of values exceeds 2 GB")
        if at[-1] <= runs.STEP:
            data = self.data[np.repeat(pos - at[:-1], sizes) + np.arange(at[-1])]
        else:
            data = np.empty(int(at[-1]), np.uint8)
            runs.copy_runs(self.data, pos, data, None, sizes)
        return pa.Array.from_buffers(pa.binary(), sizes.size, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])

    def numbers(self, pos: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        if pos.size and int(pos.max()) + kind.itemsize > self.size:
            raise EOFError("the data ends inside a value")
        return self.data[pos[:, None] + np.arange(kind.itemsize)].view(kind).ravel(), pos + kind.itemsize


class Decoder:
    """Decodes values of one schema. ``fields`` names the top-level fields that are wanted, all by default."""

    def __init__(self, schema: AvroSchema, fields: Collection[str] | None = None, unicode_errors: str = "strict"):
        self.schema, self.fields, self.errors = schema, None if fields is None else set(fields), unicode_errors
        self.kinds: dict[tuple, pa.DataType] = {}

    def type(self) -> pa.DataType:
        kind = arrow_type(self.schema)
        if self.fields is not None and pa.types.is_struct(kind):
            kind = pa.struct([f for f in kind if f.name in self.fields])
        return kind

    def read(self, lanes: Lanes, pos: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The next value of each lane."""
        root = self.schema.get(self.schema.root)
        if isinstance(root, Record):
            return self.record(lanes, pos, root, {}, self.fields)
        return self.value(lanes, pos, root, {})

    def value(self, lanes: Lanes, pos: np.ndarray, node: Node, depth: dict) -> tuple[pa.Array, np.ndarray]:
        node = self.schema.get(node)
        if isinstance(node, Record):
            return self.record(lanes, pos, node, depth, None)
        if isinstance(node, Union):
            return self.union(lanes, pos, node, depth)
        if isinstance(node, (Array, Map)):
            return self.repeated(lanes, pos, node, depth)
        if isinstance(node, Enum):
            index, pos = lanes.long(pos)
            if index.size and (int(index.min()) < 0 or int(index.max()) >= len(node.symbols)):
                raise ValueError(f"an index is not of a symbol of {node.name}")
            return pa.array(node.symbols, pa.string()).take(pa.array(index)), pos
        if isinstance(node, Fixed):
            got = lanes.runs(pos, np.full(pos.size, node.size, np.int64))
            return (_decimals(got, node) if is_decimal(node) else got), pos + node.size
        assert isinstance(node, Primitive)
        return self.primitive(lanes, pos, node)

    def primitive(self, lanes: Lanes, pos: np.ndarray, node: Primitive) -> tuple[pa.Array, np.ndarray]:
        kind = arrow_type(self.schema, node)
        if node.type == "null":
            return pa.nulls(pos.size), pos
        if node.type == "boolean":
            got, pos = lanes.numbers(pos, np.dtype("u1"))
            return pa.array(got != 0), pos
        if node.type in WIDTHS:
            got, pos = lanes.numbers(pos, WIDTHS[node.type])
            return pa.array(got), pos
        got, pos = lanes.long(pos)
        if node.type in ("bytes", "string"):
            out = lanes.runs(pos, got)
            pos = pos + got
            if is_decimal(node):
                return _decimals(out, node), pos
            return (self.text(out) if node.type == "string" else out), pos
        if pa.types.is_timestamp(kind):
            return pa.array(got * 1000 if node.logical.endswith("millis") else got).cast(kind), pos
        if pa.types.is_date(kind):
            return pa.array(got.astype(np.int32)).cast(kind), pos
        return pa.array(got.astype(np.int32) if node.type == "int" else got), pos

    def text(self, out: pa.Array) -> pa.Array:
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            if self.errors == "strict":
                raise UnicodeDecodeError("utf-8", b"", 0, 1, "a string is not UTF-8") from None
            return pa.array([x.decode("utf-8", self.errors) for x in out.to_pylist()], pa.string())

    def union(self, lanes: Lanes, pos: np.ndarray, node: Union, depth: dict) -> tuple[pa.Array, np.ndarray]:
        index, pos = lanes.long(pos)
        if index.size and (int(index.min()) < 0 or int(index.max()) >= len(node.branches)):
            raise ValueError("an index is not of a branch of the union")
        if len(node.branches) == 1:
            return self.value(lanes, pos, node.branches[0], depth)
        one = optional(node)
        if one is not None and index.size and (index == 1 - one[0]).all():  # nothing is null
            return self.value(lanes, pos, one[1], depth)
        pos = pos.copy()
        wide: list[pa.Array] = []
        for i, b in enumerate(node.branches):
            where = np.flatnonzero(index == i)
            if is_null(b):
                wide.append(pa.nulls(pos.size))
                continue
            got, pos[where] = self.value(lanes, pos[where], b, depth)
            wide.append(got if where.size == pos.size else _widen(got, where, pos.size))
        if one is not None:
            return wide[1 - one[0]], pos
        tags = pa.array([branch_name(self.schema, b) for b in node.branches], pa.string()).take(pa.array(index))
        kind = arrow_type(self.schema, node, depth)
        return pa.StructArray.from_arrays([tags, *(w.cast(f.type) if w.type != f.type else w for w, f in zip(wide, list(kind)[1:], strict=True))], fields=list(kind)), pos

    def repeated(self, lanes: Lanes, pos: np.ndarray, node: Array | Map, depth: dict) -> tuple[pa.Array, np.ndarray]:
        item = node.items if isinstance(node, Array) else node.values
        real = self.schema.get(item)
        width = WIDTHS.get(real.type) if isinstance(real, Primitive) and isinstance(node, Array) else None
        lane, keys, items = [], [], []
        live, pos = np.arange(pos.size), pos.copy()
        while live.size:
            count, pos[live] = lanes.long(pos[live])
            sized = count < 0
            if sized.any():
                _, pos[live[sized]] = lanes.long(pos[live[sized]])
                count = np.abs(count)
            live, count = live[count > 0], count[count > 0]
            if width is not None and live.size:
                if int((pos[live] + count * width.itemsize).max()) > lanes.size:
                    raise EOFError("the data ends inside a value")
                first = np.cumsum(count) - count
                at = np.repeat(pos[live] - first * width.itemsize, count) + np.arange(int(count.sum())) * width.itemsize
                items.append(pa.array(lanes.numbers(at, width)[0]))
                lane.append(np.repeat(live, count))
                pos[live] += count * width.itemsize
                continue
            some, left = live, count
            while some.size:
                at = pos[some]
                if isinstance(node, Map):
                    size, at = lanes.long(at)
                    keys.append(self.text(lanes.runs(at, size)))
                    at = at + size
                got, pos[some] = self.value(lanes, at, item, depth)
                items.append(got)
                lane.append(some)
                left = left - 1
                some, left = some[left > 0], left[left > 0]
        kind = arrow_type(self.schema, node, depth)
        of = np.concatenate(lane) if lane else np.empty(0, np.int64)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=pos.size)
        body = _cat(items, kind.item_type if isinstance(node, Map) else kind.value_type).take(pa.array(order))
        if isinstance(node, Map):
            name = _cat(keys, pa.string()).take(pa.array(order))
            # of equal keys in a map the last one counts
            code = pc.dictionary_encode(name).indices.to_numpy(zero_copy_only=False) if len(name) else np.empty(0, np.int64)
            pair = of[order] * (int(code.max(initial=0)) + 1) + code
            last = np.sort(np.unique(pair[::-1], return_index=True)[1])
            keep = np.sort(pair.size - 1 - last)
            if keep.size < pair.size:
                counts = np.bincount(of[order][keep], minlength=pos.size)
                name, body = name.take(pa.array(keep)), body.take(pa.array(keep))
            return pa.MapArray.from_arrays(_offsets(counts), name, body), pos
        return pa.ListArray.from_arrays(_offsets(counts), body), pos

    def record(self, lanes: Lanes, pos: np.ndarray, node: Record, depth: dict, wanted: set | None) -> tuple[pa.Array, np.ndarray]:
        deeper = {**depth, node.name: depth.get(node.name, 0) + 1}
        if deeper[node.name] > DEPTH:
            if pos.size:
                raise ValueError(f"{node.name} holds itself more than {DEPTH} deep")
            return pa.nulls(0), pos
        values, fields, known = [], [], (node.name, *depth.items())
        kind = self.kinds.get(known)
        if kind is None:
            kind = self.kinds[known] = arrow_type(self.schema, node, depth)
        for f, t in zip(node.fields, kind, strict=True):
            if wanted is not None and f.name not in wanted:
                pos = self.skip(lanes, pos, f.type)
                continue
            got, pos = self.value(lanes, pos, f.type, deeper)
            values.append(got if got.type == t.type else got.cast(t.type))
            fields.append(t)
        if not fields:
            return pa.array([{}] * pos.size, pa.struct([])), pos
        return pa.StructArray.from_arrays(values, fields=fields), pos

    def skip(self, lanes: Lanes, pos: np.ndarray, node: Node) -> np.ndarray:
        """The cursors behind a value; nothing of it is kept."""
        node = self.schema.get(node)
        if not pos.size:
            return pos
        if isinstance(node, Primitive):
            if node.type == "null":
                return pos
            if node.type in ("boolean", "float", "double"):
                return pos + {"boolean": 1, "float": 4, "double": 8}[node.type]
            if node.type in ("bytes", "string"):
                got, pos = lanes.long(pos)
                return pos + got
            return lanes.behind_long(pos)
        if isinstance(node, Fixed):
            return pos + node.size
        if isinstance(node, Enum):
            return lanes.behind_long(pos)
        if isinstance(node, Record):
            for f in node.fields:
                pos = self.skip(lanes, pos, f.type)
            return pos
        pos = pos.copy()
        if isinstance(node, Union):
            index, pos = lanes.long(pos)
            if 0 <= index[0] < len(node.branches) and (index == index[0]).all():
                return self.skip(lanes, pos, node.branches[int(index[0])])
            for i, b in enumerate(node.branches):
                where = np.flatnonzero(index == i)
                pos[where] = self.skip(lanes, pos[where], b)
            return pos
        live = np.arange(pos.size)
        while live.size:
            count, pos[live] = lanes.long(pos[live])
            sized = np.flatnonzero(count < 0)
            if sized.size:  # the size of the block is given: jump
                size, at = lanes.long(pos[live[sized]])
                pos[live[sized]] = at + size
            some, left = live[count > 0], count[count > 0]
            while some.size:
                at = pos[some]
                if isinstance(node, Map):
                    size, at = lanes.long(at)
                    at = at + size
                pos[some] = self.skip(lanes, at, node.items if isinstance(node, Array) else node.values)
                left = left - 1
                some, left = some[left > 0], left[left > 0]
            live = live[count != 0]
        return pos


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _cat(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([p if p.type == kind else p.cast(kind) for p in parts]) if parts else pa.array([], kind)


def _widen(got: pa.Array, where: np.ndarray, n: int) -> pa.Array:
    index = np.full(n, -1, np.int64)
    index[where] = np.arange(where.size)
    return got.take(pa.array(index, mask=index < 0)) if len(got) else pa.nulls(n, got.type)


def _decimals(raw: pa.Array, node: Any) -> pa.Array:
    """Big-endian two's complement bytes as decimals."""
    at = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1)
    size = np.diff(at)
    if size.size and int(size.max()) > 16:
        from decimal import Decimal

        return pa.array([Decimal(int.from_bytes(x, "big", signed=True)).scaleb(-node.scale) for x in raw.to_pylist()], pa.decimal128(node.precision, node.scale))
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
    out = np.zeros((size.size, 16), np.uint8)
    if data.size:
        first = data[np.minimum(at[:-1], data.size - 1)]
        out[(first > 127) & (size > 0)] = 255
    row = np.repeat(np.arange(size.size), size)
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    out[row, np.repeat(size, size) - 1 - place] = data[: at[-1]]
    made = pa.Array.from_buffers(pa.decimal128(38, node.scale), size.size, [None, pa.py_buffer(np.ascontiguousarray(out))])
    return made.cast(pa.decimal128(node.precision, node.scale))


def messages(column: pa.Array, decoder: Decoder) -> pa.Array:
    """One value from each message of a binary column; null where the message is null."""
    kind = decoder.type()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = column.drop_null() if column.null_count else column
    big = there.cast(pa.large_binary())
    n = len(there)
    at = np.frombuffer(big.buffers()[1], np.int64, n + 1, big.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(big.buffers()[2], np.uint8)[at[0] : at[-1]] if n and at[-1] > at[0] else np.empty(0, np.uint8)
    if n and (np.diff(at) == 0).any() and not _may_be_empty(decoder.schema):
        raise EOFError("a message is empty")
    parts, i = [], 0
    while i < n or not parts:
        j = min(max(int(np.searchsorted(at, at[i] + runs.PIECE, side="right")) - 1, i + 1), n)
        lanes = Lanes(data[at[i] - at[0] : at[j] - at[0]], at[i + 1 : j + 1] - at[i])
        some, pos = decoder.read(lanes, at[i:j] - at[i])
        if (pos > lanes.ends).any():
            raise EOFError("a message ends inside a value")
        parts.append(some if some.type == kind else some.cast(kind))
        i = j
    got = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
    return got if n == len(column) else _widen(got, np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)), len(column))


def _may_be_empty(schema: AvroSchema, node: Node | None = None) -> bool:
    node = schema.get(schema.root if node is None else node)
    return is_null(node) or isinstance(node, Fixed) and node.size == 0 or isinstance(node, Record) and all(_may_be_empty(schema, f.type) for f in node.fields)
