"""Object container files: headers, blocks and their cut."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa

from ..schema.load import whole
from ..schema.model import AvroSchema, parse_schema
from .codecs import CODECS, compress
from .decode import Decoder, Lanes
from .encode import Rows
from .literal import zigzag

# Fixed values of the format.
MAGIC = b"Obj\x01"
SYNC_SIZE = 16
SYNC_INTERVAL = 16000
#: Bytes in which a sync marker is looked for at once.
SEARCHED = 1 << 16
#: Bytes of decompressed blocks that are decoded at once: enough lanes for the work of a step, and few bytes for its arrays.
DECODED = 8 << 20


def open_file(path: str) -> BinaryIO:
    """A file of any file system that Arrow knows, for random reading."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from ..sources import places

    system, inner = places.at(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


def _long(f: BinaryIO) -> int | None:
    """A varint, or None at the clean end of the file."""
    z = shift = 0
    while True:
        b = f.read(1)
        if not b:
            if shift:
                raise EOFError("the file ends inside a value")
            return None
        z |= (b[0] & 0x7F) << shift
        if b[0] < 128:
            return z >> 1 ^ -(z & 1)
        shift += 7


def _bytes(f: BinaryIO) -> bytes:
    n = _long(f)
    raw = f.read(n) if n is not None else b""
    if n is None or len(raw) < n:
        raise EOFError("the file ends inside a value")
    return raw


@dataclass
class Header:
    metadata: dict[str, bytes]
    sync: bytes
    end: int

    @property
    def codec(self) -> str:
        return self.metadata.get("avro.codec", b"null").decode()

    def schema(self, lenient: bool = False) -> AvroSchema:
        return parse_schema(json.loads(self.metadata["avro.schema"]), ignore_default_errors=lenient)


def read_header(f: BinaryIO) -> Header:
    if f.read(4) != MAGIC:
        raise ValueError("no container file: its first bytes or its header do not fit")
    found: dict[str, bytes] = {}
    while n := _long(f):
        if n < 0:
            _long(f)
        for _ in range(abs(n)):
            key = _bytes(f).decode()
            found[key] = _bytes(f)
    sync = f.read(SYNC_SIZE)
    if len(sync) < SYNC_SIZE or "avro.schema" not in found:
        raise ValueError("no container file: its first bytes or its header do not fit")
    return Header(found, sync, f.tell())


def header_bytes(schema: AvroSchema, codec: str, sync: bytes, metadata: dict[str, bytes] | None = None) -> bytes:
    if codec not in CODECS:
        raise ValueError(f"no codec is called {codec}")
    found = {**{k: v if isinstance(v, bytes) else str(v).encode() for k, v in (metadata or {}).items()}, "avro.codec": codec.encode(), "avro.schema": json.dumps(whole(schema)).encode()}
    body = b"".join(zigzag(len(k.encode())) + k.encode() + zigzag(len(v)) + v for k, v in found.items())
    return MAGIC + zigzag(len(found)) + body + b"\0" + sync


@dataclass
class Block:
    offset: int  # of the block's first byte
    size: int  # of the whole block, its sync marker included
    count: int
    start: int  # of the payload
    length: int  # of the payload


def find_sync(f: BinaryIO, sync: bytes, start: int, end: int) -> int | None:
    """Where the first sync marker that begins in [start, end) ends."""
    at, kept = start, b""
    while at < end:
        f.seek(at)
        raw = f.read(min(SEARCHED, end + SYNC_SIZE - 1 - at))
        if not raw:
            return None
        place = (kept + raw).find(sync)
        if place >= 0:
            return at - len(kept) + place + SYNC_SIZE
        at, kept = at + len(raw), (kept + raw)[1 - SYNC_SIZE :]
    return None


def first_block(f: BinaryIO, header: Header, start: int, end: int) -> int | None:
    """Where the first block of a byte range begins: a block belongs to the range in which the marker before it begins."""
    mark = header.end - SYNC_SIZE
    if start <= mark:
        return header.end if mark < end else None
    return find_sync(f, header.sync, start, end)


def blocks(f: BinaryIO, header: Header, start: int = 0, end: int = 1 << 62) -> Iterator[tuple[Block, bytes]]:
    """The blocks of a byte range of a file and their payloads, still compressed; their sync markers are checked."""
    at = first_block(f, header, start, end)
    while at is not None and at - SYNC_SIZE < end:
        f.seek(at)
        count = _long(f)
        if count is None:
            return
        length = _long(f)
        if length is None:
            raise EOFError("the file ends inside a block")
        begins = f.tell()
        raw = f.read(length + SYNC_SIZE)
        if len(raw) < length + SYNC_SIZE:
            raise EOFError("the file ends inside a block")
        if raw[length:] != header.sync:
            raise ValueError("a block does not end in the sync marker of its file")
        yield Block(at, begins + length + SYNC_SIZE - at, count, begins, length), raw[:length]
        at = begins + length + SYNC_SIZE


def decode_some(found: Iterable[tuple[int, bytes]], decoder: Decoder) -> Iterator[pa.Array]:
    """The records of (records, decompressed payload), in order, decoded whenever there are ``DECODED`` bytes."""
    payloads, counts, size = [], [], 0
    for count, payload in found:
        if payloads and size + len(payload) > DECODED:
            yield from decode_blocks(payloads, counts, decoder)
            payloads, counts, size = [], [], 0
        payloads.append(payload)
        counts.append(count)
        size += len(payload)
    yield from decode_blocks(payloads, counts, decoder)


def decode_blocks(payloads: list[bytes], counts: list[int], decoder: Decoder, most: int = 1 << 20) -> Iterator[pa.Array]:
    """The records of decompressed payloads, in order; lanes are payloads."""
    kind, at = decoder.type(), 0
    while at < len(payloads):
        n, rows = 1, counts[at]
        while at + n < len(payloads) and rows + counts[at + n] <= most:
            rows += counts[at + n]
            n += 1
        some, count = payloads[at : at + n], np.array(counts[at : at + n], np.int64)
        sizes = np.fromiter(map(len, some), np.int64, n)
        ends = np.cumsum(sizes)
        lanes = Lanes(np.frombuffer(b"".join(some), np.uint8), ends)
        pos, live, turn = ends - sizes, np.flatnonzero(count), 0
        parts, lane = [], []
        while live.size:
            got, pos[live] = decoder.read(lanes, pos[live])
            parts.append(got if got.type == kind else got.cast(kind))
            lane.append(live)
            turn += 1
            live = live[count[live] > turn]
        if (pos > ends).any():
            raise EOFError("a block ends inside a value")
        if parts:
            whole_, parts = pa.concat_arrays(parts), []
            if n > 1:
                whole_ = whole_.take(pa.array(np.argsort(np.concatenate(lane), kind="stable")))
            yield whole_
        at += n


def cut(rows: Rows, interval: int = SYNC_INTERVAL) -> Iterator[tuple[int, bytes]]:
    """(records, payload) of blocks: a block closes with the record that brings it to ``interval`` bytes."""
    ends, i, base = rows.ends(), 0, 0
    while i < ends.size:
        j = min(int(np.searchsorted(ends, base + max(interval, 1), side="left")) + 1, ends.size)
        yield j - i, rows.data[base : int(ends[j - 1])].tobytes()
        i, base = j, int(ends[j - 1])


def block_bytes(count: int, payload: bytes, codec: str, sync: bytes, level: int | None = None) -> bytes:
    data = compress(codec, payload, level)
    return zigzag(count) + zigzag(len(data)) + data + sync


def new_sync() -> bytes:
    return os.urandom(SYNC_SIZE)


def is_avro_bytes(first: Any) -> bool:
    return bytes(first[:4]) == MAGIC
