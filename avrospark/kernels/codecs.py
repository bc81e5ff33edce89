"""Block codecs."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

import pyarrow as pa


def _deflate(data: bytes, level: int | None) -> bytes:
    c = zlib.compressobj(-1 if level is None else level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def _inflate(data: bytes) -> bytes:
    return zlib.decompressobj(-15).decompress(data)  # what follows the stream is let be


def _snappy(data: bytes) -> bytes:
    return pa.Codec("snappy").compress(data, asbytes=True) + struct.pack(">I", zlib.crc32(data))


def _unsnappy(data: bytes, verify: bool) -> bytes:
    size = shift = at = 0
    while True:
        b = data[at]
        at += 1
        size |= (b & 0x7F) << shift
        shift += 7
        if b < 128:
            break
    out = pa.Codec("snappy").decompress(data[:-4], size, asbytes=True)
    if verify and struct.unpack(">I", data[-4:])[0] != zlib.crc32(out):
        raise ValueError("snappy block has a wrong checksum")
    return out


def _zstd(data: bytes, level: int | None) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(**({} if level is None else {"level": level})).compress(data)


def _unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _unlz4(data: bytes) -> bytes:
    (size,) = struct.unpack("<I", data[:4])
    return pa.Codec("lz4_raw").decompress(data[4:], size, asbytes=True) if size else b""


def _lz4(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + (pa.Codec("lz4_raw").compress(data, asbytes=True) if data else b"")


def _xz(data: bytes) -> bytes:
    """With a dictionary no larger than the data: that of the preset and its tables take some 90 MB."""
    kind = {"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": min(max(len(data), 1 << 12), 8 << 20)}
    return lzma.compress(data, filters=[kind])


CODECS = ("null", "deflate", "bzip2", "xz", "snappy", "zstandard", "lz4")


def compress(codec: str, data: bytes, level: int | None = None) -> bytes:
    makers = {"null": lambda: data, "deflate": lambda: _deflate(data, level), "bzip2": lambda: bz2.compress(data), "xz": lambda: _xz(data), "snappy": lambda: _snappy(data), "zstandard": lambda: _zstd(data, level), "lz4": lambda: _lz4(data)}
    if codec not in makers:
        raise ValueError(f"no codec is called {codec}")
    return makers[codec]()


def decompress(codec: str, data: bytes, verify: bool = True) -> bytes:
    makers = {"null": lambda: data, "deflate": lambda: _inflate(data), "bzip2": lambda: bz2.decompress(data), "xz": lambda: lzma.decompress(data), "snappy": lambda: _unsnappy(data, verify), "zstandard": lambda: _unzstd(data), "lz4": lambda: _unlz4(data)}
    if codec not in makers:
        raise ValueError(f"no codec is called {codec}")
    return makers[codec]()
