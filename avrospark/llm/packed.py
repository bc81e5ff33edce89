"""Token ids in binary files: fixed-width bit packing with block offsets.

A file is one segment: a header, the documents' ids, where each document starts, a table of
block offsets, and the token ids, each in ``bits`` = the fewest bits that hold the vocabulary.
A block of ``BLOCK`` ids is a whole number of bytes, so any block is unpacked alone, by numpy,
from its offset: random access reads one block for one id. Files end with one line feed.

Layout (header big-endian, the rest little-endian):
``TPK1`` | bits u4 | range u8 | segment u8 | n_docs u8 | n_ids u8 | doc ids i8[n_docs] |
starts u8[n_docs + 1] | block offsets u8[blocks + 1] | packed ids

Writing: documents are range-partitioned and sorted by id, encoded where they land and cut into
segments of at most ``segment_ids`` ids (one document more at most), each one file. Files go through Spark's own
committer to any file system. Only (range, segment, n_ids) of the files make the global starts:
sums inside a range by a window, and one number per range on the driver, of which there are as
many as shuffle partitions.

Defined results: null text counts as empty and has only its end id; a null document id is stored as
-2**63 and read back as null, first in order; rows with one id keep all their texts, in any order
among themselves; a long text is never cut; an empty table gives no rows; ids outside the vocabulary raise.
"""

from __future__ import annotations

import os
import struct
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, parts, raw_texts, shared_dir, slices, span_hashes, written

MAGIC, HEAD = b"TPK1", struct.Struct(">4sIQQQQ")
#: Ids of a block; a multiple of 8, so that blocks are whole bytes at any width.
BLOCK = 4096
#: Bytes of text that are looked up in the memo at once.
MEMO_BYTES = 1 << 19
NULL_ID = -(1 << 63)
MEMO = 1_000_000
#: Rows of a manifest that are sent to all tasks: some 16 MB.
SENT_ROWS = 500_000


def width(vocabulary: int) -> int:
    """The fewest bits that hold ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, ids.size, BLOCK * 64):
        some = ids[at : at + BLOCK * 64]
        out.append(np.packbits(np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 32)[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """``n`` ids from whole blocks."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    out = []
    step = BLOCK * 64
    for at in range(0, n, step):
        k = min(step, n - at)
        b = np.unpackbits(np.frombuffer(raw, np.uint8, (k * bits + 7) // 8, at * bits // 8), bitorder="little")[: k * bits].reshape(k, bits)
        wide = np.zeros((k, 32), np.uint8)
        wide[:, :bits] = b
        out.append(np.packbits(wide.ravel(), bitorder="little").view("<u4"))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def segment(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, of_range: int, number: int) -> bytes:
    sizes = np.array([x.size for x in ids], np.int64)
    every = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    packed = pack(every, bits)
    blocks = -(-every.size // BLOCK)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * (BLOCK * bits // 8), len(packed))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    docs = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    return HEAD.pack(MAGIC, bits, of_range, number, len(doc_ids), every.size) + docs.tobytes() + starts.tobytes() + offsets.tobytes() + packed


class Segment:
    """A segment that is read in place."""

    def __init__(self, raw: bytes | memoryview):
        magic, self.bits, self.range, self.number, n_docs, self.n_ids = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEAD.size
        self.docs = np.frombuffer(raw, "<i8", n_docs, at)
        at += 8 * n_docs
        self.starts = np.frombuffer(raw, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        blocks = -(-self.n_ids // BLOCK)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at).astype(np.int64)
        at += 8 * (blocks + 1)
        self.packed = memoryview(raw)[at : at + int(self.offsets[-1])]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end``; only their blocks are unpacked."""
        if end <= start:
            return np.empty(0, "<u4")
        a, b = start // BLOCK, -(-end // BLOCK)
        raw = self.packed[int(self.offsets[a]) : int(self.offsets[b])]
        return unpack(raw, min(b * BLOCK, self.n_ids) - a * BLOCK, self.bits)[start - a * BLOCK : end - a * BLOCK]


_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b",.;:!?")] = True


def part_starts(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where texts may be cut: a byte-level pre-tokenizer always begins a token at white space behind another character,
    and at a stop behind a letter.

    Cuts at white space are those at spaces and line feeds; white space beyond ASCII is told by its two or three bytes."""
    cut = np.zeros(b.size, bool)
    cut[1:] = _STOP[b[1:]] & _LETTER[b[:-1]]
    opens = np.flatnonzero(((b[1:] == 32) | (b[1:] == 10)) & ~_BLANK[b[:-1]]) + 1
    wide = opens[b[opens - 1] >= 128]
    p1, p2, p3 = b[wide - 1], b[np.maximum(wide - 2, 0)], b[np.maximum(wide - 3, 0)]
    blank = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
    blank |= (p3 == 0xE2) & ((p2 == 0x80) & ((p1 >= 0x80) & (p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) | (p2 == 0x81) & (p1 == 0x9F))
    cut[opens] = True
    cut[wide[blank]] = False
    cut[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """The tokenizers library over parts of texts, each encoded once and kept in a bounded memo of arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.memo = Tokenizer.from_file(path), Memo(MEMO, np.uint32)
        added = {t.content for t in self.lib.get_added_tokens_decoder().values()}
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character for each of its bytes
        for t, i in vocab.items():
            self.bytes_of[i] = len(t.encode()) if t in added else len(t)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode_joined(self, chunks: list[str]) -> list[bytes]:
        """Chunks that each begin with a safe cut: encoded behind one another, and cut again where their bytes end."""
        if not chunks:
            return []
        sizes = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks))
        lines = ["".join(chunks[i : i + 2048]) for i in range(0, len(chunks), 2048)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(lines, add_special_tokens=False)])
        reached = np.cumsum(self.bytes_of[ids])
        ends = np.cumsum(sizes)
        stop = np.searchsorted(reached, ends) + 1
        if reached[-1] != ends[-1] or (reached[stop - 1] != ends).any():
            return self._encode(chunks)
        raw, at = ids.tobytes(), [0, *(stop * 4).tolist()]
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]

    def encode_raw(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts behind one another, and how many each has; ``at``: where each begins and the last ends."""
        if not raw:
            return np.empty(0, np.uint32), np.zeros(at.size - 1, np.int64)
        start = part_starts(np.frombuffer(raw, np.uint8), at)
        ends = np.append(start[1:], len(raw))

        def make(which: np.ndarray) -> list[bytes]:
            parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[which].tolist(), ends[which].tolist(), strict=True)]
            # those that begin with a cut and do not end in white space can stand behind one another
            joined = [k for k, p in enumerate(parts) if p[0] in " \n" and not p[-1].isspace()]
            out: list[bytes] = [b""] * len(parts)
            for k, ids in zip(joined, self._encode_joined([parts[k] for k in joined]), strict=True):
                out[k] = ids
            alone = sorted(set(range(len(parts))).difference(joined))
            for k, ids in zip(alone, self._encode([parts[k] for k in alone]), strict=True):
                out[k] = ids
            return out

        ids, size = self.memo.look(span_hashes(raw, start, ends - start), make)
        edge = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(edge[np.searchsorted(start, at)])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        ids, sizes = self.encode_raw(b"".join(raw), np.cumsum([0, *map(len, raw)]))
        return np.split(ids, np.cumsum(sizes)[:-1])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, segment_ids: int = 4_000_000) -> str:
    """Encodes, appends ``end_id`` to each document, writes the files; returns their folder (by default one in the shared folder)."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    model = tokenizer or default_tokenizer()
    bits = width(max(vocabulary(model), end_id + 1))

    def run(batches):
        number, docs_, ids_, n = 0, [], [], 0
        task = TaskContext.get().partitionId()

        def cut():
            raw = segment(docs_, ids_, bits, task, number)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["segment"])

        for b in batches:
            some, (raw, at) = b.column(0).to_pylist(), raw_texts(b.column(1))
            for i, j in slices(at, MEMO_BYTES):
                ids, sizes = encoder(model).encode_raw(bytes(raw[int(at[i]) : int(at[j])]), at[i : j + 1] - at[i])
                ends = np.cumsum(sizes)
                for d, x in zip(some[i:j], np.split(np.insert(ids, ends, end_id), ends + np.arange(1, j - i + 1)), strict=False):
                    docs_.append(d)
                    ids_.append(x)
                    n += x.size
                    if n >= segment_ids:
                        yield cut()
                        number, docs_, ids_, n = number + 1, [], [], 0
        if docs_:
            yield cut()

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    df = df.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id")
    made = df.mapInArrow(run, "segment binary")
    # the text writer copies bytes as they are; each row is one file
    made.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be sent to all tasks if it has few rows of a few numbers; else the planner decides."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """range, segment, n_docs, n_ids and first (ids before the segment) of each file."""
    return _manifest(spark, path)[0]


def _manifest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    number = lambda at: F.conv(F.hex(F.substring("content", at, 8)), 16, 10).cast("long")
    heads = files(spark, path).select(number(9).alias("range"), number(17).alias("segment"), number(25).alias("n_docs"), number(33).alias("n_ids"))
    heads = written(heads, "packed-manifest")
    at, count, before = 0, 0, []
    for r in heads.groupBy("range").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).orderBy("range").collect():  # as many rows as ranges
        before.append((r["range"], at))
        at, count = at + r["n"], count + r["files"]
    ranges = _small(spark.createDataFrame(before, "range long, before long"), len(before))
    inside = F.sum("n_ids").over(Window.partitionBy("range").orderBy("segment")) - F.col("n_ids")
    return heads.withColumn("inside", inside).join(ranges, "range").select("range", "segment", "n_docs", "n_ids", (F.col("inside") + F.col("before")).alias("first")), count


DOCS = pa.schema([("range", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary: little-endian unsigned 32-bit) of every document in the files."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                s = Segment(raw.as_buffer())
                for at in range(0, s.docs.size, 256):
                    some = s.docs[at : at + 256]
                    edge = s.starts[at : at + some.size + 1]
                    ids = s.ids(int(edge[0]), int(edge[-1])).astype("<u4").tobytes()
                    rel = ((edge - edge[0]) * 4).tolist()
                    cols = [
                        pa.array(np.full(some.size, s.range, np.int64)),
                        pa.array(np.full(some.size, s.number, np.int64)),
                        pa.array(some, mask=some == NULL_ID),
                        pa.array(edge[:-1]),
                        pa.array(np.diff(edge)),
                        pa.array([ids[i:j] for i, j in zip(rel, rel[1:], strict=False)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, schema=DOCS)

    heads, count = _manifest(spark, path)
    first = _small(heads.select("range", "segment", "first"), count)
    rows = files(spark, path).select("content").mapInArrow(run, "range long, segment long, doc_id long, inside long, n_tokens long, ids binary")
    return rows.join(first, ["range", "segment"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids")
