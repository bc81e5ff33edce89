"""Helpers shared by the training-data operators.

``map_batches`` runs an Arrow function over a DataFrame by column position, so extra
or repeated column names in the input never clash with what an operator adds.
``by_bucket`` and ``summed`` serve the exchange that answers "what does the whole corpus know about the keys of this
block of documents" with one shuffle each way: the keys of a block are combined before they
travel, so a key that a third of all documents hold is sent once a block and no task
ever holds a list of the documents of one key.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from functools import wraps
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch
from ..shared import shared_dir as shared_dir
from ..shared import trim

#: Documents of one block, a power of two: consecutive ids, so that a block's rows mostly share a scan task.
BLOCK_DOCS = 2048
#: Texts of at least so many bytes go to one of SPREAD side blocks of their block, so that no block has more than
#: BLOCK_DOCS * LONG_TEXT bytes of short texts, or some BLOCK_DOCS / SPREAD long ones.
LONG_TEXT, SPREAD = 1 << 14, 1 << 3
#: Bytes of input for which there is one hash bucket.
BUCKET_BYTES = 16 << 20
#: Rows of an Arrow batch that are worked on at once, and the bytes of text at which fewer are taken.
SLICE, SLICE_BYTES = 512, 1 << 19

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: it cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(run: Callable) -> Callable:
    """``run`` of mapInArrow, or of (co)groups, and then ``trim``."""
    if inspect.isgeneratorfunction(run):

        @wraps(run)
        def each(batches):
            yield from run(batches)
            trim()

        return each
    if len(inspect.signature(run).parameters) == 1:

        @wraps(run)
        def one(table):
            out = run(table)
            trim(table.nbytes)
            return out

        return one

    @wraps(run)
    def two(left, right):
        out = run(left, right)
        trim(left.nbytes + right.nbytes)
        return out

    return two


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``fn`` over slices of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                out = fn(b.slice(at, SLICE))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(trimmed(run), schema)


def texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def raw_texts(col: pa.Array | pa.ChunkedArray) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes of all texts behind one another, and where each begins and the last ends; null as empty."""
    col = col.cast(pa.large_binary())
    col = (pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())) if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return memoryview(b""), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = memoryview(col.buffers()[2]) if col.buffers()[2] is not None else memoryview(b"")
    return data[int(at[0]) : int(at[-1])], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with up to ``most`` bytes, one text at least; ``at`` as from ``raw_texts``."""
    i, n = 0, at.size - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ranges(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    if not sorted_.size:
        return []
    at = np.flatnonzero(np.diff(sorted_, prepend=sorted_[:1] - 1)).tolist()
    return list(zip(sorted_[at].tolist(), at, [*at[1:], sorted_.size], strict=True))


def block_of(doc_id: Column, text: Column) -> Column:
    """Block of a document; long texts have side blocks, and documents without an id are spread by their text."""
    main = F.coalesce(F.shiftright(doc_id.cast("long"), BLOCK_DOCS.bit_length() - 1), F.pmod(F.xxhash64(text), F.lit(BLOCK_DOCS)) - F.lit(1 << 40))
    long_ = F.coalesce(F.octet_length(text), F.lit(0)) >= LONG_TEXT
    return main * F.lit(2 * SPREAD) + F.when(long_, F.pmod(F.xxhash64(doc_id), F.lit(SPREAD)) + 1).otherwise(F.lit(0))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_of(df: DataFrame) -> int:
    """Hash buckets for the keys of ``df``: by the bytes that its scan is planned to read, as many as shuffle partitions at least.

    Many buckets share a shuffle task if there are fewer tasks; each bucket is answered alone, so its size bounds the memory."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts(df.sparkSession), min(size // BUCKET_BYTES, 1 << 22))


# --- hashing of words, vectorised -------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of an eight-byte load that belong to a word with so many bytes left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 32
_LITTLE = np.dtype("<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def words_of(raw: bytes | memoryview, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of many texts, and where each text's words begin and the last one's end.

    ``raw`` and ``at`` as from ``raw_texts``. Each eight bytes of a word are mixed into its hash in turn, which is not linear in them;
    words of over 32 bytes have a BLAKE2 hash.
    """
    low = bytes(raw).translate(LOWER)
    if not low:
        return np.empty(0, np.uint64), np.zeros(at.size, np.int64)
    w = _IS_WORD[np.frombuffer(low, np.uint8)]
    opens, ends = w.copy(), w.copy()
    opens[1:] &= ~w[:-1]
    ends[:-1] &= ~w[1:]
    edge = at[(at > 0) & (at < w.size)]  # no word crosses from one text to the next
    opens[edge] = w[edge]
    ends[edge - 1] = w[edge - 1]
    start, size = np.flatnonzero(opens), np.flatnonzero(ends) + 1
    return span_hashes(low, start, size - start), np.searchsorted(start, at)


def span_hashes(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of ``raw`` at ``start`` of ``size`` bytes."""
    loads = np.ndarray((len(raw),), _LITTLE, raw + bytes(8), strides=(1,))
    h = mix(mix(loads[start] & _LEFT[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
    for k in range(8, _LONG_WORD, 8):
        some = np.flatnonzero(size > k)
        if not some.size:
            break
        h[some] = mix(h[some] * _ODD ^ mix(loads[start[some] + k] & _LEFT[np.minimum(size[some] - k, 8)]))
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        a = int(start[i])
        h[i] = int.from_bytes(blake2b(raw[a : a + int(size[i])], digest_size=8).digest(), "little")
    return h


class Memo:
    """Arrays by the hash of what they are made from; at most ``most``, then it is emptied, which changes speed and never results."""

    def __init__(self, most: int, kind):
        self.most, self.kind = most, np.dtype(kind)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.values, self.used = np.empty(1 << 16, self.kind), 0

    def look(self, hashes: np.ndarray, make: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of ``hashes`` behind one another, and their sizes; ``make`` gives those at some places of ``hashes``."""
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.isin(distinct, self.keys, assume_unique=True)
        if self.keys.size + (~known).sum() > self.most:
            self.clear()
            known[:] = False
        if not known.all():
            new = np.flatnonzero(~known)
            made = make(first[new])
            sizes = np.fromiter(map(len, made), np.int64, len(made)) // self.kind.itemsize
            values = np.frombuffer(b"".join(made), self.kind)
            if self.used + values.size > self.values.size:
                self.values = np.concatenate([self.values[: self.used], np.empty(max(self.values.size, values.size), self.kind)])
            self.values[self.used : self.used + values.size] = values
            place = np.searchsorted(self.keys, distinct[new])
            self.at = np.insert(self.at, place, self.used + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, place, sizes)
            self.keys = np.insert(self.keys, place, distinct[new])
            self.used += values.size
        place = np.searchsorted(self.keys, distinct)[where]
        at, size = self.at[place], self.size[place]
        ends = np.cumsum(size)
        return self.values[np.arange(ends[-1] if ends.size else 0) + np.repeat(at - ends + size, size)], size


# --- the exchange ---------------------------------------------------------------------

ENTRIES = "bucket int, block long, keys binary, vals binary"
ANSWERS = "block long, keys binary, vals binary"


def by_bucket(block: int, keys: np.ndarray, vals: np.ndarray, buckets: int) -> list[dict]:
    """Rows for ``answer``: keys (uint64, each once) and values (uint32) of a block, by hash bucket."""
    which = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    keys, vals, which = keys[order], vals[order].astype(np.uint32), which[order]
    at = np.flatnonzero(np.diff(which, prepend=-1))
    return [
        {"bucket": int(which[i]), "block": block, "keys": keys[i:j].tobytes(), "vals": vals[i:j].tobytes()}
        for i, j in zip(at, [*at[1:], which.size], strict=True)
    ]


def rows_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_pylist(rows, schema=schema) if rows else None


ENTRY_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
ANSWER_ARROW = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])


def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: distinct keys, their values summed, all keys, and the start of each row's keys."""
    keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    vals = [np.frombuffer(x, np.uint32) for x in table["vals"].to_pylist()]
    at = np.cumsum([0, *(k.size for k in keys)])
    every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    distinct, where = np.unique(every, return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(vals), minlength=distinct.size).astype(np.int64) if keys else np.empty(0, np.int64)
    return distinct, total, where, at
