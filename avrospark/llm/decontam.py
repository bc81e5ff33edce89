"""Benchmark decontamination with one Aho-Corasick automaton.

Items and documents are normalised alike: A-Z lower-cased, words are runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Every window of ``size`` consecutive item words (an
item of fewer words is one window) goes, with a space on both sides, into one automaton.
It reads each document once; a match is mapped back through the word table to character
offsets of the original text.

The automaton is sent to the executors, so its patterns are bounded: ``max_chars`` characters
of patterns make one automaton, and a larger benchmark is worked off in several passes whose
hits accumulate in the row, with a checkpoint between passes.

Defined results: null and empty texts have no words and no hits; item rows with null
text are ignored, and those with null id unless ``nameless``: then they are one item with the id null, last in ``items``;
rows with one item_id are one item; repeated document rows each get their
row; an empty benchmark leaves every document clean; other columns, whatever their names, are
not touched.
"""

from __future__ import annotations

import pickle
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, texts

#: Bytes of normalised text: A-Z lower-cased, other bytes of words kept, all else a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FOUND = "doc_id {id}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def normal(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def windows(raw: bytes, size: int) -> set[tuple[bytes, int]]:
    """(pattern, words) of an item."""
    w = normal(raw)
    n = min(size, len(w))
    return {(b" " + b" ".join(w[i : i + n]) + b" ", n) for i in range(len(w) - n + 1)} if w else set()


def pattern_sets(items: DataFrame, item_col: str, text_col: str, size: int, max_chars: int, nameless: bool = False) -> list[bytes]:
    """Pickled {pattern: (words, item ids)}, each of at most ``max_chars`` characters but for one window more."""
    sets: list[dict] = [{}]
    chars = 0
    for item, raw in items.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        if raw is None or item is None and not nameless:
            continue
        for pattern, n in windows(bytes(raw), size):
            if chars > max_chars:
                sets.append({})
                chars = 0
            if pattern not in sets[-1]:
                chars += len(pattern)
            sets[-1].setdefault(pattern, (n, set()))[1].add(item)
    return [pickle.dumps(s) for s in sets]


def in_order(ids: set) -> list:
    return sorted(ids, key=lambda i: (i is None, i or ""))


@lru_cache(maxsize=1)
def automaton(pickled: bytes):
    found = ahocorasick.Automaton()
    for pattern, (n, ids) in pickle.loads(pickled).items():
        found.add_word(pattern.decode("latin-1"), (n, in_order(ids)))
    if len(found):
        found.make_automaton()
    return found


def hits(auto, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word intervals (end exclusive) of all matches, and their items."""
    if not len(auto) or not words:
        return [], set()
    line = b" " + b" ".join(words) + b" "
    found = list(auto.iter(line.decode("latin-1")))
    if not found:
        return [], set()
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(gaps, [end for end, _ in found])
    return [(int(j) - n, int(j)) for j, (_, (n, _)) in zip(last, found, strict=True)], {i for _, (_, ids) in found for i in ids}


def covered(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    max_chars: int = 4_000_000,
    nameless: bool = False,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids of items with a match, sorted), spans (characters, end exclusive)."""
    sets = pattern_sets(items, item_col, item_text, size, max_chars, nameless)
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    between = f"doc_id {kind}, text string, hit array<long>, items array<string>"
    for k, pickled in enumerate(sets):
        sent, last = df.sparkSession.sparkContext.broadcast(pickled), k == len(sets) - 1

        def work(batch: pa.RecordBatch, sent=sent, last=last, first=k == 0) -> pa.RecordBatch:
            auto = automaton(sent.value)
            n_words, n_hit, all_items, spans, flat = [], [], [], [], []
            for i, raw in enumerate(texts(batch.column(1))):
                words = normal(raw)
                where, ids = hits(auto, words)
                if not first:
                    before = batch.column(2)[i].as_py()
                    where += list(zip(before[::2], before[1::2], strict=True))
                    ids |= set(batch.column(3)[i].as_py())
                where = covered(where)
                all_items.append(in_order(ids))
                if not last:
                    flat.append([x for ab in where for x in ab])
                    continue
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in where))
                at = [m.span() for m in WORDS_AS_TEXT.finditer(raw.decode("utf-8"))] if where else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in where])
            lists = pa.array(all_items, pa.list_(pa.string()))
            if not last:
                return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.int64())), lists], ["doc_id", "text", "hit", "items"])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), lists, pa.array(spans, span)], ["doc_id", "n_words", "n_hit", "items", "spans"])

        df = map_batches(df, work, FOUND.format(id=kind) if last else between)
        if not last:
            shared_dir(df.sparkSession)
            df = df.checkpoint()
    return df


#: The words of an original text, with A-Z not yet lower-cased.
WORDS_AS_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def verdict(n_words, n_hit, share: int | None = 20):
    """A document is contaminated if at least 1/``share`` of its words are hit; without a share, if any is."""
    return n_hit > 0 if share is None else (n_hit > 0) & (share * n_hit >= n_words)


def keep_clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", size: int = 13, max_chars: int = 4_000_000, share: int | None = 20, nameless: bool = False) -> DataFrame:
    """Documents that are not contaminated, with all their columns; texts and order within a task stay."""
    at, names = docs.columns.index(text_col), docs.columns
    sets = pattern_sets(items, "item_id", "text", size, max_chars, nameless)
    if len(sets) > 1:  # several passes: mark the rows, pass by pass
        from .common import written

        rows = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("doc_id")), "decontam")
        found = scan(rows.select("doc_id", F.col(f"row.{text_col}").alias("text")), items, size=size, max_chars=max_chars, nameless=nameless)
        bad = found.where(verdict(F.col("n_words"), F.col("n_hit"), share)).select("doc_id")
        return rows.join(bad, "doc_id", "left_anti").select("row.*")
    sent = docs.sparkSession.sparkContext.broadcast(sets[0])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto, keep = automaton(sent.value), []
        for raw in texts(batch.column(at)):
            words = normal(raw)
            n = sum(b - a for a, b in covered(hits(auto, words)[0]))
            keep.append(not verdict(len(words), n, share))
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, work, docs.schema).toDF(*names)
