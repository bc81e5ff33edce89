"""Suffix-array deduplication with induced sorting.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.
The steps, in one query:

1. Each document is cut by its own content: the start positions whose next ``length`` bytes have the
   same smallest window hash make a run, and the run with its bytes is a piece. Equal strings have equal smallest
   hashes, so their starts lie in pieces of one hash, and each start lies in one piece. Blocks of documents
   send their distinct hashes to hash buckets and learn which ones other documents have too.
2. Pieces of those hashes, once a block and with the block's smallest document, go to shards by hash. A
   piece that a third of all documents hold is one row a block. Equal documents count once, by their smallest id.
3. A shard sorts its distinct pieces, where they share a string's hash with another, with a suffix array: suffixes
   are classified, leftmost-smaller substrings are sorted by induction and named by comparing neighbours, the names are
   sorted recursively, and all suffixes are induced, bucket by bucket (few characters) or place by place (many names). Permuted common prefixes
   against the predecessor in the array give the groups of equal strings, and each group its smallest document.
4. Every block gets back, for its pieces, the smallest document of each start, and cuts its texts.

Blocks read their texts from one shuffle, which steps 2 and 4 share.

Defined results: null text counts as empty; texts under ``length`` bytes lose nothing; documents with a null id lose
nothing and are nobody's original; rows with one id do not shorten each other; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LEFT, _LITTLE, _ODD, block_of, buckets_of, mix, ranges, raw_texts, rows_batch, slices

#: Bytes of a hashed window; a run's hash is the smallest of the windows inside ``length`` bytes.
WINDOW = 20
#: Bytes of texts that are cut into runs at once.
CUT_BYTES = 1 << 17
#: Characters up to which induction goes bucket by bucket in arrays; above, place by place with one head for each bucket.
BUCKETS = 512


# --- suffix arrays --------------------------------------------------------------------


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the end of the text is the smallest suffix."""
    sign = np.empty(s.size, np.int8)
    sign[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    sign[-1] = -1
    told = np.flatnonzero(sign)
    return sign[told[np.searchsorted(told, np.arange(s.size))]] > 0


def _deal(into: list[list[np.ndarray]], keys: np.ndarray, values: np.ndarray) -> None:
    if not keys.size:
        return
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
    for i, j in zip(at.tolist(), [*at[1:].tolist(), keys.size], strict=True):
        into[int(keys[i])].append(values[i:j])


def _induce(s: np.ndarray, k: int, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order of all suffixes from ``seeds``, the leftmost-smaller ones in order within their first characters."""
    n, none = s.size, np.empty(0, np.int64)
    seed: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(seed, s[seeds], seeds)
    up: list[list[np.ndarray]] = [[] for _ in range(k)]
    up[int(s[n - 1])].append(np.array([n - 1]))
    larger: list[np.ndarray] = [none] * k
    for c in range(k):
        if not up[c] and not seed[c]:
            continue
        cur = np.concatenate(up[c]) if up[c] else none
        chain = [cur]
        while cur.size:
            cur = cur[cur > 0] - 1
            cur = cur[(s[cur] == c) & ~small[cur]]
            chain.append(cur)
        larger[c] = np.concatenate(chain)
        back = np.concatenate([larger[c], *seed[c]])
        back = back[back > 0] - 1
        back = back[s[back] > c]
        if back.size:
            _deal(up, s[back], back)
    down: list[list[np.ndarray]] = [[] for _ in range(k)]
    out: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        if not down[c] and not larger[c].size:
            continue
        cur = np.concatenate(down[c]) if down[c] else none
        chain = [cur]
        while cur.size:
            cur = cur[cur > 0] - 1
            cur = cur[(s[cur] == c) & small[cur]]
            chain.append(cur)
        here = np.concatenate([*chain, larger[c][::-1]])
        out.append(here)
        back = here[here > 0] - 1
        back = back[(s[back] < c) & small[back]]
        if back.size:
            _deal(down, s[back], back)
    return np.concatenate(out)[::-1]


def _induce_each(s: np.ndarray, k: int, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """As ``_induce``, in time that does not depend on the number ``k`` of characters."""
    line, is_small, n = s.tolist(), small.tolist(), s.size
    sizes = np.bincount(s, minlength=k)
    ends = np.cumsum(sizes)
    out = [-1] * n
    tail = ends.tolist()
    for i in seeds[::-1].tolist():
        c = line[i]
        tail[c] -= 1
        out[tail[c]] = i
    head = (ends - sizes).tolist()
    c = line[n - 1]  # the end of the text comes before all
    out[head[c]] = n - 1
    head[c] += 1
    for at in range(n):
        i = out[at] - 1
        if i >= 0 and not is_small[i]:
            c = line[i]
            out[head[c]] = i
            head[c] += 1
    tail = ends.tolist()
    for at in range(n - 1, -1, -1):
        i = out[at] - 1
        if i >= 0 and is_small[i]:
            c = line[i]
            tail[c] -= 1
            out[tail[c]] = i
    return np.array(out)


def _names(s: np.ndarray, left: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the leftmost-smaller substrings ``left`` to ``end``, equal for equal ones; ``at`` is their order."""
    size = (end - left)[at]
    same = np.flatnonzero(size[1:] == size[:-1])
    many = size[same]
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    differ = s[np.repeat(left[at[same]], many) + place] != s[np.repeat(left[at[same + 1]], many) + place]
    fresh = np.ones(left.size, bool)
    fresh[0] = False
    if same.size:
        fresh[same + 1] = np.logical_or.reduceat(differ, np.cumsum(many) - many)
    last = np.flatnonzero(at == left.size - 1)[0]  # the last one runs into the end of the text
    if end[-1] == s.size:
        fresh[last:last + 2] = True
        fresh[0] = False
    name = np.empty(left.size, np.int64)
    name[at] = np.cumsum(fresh)
    return name


def suffix_array(s: np.ndarray, k: int | None = None) -> np.ndarray:
    """Order of the suffixes of a string of non-negative integers below ``k``."""
    s = np.asarray(s)
    n = s.size
    if n < 2:
        return np.arange(n)
    k = int(s.max()) + 1 if k is None else k
    induce = _induce if k <= BUCKETS else _induce_each
    small = _smaller(s)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost-smaller suffixes
    if left.size < 2:
        return induce(s, k, small, left)
    rough = induce(s, k, small, left)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    rough = rough[is_left[rough]]
    name = _names(s, left, np.minimum(np.append(left[1:] + 1, n), n), np.searchsorted(left, rough))
    names = int(name.max()) + 1
    order = np.argsort(name, kind="stable") if names == left.size else suffix_array(name, names)
    return induce(s, k, small, left[order])


def common_prefixes(raw: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each position of the bytes ``raw`` its common prefix with its predecessor in ``sa``, up to ``cap``."""
    n = raw.size
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([raw, np.zeros(cap + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for at in range(0, cap, 8):
        a = np.ascontiguousarray(words[live + at]).view(np.uint64).ravel()
        b = np.ascontiguousarray(words[before[live] + at]).view(np.uint64).ravel()
        x = a ^ b
        same = x == 0
        low = x[~same]
        low &= ~low + np.uint64(1)
        out[live] = at + 8
        out[live[~same]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[same]
    other = np.maximum(before, 0)
    room = np.minimum(n - np.arange(n), n - other)
    return np.minimum(np.minimum(out, cap), np.where(before >= 0, room, 0))


# --- pieces -------------------------------------------------------------------------


def window_hashes(raw: bytes, w: int) -> np.ndarray:
    """A hash of each ``w`` bytes of ``raw``."""
    n = len(raw) - w + 1
    loads = np.ndarray((len(raw),), _LITTLE, raw + bytes(8), strides=(1,))
    h = mix(loads[:n] & _LEFT[min(w, 8)])
    for k in range(8, w, 8):
        h *= _ODD
        h ^= loads[k : k + n] & _LEFT[min(w - k, 8)]
        h = mix(h)
    return h


def runs(raw: bytes, at: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of start positions of many texts: its key, its text, first and end start; ``at`` as from ``raw_texts``."""
    many = np.maximum(np.diff(at) - length + 1, 0)
    if not many.sum():
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    w = min(WINDOW, length)
    low = window_hashes(raw, w)
    width, have = length - w + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: low.size - (width - have)], low[width - have :])
    ends = np.cumsum(many)
    place = np.arange(ends[-1]) + np.repeat(at[:-1] - ends + many, many)
    v = low[place]
    edge = np.ones(v.size, bool)
    edge[1:] = v[1:] != v[:-1]
    edge[(ends - many)[many > 0]] = True
    edge = np.flatnonzero(edge)
    v = v[edge]
    key = (v >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | v & np.uint64(0xFFFFFFFF)
    start = place[edge]
    return key, np.searchsorted(ends, edge, "right"), start, start + np.diff(edge, append=place.size)


def among(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, keys), known.size - 1)] == keys if known.size else np.zeros(keys.size, bool)


def digest(piece: bytes) -> int:
    return int.from_bytes(blake2b(piece, digest_size=8).digest(), "little")


ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])
TOLD = pa.schema([("block", pa.int64()), ("keys", pa.binary())])
SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("bytes", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("hashes", pa.binary()), ("docs", pa.binary())])
BACK = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def shards_of(buckets: int) -> int:
    """Shards are smaller than buckets: a sort needs some 150 bytes of memory for each byte of its pieces."""
    return 4 * buckets


def _cat(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype)


def solve(pieces: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of each piece the smallest document of all pieces in which its ``length`` bytes occur, and where each piece's end.

    Only stretches of starts whose strings' hashes occur twice are sorted."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    whole = b"".join(pieces)
    opens = np.cumsum(sizes) - sizes
    many = sizes - length + 1
    ends = np.cumsum(many)
    owner = np.repeat(np.arange(sizes.size), many)
    first = docs[owner]
    h = window_hashes(whole, length)[np.arange(ends[-1]) + np.repeat(opens - ends + many, many)]
    order = np.argsort(h)
    twice = h[order[1:]] == h[order[:-1]]
    shared = np.zeros(h.size, bool)
    shared[order[1:][twice]] = True
    shared[order[:-1][twice]] = True
    # stretches of such starts, none across two pieces
    edge = shared.copy()
    edge[1:] &= ~shared[:-1]
    edge[ends[:-1]] |= shared[ends[:-1]]
    last = shared.copy()
    last[:-1] &= ~shared[1:]
    last[ends - 1] |= shared[ends - 1]
    some, stop = np.flatnonzero(edge), np.flatnonzero(last) + 1
    if some.size:
        at = some + (opens - ends + many)[owner[some]]
        least = _sorted_least([whole[a : a + n + length - 1] for a, n in zip(at.tolist(), (stop - some).tolist(), strict=True)], docs[owner[some]], length)
        first[shared] = np.concatenate(least)
    return first, ends


def _sorted_least(pieces: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\0".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    open_ = np.cumsum(sizes + 1) - sizes - 1
    s = raw.astype(np.uint16) + np.uint16(1)
    s[(open_ + sizes)[:-1]] = 0
    alphabet, s = np.unique(s, return_inverse=True)  # only the characters that occur
    sa = suffix_array(s.astype(np.int32), alphabet.size)
    # a start is good if its bytes stay inside its piece, so equal bytes are then equal strings
    owner = np.repeat(np.arange(sizes.size), sizes + 1)[: raw.size]
    good = np.arange(raw.size) + length <= (open_ + sizes)[owner]
    same = common_prefixes(raw, sa, length)[sa] >= length
    inside = good[sa]
    same &= inside & np.concatenate([[False], inside[:-1]])
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(docs[owner[sa]], head)
    first = np.empty(raw.size, np.int64)
    first[sa] = np.repeat(least, np.diff(head, append=raw.size))
    return [first[a : a + n - length + 1] for a, n in zip(open_.tolist(), sizes.tolist(), strict=True)]


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes, end exclusive) and kept (the remaining bytes) of every document."""
    buckets = buckets_of(docs)
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    df = df.select(block_of(F.col("doc_id"), F.col("text")).alias("block"), "doc_id", "text")

    # equal documents: all but those of the smallest id are copies; a block has one row of each text, so none is a hot key
    leads = df.where("doc_id is not null").groupBy("block", F.md5("text").alias("h")).agg(F.min("doc_id").alias("lead"), F.count("*").alias("c"))
    firsts = leads.groupBy("h").agg(F.min("lead").alias("first"), F.sum("c").alias("c")).where("c > 1").select("h", "first")
    copies = leads.select("block", "h").join(firsts, "h").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("h", "first"))).alias("copies"))  # at most a block's documents

    def copied(table: pa.Table) -> dict[str, int]:
        return {h: d for x in table["copies"].to_pylist() for h, d in x or ()}

    def is_copy(doc_id: int | None, raw: bytes, first: dict[str, int]) -> bool:
        return doc_id is not None and bool(first) and first.get(md5(raw).hexdigest(), doc_id) < doc_id

    def ask(batches):
        for b in batches:
            b = b.take(pa.array(np.argsort(b.column(0).to_numpy(), kind="stable")))
            blocks, ids = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            raw, at = raw_texts(b.column(2))
            keys, of = [], []
            for i, j in slices(at, CUT_BYTES):
                key, doc, _, _ = runs(bytes(raw[int(at[i]) : int(at[j])]), at[i : j + 1] - at[i], length, buckets)
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order] + i
                fresh = np.ones(key.size, bool)
                fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                fresh &= ids[doc]
                keys.append(key[fresh])
                of.append(blocks[doc[fresh]])
            keys, of = np.concatenate(keys), np.concatenate(of)
            rows = []
            for block, x, y in ranges(of):
                some, times = np.unique(keys[x:y], return_counts=True)
                bucket = (some >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                for i, j in zip(cut.tolist(), [*cut[1:].tolist(), some.size], strict=True):
                    rows.append({"bucket": int(bucket[i]), "block": block, "keys": some[i:j].astype(np.uint32).tobytes(), "many": np.packbits(times[i:j] > 1).tobytes()})
            if rows:
                yield rows_batch(rows, ASK)

    def tell(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=k.size) for x, k in zip(table["many"].to_pylist(), keys, strict=True)]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        shared = (np.bincount(where, weights=1 + np.concatenate(many), minlength=distinct.size) > 1)[where]
        rows, at, top = [], 0, np.uint64(table["bucket"][0].as_py() << 32)
        for block, k in zip(table["block"].to_pylist(), keys, strict=True):
            some = k[shared[at : at + k.size]]
            at += k.size
            if some.size:
                rows.append({"block": block, "keys": (some.astype(np.uint64) | top).tobytes()})
        return pa.Table.from_pylist(rows, schema=TOLD)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        shared, first = np.unique(_cat(right, "keys", np.uint64)), copied(right)
        found: dict[bytes, list] = {}
        ids, (raw, at) = left["doc_id"].to_pylist(), raw_texts(left["text"])
        gone = np.array([d is None or is_copy(d, raw[a:b], first) for d, a, b in zip(ids, at.tolist(), at[1:].tolist(), strict=False)], bool)
        for i, j in slices(at, CUT_BYTES) if shared.size else ():
            some = bytes(raw[int(at[i]) : int(at[j])])
            key, doc, start, end = runs(some, at[i : j + 1] - at[i], length, buckets)
            hit = np.flatnonzero(among(shared, key) & ~gone[doc + i])
            for k, d, a, b in zip(key[hit].tolist(), doc[hit].tolist(), start[hit].tolist(), end[hit].tolist(), strict=True):
                piece, doc_id = some[a : b + length - 1], ids[i + d]
                had = found.get(piece)
                if had is None:
                    found[piece] = [k, doc_id]
                elif doc_id < had[1]:
                    had[1] = doc_id
        shards: dict[int, list] = {}
        for piece, (k, doc_id) in found.items():
            shards.setdefault((k & 0xFFFFFFFF) % shards_of(buckets), []).append((piece, k, doc_id))
        block = left["block"][0].as_py() if left.num_rows else None
        rows = [
            {
                "shard": s,
                "block": block,
                "bytes": b"".join(x[0] for x in some),
                "sizes": np.array([len(x[0]) for x in some], np.uint32).tobytes(),
                "keys": np.array([x[1] for x in some], np.uint64).tobytes(),
                "hashes": np.array([digest(x[0]) for x in some], np.uint64).tobytes(),
                "docs": np.array([x[2] for x in some], np.int64).tobytes(),
            }
            for s, some in shards.items()
        ]
        return pa.Table.from_pylist(rows, schema=SENT)

    def sort(table: pa.Table) -> pa.Table:
        raw, sizes, docs_ = b"".join(table["bytes"].to_pylist()), _cat(table, "sizes", np.uint32).astype(np.int64), _cat(table, "docs", np.int64)
        number: dict[bytes, int] = {}  # pieces by their bytes
        ends = np.cumsum(sizes)
        where = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)), np.int64, sizes.size)
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, where, docs_)
        first, stop = solve(list(number), least, length)
        # stretches of starts with one document, piece by piece, and then row by row as they were sent
        edge = np.ones(first.size, bool)
        edge[1:] = first[1:] != first[:-1]
        edge[stop[:-1]] = True
        edge = np.flatnonzero(edge)
        width, doc = np.diff(edge, append=first.size).astype(np.uint32), first[edge]
        many = np.bincount(np.searchsorted(stop, edge, "right"), minlength=stop.size)
        counts = many[where]
        reached = np.cumsum(counts)
        place = np.arange(reached[-1]) + np.repeat((np.cumsum(many) - many)[where] - reached + counts, counts)
        width, doc, told = width[place], doc[place], counts.astype(np.uint32)
        rows, i, x = [], 0, 0
        for block, keys, mine in zip(table["block"].to_pylist(), table["keys"].to_pylist(), table["hashes"].to_pylist(), strict=True):
            j = i + len(mine) // 8
            y = int(reached[j - 1])
            rows.append({"block": block, "keys": keys, "hashes": mine, "counts": told[i:j].tobytes(), "sizes": width[x:y].tobytes(), "docs": doc[x:y].tobytes()})
            i, x = j, y
        return pa.Table.from_pylist(rows, schema=BACK)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        first = copied(right)
        right = right.filter(pa.compute.is_valid(right["hashes"]))
        hashes, counts = _cat(right, "hashes", np.uint64), _cat(right, "counts", np.uint32).astype(np.int64)
        sizes, firsts_ = _cat(right, "sizes", np.uint32).astype(np.int64), _cat(right, "docs", np.int64)
        keys = np.unique(_cat(right, "keys", np.uint64))
        order = np.argsort(hashes)
        known, opens = hashes[order], (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        ids, (raw, at) = left["doc_id"].to_pylist(), raw_texts(left["text"])
        copy = np.array([is_copy(d, raw[a:b], first) and b - a >= length for d, a, b in zip(ids, at.tolist(), at[1:].tolist(), strict=False)], bool)
        asks = ~copy & np.array([d is not None for d in ids], bool)
        cols: list[list] = [[], [], [], []]
        for i, j in slices(at, CUT_BYTES):
            some, edge = bytes(raw[int(at[i]) : int(at[j])]), at[i : j + 1] - at[i]
            out = np.repeat(copy[i:j], np.diff(edge))  # which bytes go
            key, doc, start, end = runs(some, edge, length, buckets)
            hit = np.flatnonzero(among(keys, key) & asks[doc + i])
            if hit.size:
                piece = np.fromiter((digest(some[a : b + length - 1]) for a, b in zip(start[hit].tolist(), end[hit].tolist(), strict=True)), np.uint64, hit.size)
                place = np.searchsorted(known, piece)
                place, start, doc = place, start[hit], doc[hit]
                mine = counts[place]
                row = np.repeat(opens[place] - np.cumsum(mine) + mine, mine) + np.arange(int(mine.sum()))
                size, least = sizes[row], firsts_[row]
                # first start of each stretch: the run's start and the stretches before it in the run
                so_far = np.cumsum(size) - size
                a = so_far + np.repeat(start - so_far[np.cumsum(mine) - mine], mine)
                bad = least < np.array(ids[i:j])[doc].astype(np.int64)[np.repeat(np.arange(doc.size), mine)]
                turn = np.zeros(out.size + 1, np.int64)
                np.add.at(turn, a[bad], 1)
                np.add.at(turn, a[bad] + size[bad] + length - 1, -1)
                out |= np.cumsum(turn[:-1]) > 0
            whole = np.frombuffer(some, np.uint8)
            for d, a, b in zip(ids[i:j], edge.tolist(), edge[1:].tolist(), strict=False):
                gone = out[a:b]
                spans: list[dict] = []
                kept = some[a:b]
                if gone.any():
                    turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)]
                    kept = whole[a:b][~gone].tobytes()
                for col, x in zip(cols, (d, b - a, spans, kept), strict=True):
                    col.append(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, KEPT, strict=True)], schema=KEPT)

    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    uncopied = F.lit(None).cast("map<string,bigint>").alias("copies")
    told = df.mapInArrow(ask, "bucket int, block long, keys binary, many binary").groupBy("bucket").applyInArrow(tell, "block long, keys binary")
    told = told.select("block", "keys", uncopied).union(copies.select("block", F.lit(b"").alias("keys"), "copies"))
    sent = df.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, "shard int, block long, bytes binary, sizes binary, keys binary, hashes binary, docs binary")
    back = sent.groupBy("shard").applyInArrow(sort, "block long, keys binary, hashes binary, counts binary, sizes binary, docs binary")
    back = back.select("*", uncopied).union(copies.select("block", *none("keys", "hashes", "counts", "sizes", "docs"), "copies"))
    return df.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
