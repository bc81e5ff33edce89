"""N-gram Jaccard join by T-occurrence search.

Documents are sets of distinct word shingles. Two link at ``similarity`` (in hundredths) or more
of Jaccard; the result is one row per document with the smallest id that links reach. The steps:

1. A necessary condition, exact for any data. In hash order the first n - T + c shingles of two
   linked sets share at least c' of them (T: overlap required of a set of n; c: a reserve of half the set).
   Prefixes go, combined per block of documents, to hash buckets, which count them and find the smallest id of each; each
   block gets both back. A document of which too few prefix shingles occur elsewhere links with nothing.
2. Equal sets of a block become one lead, and equal leads one representative, over a 128-bit signature.
3. Of the prefix the c' - 1 most frequent shingles may be dropped, and two linked sets still share
   one. A group is all representatives that keep a shingle of one smallest id: linked sets share a group, and a
   group is one step wide, so that chains of chance matches join no groups. A set is in as many groups as its
   kept shingles have smallest ids.
4. Inside a group, each set is a query against inverted lists. DivideSkip: the L longest lists are set
   aside, the short ones are merged, and what occurs T - L times there is probed in the long
   lists by binary search. Sets that are already in one component are not probed again. Merging counts in an array of the
   group's sets, not in a heap: for 184 lists of 2000 ids that is 1.2 ms against 180 ms by ``heapq.merge``.
5. A group of more than ``block_docs`` sets or ``block_shingles`` shingles is cut into blocks at random: links inside blocks
   first, then among one leader of each component found, and last every set outside the largest component against
   all blocks of the group, so that no link between different components is missed.
6. Only links found by 4 and 5, and copies with their representatives, are edges of the final components.

Words are hashed to 64 bits by rounds that are not linear in their bytes (long words by BLAKE2), shingles from the words' hashes.

Defined results: documents without words or with null text have 0 shingles and link with nothing;
fewer words than ``size`` are one shingle; repeated rows link with each other under one id, and rows of one id with
several texts are one node; a null id has its count and a null component; an empty table gives an empty result; other
columns do not matter. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLOCK_DOCS,
    ENTRIES,
    ENTRY_ARROW,
    SPREAD,
    block_of,
    buckets_of,
    mix,
    ranges,
    raw_texts,
    rows_batch,
    slices,
    trimmed,
    words_of,
    written,
)
from .components import components

_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of many texts, and where each text's begin and the last one's end."""
    words, begin = words_of(raw, at)
    if not words.size:
        return words, np.zeros(at.size, np.int64)
    n = max(0, words.size - size + 1)
    total = np.full(n, np.uint64(size))
    for j in range(size):
        total += words[j : j + n] * _ODD[j % 64]
    total = mix(total)
    sets, edges = [], begin.tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a >= size:
            one = total[a : b - size + 1]
            one.sort()
            sets.append(one)
        elif b > a:
            k = b - a
            sets.append(mix(np.array([np.uint64(k) + (words[a:b] * _ODD[np.arange(k) % 64]).sum(dtype=np.uint64)])))
        else:
            sets.append(words[:0])
    ends = np.cumsum([0, *(s.size for s in sets)])
    flat = np.concatenate(sets)
    fresh = np.ones(flat.size, bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[ends[:-1][ends[:-1] < flat.size]] = True
    return flat[fresh], np.concatenate([[0], np.cumsum(fresh)])[ends]


def required(n, similarity: int):
    """The least overlap of a set of ``n`` with any set it links with."""
    return -(-similarity * n // 100)


def reserve(n):
    return 1 + n // 2


def prefix(n, similarity: int):
    return np.minimum(n, n - required(n, similarity) + reserve(n))


def needed(n, similarity: int):
    """How many shingles of its prefix a set shares with that of any set it links with."""
    return reserve(required(n, similarity))


def keys_of(s: np.ndarray, buckets: int) -> np.ndarray:
    """Shingles as hash bucket and 32 more bits; two that fall together only count as more frequent."""
    return (s >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | s & np.uint64(0xFFFFFFFF)


def prefixes(flat: np.ndarray, ends: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all prefixes, and the text of each."""
    n = np.diff(ends)
    doc = np.repeat(np.arange(n.size), n)
    inside = np.arange(flat.size) - ends[:-1][doc] < prefix(n, similarity)[doc]
    return flat[inside], doc[inside]


TOLD = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary()), ("least", pa.binary())])
SETS = "doc_id long, n long, lead long, s1 long, s2 long, shingles binary, groups array<long>"
SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("lead", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.binary()), ("groups", pa.list_(pa.int64()))])


def candidate_sets(docs: DataFrame, size: int, similarity: int, buckets: int) -> DataFrame:
    """Steps 1 to 3 inside blocks: a row of SETS per document; all but doc_id and n are null where no link is possible.

    ``lead`` is the smallest id of the block with an equal set; the first row of a lead has the set and its groups."""

    def send(batches):
        for b in batches:
            ids = b.column(1)
            at = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            if not at.size:
                continue
            at = at[np.lexsort((ids.to_numpy(zero_copy_only=False)[at], b.column(0).to_numpy()[at]))]  # ascending ids: the first of equal keys has the least
            b = b.take(pa.array(at))
            place = (b.column(1).to_numpy() % BLOCK_DOCS).astype(np.uint16)
            raw, edge = raw_texts(b.column(2))
            for block, x, y in ranges(b.column(0).to_numpy()):
                keys, of = [], []
                for i, j in slices(edge[x : y + 1]):
                    i, j = x + i, x + j
                    flat, doc = prefixes(*shingle_sets(raw[int(edge[i]) : int(edge[j])], edge[i : j + 1] - edge[i], size), similarity)
                    keys.append(keys_of(flat, buckets))
                    of.append(doc + i)
                k, of = np.concatenate(keys), np.concatenate(of)
                if not k.size:
                    continue
                order = np.argsort(k, kind="stable")
                k = k[order]
                head = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0)
                many = np.diff(head, append=k.size) > 1
                val = place[of[order[head]]] | many.astype(np.uint16) << np.uint16(15)
                k = k[head]
                bucket = (k >> np.uint64(32)).astype(np.int64)
                low = k.astype(np.uint32)
                yield rows_batch([{"bucket": z, "block": block, "keys": low[i:j].tobytes(), "vals": val[i:j].tobytes()} for z, i, j in ranges(bucket)], ENTRY_ARROW)

    def answer(table: pa.Table) -> pa.Table:
        # a key counts once for each batch of documents that has it, twice for one with several of them
        keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
        every, vals = np.concatenate(keys), np.frombuffer(b"".join(table["vals"].to_pylist()), np.uint16)
        ends = np.cumsum([0, *(k.size for k in keys)])
        blocks = table["block"].to_numpy()
        ids = np.repeat(blocks // (2 * SPREAD) * BLOCK_DOCS, np.diff(ends)) + (vals & np.uint16(0x7FFF))
        order = np.argsort(every, kind="stable")
        sorted_ = every[order]
        head = np.flatnonzero(np.diff(sorted_, prepend=~sorted_[:1]) != 0)
        size = np.diff(head, append=every.size)
        times, least = np.empty(every.size, np.uint8), np.empty(every.size, np.int64)
        times[order] = np.repeat(np.minimum(np.add.reduceat(1 + (vals >> np.uint16(15)).astype(np.int64)[order], head), 255).astype(np.uint8), size)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], head), size)
        rows, bucket = [], table["bucket"][0].as_py()
        for block, k, a, b in zip(blocks.tolist(), keys, ends.tolist(), ends[1:].tolist(), strict=False):
            some = np.flatnonzero(times[a:b] > 1)
            if some.size:
                rows.append({"block": block, "bucket": bucket, "keys": k[some].tobytes(), "vals": times[a:b][some].tobytes(), "least": least[a:b][some].tobytes()})
        return pa.Table.from_pylist(rows, schema=TOLD)

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(right[name].to_pylist()), kind)
        low = joined("keys", np.uint32)
        bucket = np.repeat(np.array(right["bucket"].to_pylist(), np.uint64), [len(x) // 4 for x in right["keys"].to_pylist()])
        keys, first = np.unique(bucket << np.uint64(32) | low.astype(np.uint64), return_index=True)
        vals, least = joined("vals", np.uint8)[first].astype(np.int64), joined("least", np.int64)[first]
        ids = left["doc_id"].to_pylist()
        raw, edge = raw_texts(left["text"])
        n_all = np.zeros(len(ids), np.int64)
        signs: list[tuple | None] = [None] * len(ids)
        sets: dict[tuple, tuple] = {}  # of each signature: least id, its first row, set and groups
        for i, j in slices(edge):
            flat, ends = shingle_sets(raw[int(edge[i]) : int(edge[j])], edge[i : j + 1] - edge[i], size)
            n = np.diff(ends)
            n_all[i:j] = n
            if not keys.size:
                continue
            some, doc = prefixes(flat, ends, similarity)
            some = keys_of(some, buckets)
            at = np.minimum(np.searchsorted(keys, some), keys.size - 1)
            known = keys[at] == some
            at, doc, some = at[known], doc[known], some[known]
            shared = np.bincount(doc, minlength=n.size)
            open_ = np.concatenate([[0], np.cumsum(shared)])
            for d in np.flatnonzero((n > 0) & (shared >= needed(n, similarity))).tolist():
                doc_id = ids[i + d]
                if doc_id is None:
                    continue
                s = flat[ends[d] : ends[d + 1]]
                sign = signs[i + d] = (s.size, int(np.bitwise_xor.reduce(s).astype(np.int64)), int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                had = sets.get(sign)
                if had is None:
                    mine = at[open_[d] : open_[d + 1]]
                    rare = np.lexsort((some[open_[d] : open_[d + 1]], vals[mine]))[: mine.size - needed(s.size, similarity) + 1]
                    sets[sign] = (doc_id, i + d, s.tobytes(), np.unique(least[mine[rare]]).tolist())
                elif doc_id < had[0]:
                    sets[sign] = (doc_id, i + d, *had[2:])
        firsts = {x[1]: x for x in sets.values()}
        cols = [ids, n_all.tolist()]
        cols.append([None if x is None else sets[x][0] for x in signs])
        cols += [[None if x is None else x[k] for x in signs] for k in (1, 2)]
        cols += [[firsts[i][k] if i in firsts else None for i in range(len(ids))] for k in (2, 3)]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, SETS_ARROW, strict=True)], schema=SETS_ARROW)

    entries = docs.select("block", "doc_id", "text").mapInArrow(trimmed(send), ENTRIES)
    answers = entries.groupBy("bucket").applyInArrow(trimmed(answer), "block long, bucket int, keys binary, vals binary, least binary")
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(trimmed(choose), SETS)


class Links:
    """Union-find and T-occurrence search over the sets of one group."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], labels: list[int] | None, similarity: int):
        order = sorted(range(len(ids)), key=lambda i: (sets[i].size, ids[i]))
        self.order, self.similarity = order, similarity
        self.sets = [sets[i] for i in order]
        self.root = np.arange(len(ids))  # the component of each set, by its first set
        first: dict[int, int] = {}
        for at, i in enumerate(order):  # rows of one id, or of one label, are together from the start
            for key in {ids[i], *([labels[i]] if labels else [])}:
                self.join(first.setdefault(key, at), at)
        sizes = self.size = np.array([s.size for s in self.sets], np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        token = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        by_token = np.argsort(token, kind="stable")
        self.lists = doc[by_token]  # inverted lists, one behind the other, documents ascending
        opens = np.flatnonzero(np.diff(token[by_token], prepend=~token[by_token[:1]] if token.size else 0) != 0)
        head = np.repeat(opens, np.diff(opens, append=token.size))
        self.head, self.rank = np.empty(token.size, np.int64), np.empty(token.size, np.int64)
        self.head[by_token] = head
        self.rank[by_token] = np.arange(token.size) - head
        self.span = np.concatenate([[0], np.cumsum(sizes)])
        longest = int(np.diff(opens, append=token.size).max(initial=1))
        self.penalty = 0.0085 * np.log2(max(2, longest)) + 1

    def find(self, i: int) -> int:
        return int(self.root[i])

    def join(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)

    def search(self, i: int) -> None:
        """Joins set ``i`` with what it links with among the sets before it, which are no larger."""
        a, b = self.span[i], self.span[i + 1]
        n = int(b - a)
        need = required(n, self.similarity)
        size, head = self.rank[a:b], self.head[a:b]
        some = size > 0
        if int(some.sum()) < need or not n:
            return
        size, head = size[some], head[some]
        by_size = np.argsort(size, kind="stable")
        size, head = size[by_size], head[by_size]
        n_long = min(int(need / self.penalty) // 2, need - 1)  # half of the customary number: merging is vectorised here
        short = size.size - n_long
        ends = np.cumsum(size[:short])
        merged = self.lists[np.repeat(head[:short] - ends + size[:short], size[:short]) + np.arange(ends[-1])]
        times = np.bincount(merged, minlength=1)
        found = np.flatnonzero(times >= need - n_long)
        found = found[(self.root[found] != self.root[i]) & (100 * self.size[found] >= self.similarity * n)]
        found = found[np.argsort(-times[found], kind="stable")]
        root = self.root[found]
        best = np.unique(root, return_index=True)[1]  # the likeliest of each component first
        rest = np.delete(found, best)
        for some in (found[best], rest):
            some = some[self.root[some] != self.root[i]]  # the rest of a joined component is settled
            for j in some[self._linked(some, times[some], n, size[short:], head[short:])].tolist():
                self.join(i, j)

    def _linked(self, some: np.ndarray, have: np.ndarray, n: int, size: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Which of ``some`` reach the overlap: binary probes of the long lists, for all that still can."""
        need, have, live = required(n, self.similarity), have.astype(np.int64), np.arange(some.size)
        for k, (h, z) in enumerate(zip(head.tolist(), size.tolist(), strict=True)):
            if not live.size:
                break
            one, j = self.lists[h : h + z], some[live]
            have[live] += one[np.minimum(one.searchsorted(j), z - 1)] == j
            if k % 8 == 7:
                live = live[have[live] + size.size - k - 1 >= need]
        return 100 * have >= self.similarity * (n + self.size[some] - have)

    def labels(self, ids: list[int]) -> list[int]:
        low: dict[int, int] = {}
        for at, i in enumerate(self.order):
            r = self.find(at)
            low[r] = min(low.get(r, ids[i]), ids[i])
        out = [0] * len(ids)
        for at, i in enumerate(self.order):
            out[i] = low[self.find(at)]
        return out


LINKED = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _linker(similarity: int):
    """For groups of (rep, shingles[, label]): edges to the smallest id of each set's component inside the group, or
    between labels that links join."""

    def link(table: pa.Table) -> pa.Table:
        known = table["label"].to_pylist() if "label" in table.column_names else None
        ids = table["rep"].to_pylist()
        links = Links(ids, [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()], known, similarity)
        for i in range(len(ids)):
            links.search(i)
        names = known or ids
        pairs = sorted({(a, b) for a, b in zip(names, links.labels(names), strict=True) if a != b})
        return pa.table([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], schema=LINKED)

    return link


def _across(sets: DataFrame, edges: DataFrame, block_docs: int, similarity: int) -> DataFrame:
    """Step 5 behind the links inside blocks: all verified edges. ``sets``: rep, shingles, root, part of the cut groups."""
    link = _linker(similarity)

    def labelled() -> DataFrame:
        return written(sets.select("rep", "root", "part").join(components(edges).toDF("rep", "label"), "rep", "left").select("rep", "root", "part", F.coalesce("label", "rep").alias("label")), "jaccard-label")

    # leaders, dealt into blocks anew each time, until they fit one block or no longer join
    turn, more, label = 0, True, labelled()
    while more:
        leaders = written(label.groupBy("root", "label").agg(F.min("rep").alias("rep")), "jaccard-leaders")
        count = leaders.groupBy("root").count().where("count > 1")
        most = count.agg(F.max("count")).first()[0] or 0
        turn += 1
        part = F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("count") / block_docs)).alias("part")
        dealt = sets.select("rep", "root", "shingles").join(leaders.join(count, "root").select("root", "label", "rep", part), ["root", "rep"])
        found = written(dealt.groupBy("root", "part").applyInArrow(link, "u long, v long"), "jaccard-edges")
        joined = found.count()
        if joined:
            edges = edges.union(found)
            label = labelled()
        more = most > block_docs and joined > 0
    # every set outside its group's largest component against all blocks of the group
    by_label = label.groupBy("root", "label").count()
    top = by_label.groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.sum("count").alias("all"), F.max("count").alias("most")).where("all > most")
    here = sets.select("rep", "root", "shingles").join(written(label.join(top, "root").select("rep", "root", "part", "label", "top", F.ceil((F.col("all") - F.col("most")) / block_docs).alias("turns")), "jaccard-rest"), ["root", "rep"])
    blocks = label.select("root", F.col("part").alias("into")).distinct()
    asks = here.where("label <> top").withColumn("turn", F.pmod(F.xxhash64("rep", F.lit(0)), "turns"))
    asks = asks.join(blocks, "root").select("root", F.col("into").alias("part"), "turn", "rep", "shingles", "label")
    index = here.select("root", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "rep", "shingles", "label")
    return edges.union(written(asks.union(index).groupBy("root", "part", "turn").applyInArrow(link, "u long, v long"), "jaccard-edges"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, similarity: int = 85, block_docs: int = 1024, block_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    df = df.select(block_of(F.col("doc_id"), F.col("text")).alias("block"), "doc_id", "text")
    sets = written(candidate_sets(df, size, similarity, buckets_of(docs)), "jaccard-sets")
    able = sets.where("lead is not null")
    leads = able.where("shingles is not null").select("lead", "n", "s1", "s2")
    # leads of equal sets: one row a block at most, so no set of copies is a hot key
    named = written(leads.join(leads.groupBy("n", "s1", "s2").agg(F.min("lead").alias("rep")), ["n", "s1", "s2"]).select("lead", "rep", "n"), "jaccard-reps")
    # rows of one id that are in several classes are one node
    twice = able.groupBy("doc_id").count().where("count > 1")
    same = able.select("doc_id", "lead").join(twice, "doc_id", "left_semi").distinct().where("doc_id <> lead")
    edges = written(named.where("lead <> rep").select(F.col("lead").alias("u"), F.col("rep").alias("v")).union(same), "jaccard-copies")

    chosen = able.where("shingles is not null").join(named.where("lead = rep").select("lead").distinct(), "lead", "left_semi").select(F.col("lead").alias("rep"), "n", "shingles", "groups")
    members = written(chosen.select("rep", "n", F.explode("groups").alias("root")), "jaccard-members")
    sizes = members.groupBy("root").agg(F.count("*").alias("count"), F.sum("n").alias("all")).where("count > 1")
    cuts = F.ceil(F.greatest(F.col("count") / block_docs, F.col("all") / block_shingles))
    dealt = members.join(sizes, "root").select("rep", "root", cuts.alias("cuts"), F.pmod(F.xxhash64("rep"), cuts).alias("part"))
    grouped = written(chosen.select("rep", "shingles").join(dealt, "rep"), "jaccard-groups")
    edges = written(edges.union(grouped.groupBy("root", "part").applyInArrow(_linker(similarity), "u long, v long")), "jaccard-edges")
    cut = grouped.where("cuts > 1")
    if cut.head(1):
        edges = _across(cut, edges, block_docs, similarity)
    roots = components(edges).toDF("lead", "root")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("lead", "doc_id").alias("lead")).join(roots, "lead", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "lead").alias("component_id"))
