"""Approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of long hash strings: the signs of a vector against ``bits`` random
directions. A query goes down each tree to the entries with the longest common prefix,
then all trees go up together, one bit at a time, and the entries that come to share the prefix in any tree are compared.

How far up. A vector at angle a agrees with the query in a bit with probability p = 1 - a / pi, and is still unseen at prefix
length d with probability (1 - p ** d) ** trees. With a the angle of the k-th nearest entry found so far, a query stops when
that is at most 1 - ``recall``: each vector that belongs among the k has then been seen with probability ``recall`` or
more, whatever the data. Clustered vectors stop at long prefixes, after few comparisons; vectors without
any structure at short ones (64 dimensions of noise: some 60 % of a shard; see the tests for both).

Rows are dealt into shards by id, so a hot vector or label makes no hot task; each shard of about
``shard_rows`` vectors builds its own forest, and each stated query is answered by every shard and the
answers merged; so the work is queries times shards times what a shard compares. Equal vectors of a shard are one entry
with its smallest ids, k + 1 of them: no other copy can be among the k nearest, so this loses nothing.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths are never compared; vectors are scaled by powers of two, so that squares neither overflow nor vanish; ties go
to the smaller id; rows with the query's id are its own; repeated rows of an id count once; with fewer than k others
all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def directions(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((trees, bits, dim))


def hash_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One uint64 for each tree and vector; the first direction is the highest bit."""
    trees, bits, _ = planes.shape
    weight = np.uint64(1) << np.arange(63, 63 - bits, -1, dtype=np.uint64)
    return np.stack([((vectors @ p.T > 0) * weight).sum(axis=1, dtype=np.uint64) for p in planes])


class Forest:
    def __init__(self, vectors: np.ndarray, planes: np.ndarray):
        self.planes, self.bits, self.vectors = planes, planes.shape[1], scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)
        keys = hash_strings(self.unit, planes)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def levels(self, queries: np.ndarray):
        """From the longest prefix upwards: its length, and for each tree and query the range of entries that share it."""
        q = hash_strings(queries, self.planes)
        for level in range(self.bits, -1, -1):
            free = (np.uint64(1) << np.uint64(64 - level)) - np.uint64(1) if level else ~np.uint64(0)
            lo = np.stack([np.searchsorted(k, x & ~free, "left") for k, x in zip(self.keys, q, strict=True)])
            hi = np.stack([np.searchsorted(k, x | free, "right") for k, x in zip(self.keys, q, strict=True)])
            yield level, lo, hi

    def search(self, queries: np.ndarray, k: int, recall: float) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query all entries that may be among its k nearest, their cosines, and how many were compared."""
        n, trees = queries.shape[0], self.keys.shape[0]
        queries = scaled(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        asked = (queries / norms[:, None]).astype(np.float32)
        cosines = lambda near, i: (self.vectors[near] * queries[i]).sum(axis=1) / (self.norms[near] * norms[i])
        seen, size = np.zeros((n, self.norms.size), bool), np.zeros(n, np.int64)
        best = [np.empty(0, np.float64)] * n  # cosines of the entries in found
        found = [np.empty(0, np.int64)] * n
        open_ = np.ones(n, bool)
        for level, lo, hi in self.levels(asked):
            now = (hi - lo).sum(axis=0)
            for i in np.flatnonzero(open_ & (now > np.maximum(size, k))).tolist():
                size[i] = now[i]
                near = np.concatenate([self.order[t, a:b] for t, a, b in zip(range(trees), lo[:, i].tolist(), hi[:, i].tolist(), strict=True)])
                near = np.unique(near[~seen[i, near]])
                seen[i, near] = True
                rough = self.unit[near] @ asked[i]
                if found[i].size > k:
                    near = near[rough >= best[i].min() - 1e-5]
                elif near.size > k + 1:
                    near = near[rough >= np.partition(rough, near.size - k - 1)[near.size - k - 1] - 1e-5]
                every, cos = np.concatenate([found[i], near]), np.concatenate([best[i], cosines(near, i)])
                if cos.size > k + 1:  # one more than k: the query itself may be among them
                    keep = cos >= np.partition(cos, cos.size - k - 1)[cos.size - k - 1] - 1e-12
                    every, cos = every[keep], cos[keep]
                found[i], best[i] = every, cos
                if cos.size > k:
                    agree = 1 - np.arccos(np.clip(cos.min(), -1, 1)) / np.pi
                    open_[i] = (1 - agree**level) ** trees > 1 - recall
            if not open_.any():
                break
        # too few entries for k: all of them
        for i in np.flatnonzero([f.size == 0 for f in found]).tolist():
            found[i], seen[i] = np.arange(self.norms.size), True
            best[i] = cosines(found[i], i)
        return [(f, c, int(s.sum())) for f, c, s in zip(found, best, seen, strict=True)]


def scaled(v: np.ndarray) -> np.ndarray:
    """Each vector by the power of two that brings its largest component near one, which changes no digit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fit)


def search(
    rows: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    trees: int = 64,
    bits: int = 32,
    recall: float = 0.9,
    shard_rows: int = 16384,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest found for each query."""
    base, asks = vectors(rows, id_col, vector_col), vectors(queries, id_col, vector_col)
    shards = max(1, -(-rows.count() // shard_rows))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return RESULT.empty_table()
        dim = len(left["v"][0])
        ids = left["id"].to_numpy()
        every = left["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        asked = right["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        one, where = np.unique(every, axis=0, return_inverse=True)
        by = np.lexsort((ids, where.ravel()))
        opens = np.searchsorted(where.ravel()[by], np.arange(one.shape[0] + 1))
        forest = Forest(one, directions(dim, trees, bits, seed))
        out: list[list] = [[], [], []]
        for at in range(0, asked.shape[0], 64):
            some = asked[at : at + 64]
            for q, (near, score, _) in zip(right["id"][at : at + 64].to_pylist(), forest.search(some, k, recall), strict=True):
                found: dict[int, float] = {}
                for entry, s in zip(near.tolist(), score.tolist(), strict=True):
                    copies = ids[by[opens[entry] : opens[entry + 1]]]
                    for i in np.unique(copies)[: k + 1].tolist():
                        if i != q:
                            found[i] = max(s, found.get(i, s))
                for i, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]:
                    for col, x in zip(out, (q, i, s), strict=True):
                        col.append(x)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, RESULT, strict=True)], schema=RESULT)

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    left = base.select(F.size("v").alias("dim"), shard, "id", "v").groupBy("dim", "shard")
    right = asks.dropDuplicates(["id", "v"]).select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "v").groupBy("dim", "shard")
    found = left.cogroup(right).applyInArrow(answer, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id")
    best = best.agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("near"))  # k of each shard
    return best.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
