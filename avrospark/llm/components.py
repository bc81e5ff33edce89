"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Nodes that a task contracts before it lets them go.
NODES = 500_000
#: Neighbours from which a node is a hub, whose edges are dealt out by SALTS.
HUB, SALTS = 2048, 64


def _contract(batches):
    """Edges of one task as stars: each node of its local components to the smallest. It merges and drops repeats."""
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = parent.get(p, p)
            i = p
        return i

    def stars():
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(i) for i in nodes], pa.int64())], schema=EDGES)

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) >= NODES:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def _least(edges: DataFrame, least: Column, hubs: bool) -> DataFrame:
    """``edges`` (u, v) with m, the least of ``least`` over each u; the edges of hubs never meet in one task."""
    if not hubs:
        return edges.join(edges.groupBy("u").agg(F.min(least).alias("m")), "u")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("u", "salt").agg(F.min(least).alias("m"))
    back = part.select("u", "salt").join(part.groupBy("u").agg(F.min("m").alias("m")), "u")
    return salted.join(back, ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the component's smallest node.

    Every round groups by node with map-side minima and joins those back; where a node has very many neighbours,
    its edges are dealt out by a salt. Tasks contract what they hold, up to a bound. Rounds are tables in
    the shared folder. They end when every node has one edge, to a node without one.
    """
    contracted = lambda e: written(e.mapInArrow(_contract, "u long, v long").distinct(), "stars")
    e = contracted(edges.where("u <> v").select("u", "v"))
    while True:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        # twice an end upwards, or an end upwards and one downwards: not a forest of stars yet
        seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        open_, most = seen.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.max(F.col("up") + F.col("down"))).first()
        if not open_:
            return e.union(e.select("v", "v").distinct()).toDF("node", "root")
        hubs = most >= HUB
        both = e.union(e.select("v", "u"))
        large = _least(both, F.least("u", "v"), hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large, F.col("v"), hubs)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        e = contracted(small)
