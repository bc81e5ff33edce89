"""Merkle fixity audit of WARC records.

``store`` turns pages into WARC records with the file and offset they are kept at; ``place`` gives the places of records that
are measured and hashed already, so that their bytes never travel. ``audit`` compares two replicas. Ordered offset ranges of
record hashes are hashed into trees: a leaf covers ``leaf`` bytes of offsets of a file, each level above ``fan`` ranges, the
files' tops are hashed into a tree over ``fan`` files a level, up to the roots of a replica. If the roots are equal, nothing
else is compared; else only children of mismatching nodes are, level by level, down to records.

A node has at most ``fan`` children and a leaf the records of one offset range, so no group grows
with the data, and ranges go by stored offsets, so a lost record spoils its own range only. DataFrame functions
do it all; the node table is written once to the shared folder.

Defined results: null addresses or bodies are empty; pages without id are dealt by hash into files below 0; repeated pages are
records of their own, in the order of their hashes; records only one replica has are ``missing`` or ``extra``; two empty replicas are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Pages of one WARC file: consecutive ids.
FILE_PAGES = 1000
#: Files for pages without id.
NAMELESS = 1024


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC response record."""
    body = F.coalesce(html.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def place(records: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """``records`` (page_id, warc_length, record_sha256 and more) with warc_file and warc_offset, as they lie in files of consecutive pages."""
    nameless = -1 - F.pmod(F.xxhash64("record_sha256"), F.lit(NAMELESS))
    rows = records.withColumn("warc_file", F.coalesce(F.floor(F.col("page_id") / file_pages).cast("long"), nameless))
    here = Window.partitionBy("warc_file").orderBy("page_id", "record_sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("warc_offset", F.coalesce(F.sum("warc_length").over(here), F.lit(0).cast("long")))


def measured(record_: Column) -> list[Column]:
    return [F.length(record_).cast("long").alias("warc_length"), F.sha2(record_, 256).alias("record_sha256")]


def store(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """warc_file, warc_offset, page_id and record, as they lie in files of consecutive pages."""
    rows = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return place(rows.select("*", *measured(F.col("record"))), file_pages).select("warc_file", "warc_offset", "page_id", "record")


def leaves(stored: DataFrame) -> DataFrame:
    """Records by place and hash; their bytes are not needed any more."""
    return stored.select("warc_file", "warc_offset", "page_id", *measured(F.col("record")))


def _hashed(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x[order].cast("string"), x[value])), ","), 256).alias("h"))


def tree(records: DataFrame, leaf: int, fan: int, levels: int) -> DataFrame:
    """All nodes (level, file, slot, h) but for the levels over files: level 0 are leaves, ``levels`` the files' tops."""
    at = _hashed(records.withColumn("slot", F.floor(F.col("warc_offset") / leaf)), ["warc_file", "slot"], "warc_offset", "record_sha256")
    nodes = at.select(F.lit(0).alias("level"), "warc_file", "slot", "h")
    for level in range(1, levels + 1):
        up = F.floor(F.col("slot") / fan) if level < levels else F.lit(0).cast("long")
        at = _hashed(at.withColumn("up", up), ["warc_file", "up"], "slot", "h").withColumnRenamed("up", "slot")
        nodes = nodes.union(at.select(F.lit(level), "warc_file", "slot", "h"))
    return nodes


def audit(a: DataFrame, b: DataFrame, *, leaf: int = 1 << 16, fan: int = 16) -> DataFrame:
    """Records of ``a`` or ``b`` (both with the columns of ``leaves``) that differ: warc_file, warc_offset, status.

    corrupt: other bytes at the place; missing: not in ``b``; extra: only in ``b``.
    """
    both = written(a.select(F.lit("a").alias("side"), "*").union(b.select(F.lit("b"), "*")), "merkle-records")
    a, b = both.where("side = 'a'"), both.where("side = 'b'")
    top, files = both.agg(F.max("warc_offset"), F.max("warc_file")).first()
    levels, span = 1, leaf
    while span <= (top or 0):
        span, levels = span * fan, levels + 1
    nodes = tree(a, leaf, fan, levels).withColumn("side", F.lit("a")).union(tree(b, leaf, fan, levels).withColumn("side", F.lit("b")))
    nodes = written(nodes, "merkle-nodes")

    def differing(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
        one, two = rows.where("side = 'a'").select(*keys, F.col(value).alias("x")), rows.where("side = 'b'").select(*keys, F.col(value).alias("y"))
        return one.join(two, keys, "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))

    # the tree over files, from the files' tops to one root
    over = [nodes.where(F.col("level") == levels).select("side", F.col("warc_file").alias("slot"), "h")]
    width = max(files if files is not None else 0, NAMELESS) + 2
    while width > 1:
        over.append(_hashed(over[-1].withColumn("up", F.floor(F.col("slot") / fan)), ["side", "up"], "slot", "h").withColumnRenamed("up", "slot"))
        width = -(-width // fan) + (1 if width > fan else 0)
    # files below 0 (pages without id) and the others end in one slot each; their nodes are the roots
    bad = written(differing(over[-1], ["slot"], "h").select("slot"), "merkle-bad")
    if not bad.head(1):
        return both.where("false").select("warc_file", "warc_offset", F.lit("").alias("status"))
    for rows in reversed(over[:-1]):
        some = rows.withColumn("up", F.floor(F.col("slot") / fan)).join(bad.withColumnRenamed("slot", "up"), "up", "left_semi")
        bad = written(differing(some, ["slot"], "h").select("slot"), "merkle-bad")
    bad = bad.select(F.col("slot").alias("warc_file"), F.lit(0).cast("long").alias("slot"))
    for level in range(levels - 1, -1, -1):
        up = F.floor(F.col("slot") / fan) if level < levels - 1 else F.lit(0).cast("long")
        some = nodes.where(F.col("level") == level).withColumn("up", up).join(bad.withColumnRenamed("slot", "up"), ["warc_file", "up"], "left_semi")
        bad = written(differing(some, ["warc_file", "slot"], "h").select("warc_file", "slot"), "merkle-bad")
    some = both.withColumn("slot", F.floor(F.col("warc_offset") / leaf)).join(bad, ["warc_file", "slot"], "left_semi")
    found = differing(some, ["warc_file", "warc_offset"], "record_sha256")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
    return found.select("warc_file", "warc_offset", status.alias("status"))
