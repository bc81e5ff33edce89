"""The operators' queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, forest, jaccard, langid, maxent, merkle, packed, pieces, secrets, suffix
from .common import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; the text model is fitted on a bounded sample of the labelled documents."""
    model = langid.fit(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages").withColumn("page_text", langid.page_text(F.col("html")))
    told = langid.identify(pages, model, text_col="page_text", keep=["page_id"], **langid.page_clues(F.col("url"), F.col("html")))
    return told.select("row.page_id", "lang", "probability")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' WARC files against a replica in which some records are damaged and some are lost, by the md5 of their ids."""
    record = merkle.record(F.col("page_id"), F.col("url"), F.col("html"))
    fate = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    rows = table(spark, sf_dir, "pages").select("page_id", record.alias("record"), fate.alias("fate"))
    damaged = F.when(F.col("fate") == "00", F.concat(F.lit(b"\0"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))
    # records are hashed where they are read; their bytes don't travel
    placed = written(merkle.place(rows.select("page_id", "fate", *merkle.measured(F.col("record")), F.sha2(damaged, 256).alias("replica_sha256"))), "warc-records")
    records = placed.select("warc_file", "warc_offset", "page_id", "warc_length", "record_sha256")
    replica = placed.where("fate is null or fate <> '01'").select("warc_file", "warc_offset", "page_id", "warc_length", F.col("replica_sha256").alias("record_sha256"))
    found = merkle.audit(records, replica)
    return records.join(found, ["warc_file", "warc_offset"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))


OP3_SQL = """
WITH r AS (
  SELECT page_id, page_id // 1000 AS warc_file,
    'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e
      || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS record,
    substr(md5(page_id::VARCHAR), 1, 2) AS fate
  FROM pages, (SELECT chr(13) || chr(10) AS e))
SELECT warc_file, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS warc_offset,
  page_id, strlen(record) AS warc_length, sha256(record) AS record_sha256,
  CASE fate WHEN '00' THEN 'corrupt' WHEN '01' THEN 'missing' ELSE 'ok' END AS status
FROM r
"""


def op4_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = packed.write(table(spark, sf_dir, "documents"))
    return packed.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.verdict(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.dedup(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return forest.search(rows, rows.where("vec_id % 50 = 0"))  # the stated queries; every row is a candidate


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "row.doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 3), ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

OP6_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(list_slice(ws, p, p + least(len(ws), 13) - 1), ' ') AS g FROM i, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS t(p) WHERE len(ws) > 0),
found AS (SELECT doc_id, item_id, k.n, p FROM w, (SELECT DISTINCT n FROM wins) k, unnest(range(1, len(ws) - k.n + 2)) AS t(p) JOIN wins ON wins.n = k.n AND wins.g = array_to_string(list_slice(ws, p, p + k.n - 1), ' ')),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxent_scoring": op1_maxent_scoring,
    "op2_language_id": op2_language_id,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_bit_packing": op4_bit_packing,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_fixity": OP3_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
}
