"""The corpus pipeline: five stages over documents, each written and reread by whoever runs them.

language: documents go whose language their text does not tell (no letters, trigrams that fit no language, or probability
under 0.5) or whose text contradicts the declared one; ``lang`` becomes the identified language. duplicates: of each
component of near-duplicates (word 5-grams, Jaccard 0.8) the document with the smallest id stays.
decontamination: documents with any benchmark passage go, however long they are. secrets: found secrets are replaced in the text.
pieces: the rest is encoded; one row per document with its ids and what they decode to.

Every stage takes the rows its predecessor kept, and all but the last return the columns of documents.
Empty input gives an empty result in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avrospark.llm import decontam, jaccard, langid, pieces, secrets
from avrospark.llm.common import shared_dir, written

#: No SQL expresses language identification or encoding; the tests hold each stage against brute force.
ORACLE_SQL = None

#: A text contradicts its declared language if it gives that language less than this share.
CONTRADICTED = 0.05
#: Prior weight of a text in no known language against one in any of them.
NO_LANGUAGE = 0.01


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language their text tells, with that language in ``lang``; see above for what goes.

    Null and empty texts have no letters and go; a null label contradicts nothing; a null source has the overall prior; repeated
    rows are judged each; without any labelled text nothing can be told and all rows go."""
    model = langid.fit(docs)
    told = langid.identify(docs, model, markup=F.col("lang"), host=F.col("source"))
    if not model.languages:
        return docs.where("false")
    # by the text alone, all languages alike before it: what it says of the declared language, and of none
    total = F.aggregate("text_evidence", F.lit(0.0), lambda s, x: s + F.exp(x))
    declared = F.array_position(F.array(*map(F.lit, model.languages)), F.col("row.lang").cast("string")).cast("int")
    share = F.exp(F.when(declared > 0, F.element_at("text_evidence", F.greatest(declared, F.lit(1))))) / total
    other = NO_LANGUAGE * F.exp(F.least("other", F.lit(700.0)))
    fits = F.col("text_evidence").isNotNull() & (other < total) & F.coalesce(share >= CONTRADICTED, F.lit(True))
    # one struct, so that a column of the documents named like one of identify's is no alias for it
    row = F.struct(*((F.col("lang") if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns))
    return told.where(fits & F.col("lang").isNotNull() & (F.col("probability") >= 0.5)).select(row.alias("row")).select("row.*")


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, the one with the smallest id.

    Repeated and null ids: then rows are told apart by numbers written with them, so that equal rows are duplicates too, texts of
    one id are judged each, and of rows with one id the first stays; rows without an id come last. Documents without words
    have no shingles and all stay. An empty table gives no rows."""
    ids = docs.groupBy("doc_id").count()
    if not ids.where("count > 1 or doc_id is null").head(1):
        gone = jaccard.join(docs, size=5, similarity=80).where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")), "pipeline-rows")
    of = jaccard.join(rows.select("key", "row.text"), id_col="key", size=5, similarity=80)
    named = rows.select("key", "row.doc_id").join(of.select(F.col("doc_id").alias("key"), "component_id"), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("first"))
    return rows.join(first.select("first.key"), "key", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark text, whether that has an id or not. Null and empty texts stay."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), share=None, nameless=True)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced in ``text`` and ``n_chars`` counted anew where there were any; null texts stay null."""
    found = secrets.scan(docs)
    text = secrets.redacted(F.col("row.text"), F.col("spans"))
    new = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    # one struct, so that a column of the documents named like one of the scan's is no alias for it
    return found.select(F.struct(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)).alias("row")).select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded of all documents; null and empty texts have no ids and decode to the empty text."""
    return pieces.encode(docs)


STAGES = [
    ("language", language),
    ("duplicates", duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stage's rows written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
