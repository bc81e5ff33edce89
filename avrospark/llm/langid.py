"""Language identification by Bayesian evidence fusion.

For each row the evidence is fused in log space, language by language:

* the text: a naive Bayes likelihood of hashed byte trigrams, tempered by the text's length, so that
  long texts are not certain beyond the model's own error rate,
* the declared markup language, right with probability ``markup_trust``,
* the address suffix (path part, then top-level domain), right with ``suffix_trust``,
* the host's prior: soft language counts of the other three by host, by registered domain and overall, from one
  grouped aggregation, each level without the row itself and smoothed towards the one above by ``strength`` pseudo-rows.

The text model is fitted on some ``train_rows`` labelled rows, equally many of each language, by the hash of id and text; everything
else covers all rows. The evidence is written once. Host sums are combined before the shuffle, so a host with a third of all
rows is no hot key; the written table of hosts is broadcast only if it is small, else its join may be skewed, and adaptive
execution splits it.

Defined results: null or empty texts, or texts without letters, give no text evidence; with no evidence of any
kind ``lang`` is null and ``probability`` 0; a null host has the overall prior; ties go to the language first in order;
repeated rows count as often as they occur; an empty table gives no rows; without labelled rows there are no
languages, and all rows are undetermined. Input columns come back in ``row``, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import LOWER, mix, texts, trim, written

TABLE = 1 << 14
#: What stays of a byte for the text model: letters and bytes beyond ASCII; all else is a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(raw: bytes) -> np.ndarray:
    """Hashed trigrams of the letters of a text."""
    b = np.frombuffer(b" " + raw.translate(LOWER).translate(LETTERS) + b" ", np.uint8).astype(np.uint64)
    g = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    g = g[(b[1:-1] != 32)]
    return (mix(g) % np.uint64(TABLE)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  # log probability of each hashed trigram, by language

    def evidence(self, raw: bytes) -> tuple[list[float] | None, float | None]:
        """Tempered log likelihoods, the best at 0, and that of no language, where all trigrams are alike; none without letters."""
        g = grams(raw)
        if not g.size:
            return None, None
        total, temper = self.weights[:, g].sum(axis=1), min(1.0, 40.0 / g.size)
        return ((total - total.max()) * temper).tolist(), float((-np.log(TABLE) * g.size - total.max()) * temper)


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 2000) -> TextModel:
    """The text model of all labels that occur, from some ``train_rows`` labelled rows, as many of each language as there are.

    Rows are chosen by a hash of their id and text. Trigrams are counted where the texts are: one row of counts a language is collected."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    counts = np.full((len(languages), TABLE), 0.5)
    if not languages:
        return TextModel([], np.zeros((0, TABLE)))
    each = max(1, train_rows // len(languages))
    top = {x: min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, each / n))) for x, n in sizes.items()}
    most = F.create_map(*(F.lit(y) for x in top.items() for y in x))
    chosen = rows.where(F.col("h") <= most[F.col("lang")]).dropDuplicates(["h"])  # a repeated row counts once

    def count(batches):
        for b in batches:
            of: dict[str, np.ndarray] = {}
            for lang, raw in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                of[lang] = of.get(lang, 0) + np.bincount(grams(raw), minlength=TABLE)
            yield pa.RecordBatch.from_arrays([pa.array(list(of)), pa.array([x.astype(np.int64).tobytes() for x in of.values()], pa.binary())], ["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
        return pa.table({"lang": table["lang"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "lang string, counts binary"
    for r in chosen.select("lang", "text").mapInArrow(count, kind).groupBy("lang").applyInArrow(add, kind).collect():
        counts[languages.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def _rows(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, none of them null, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows.shape[0] + 1, dtype=np.int32) * (rows.shape[1] if rows.size else 0)), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def _normal(logs: np.ndarray) -> np.ndarray:
    raised = np.exp(logs - logs.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def declared(of: Column, languages: Sequence[str], trust: float) -> Column:
    """Log likelihood of a declaration under each language; flat where nothing known is declared."""
    other = (1 - trust) / max(1, len(languages) - 1)
    known = of.isin(*languages) if languages else F.lit(False)
    return F.array(*(F.when(known, F.when(of == x, F.log(F.lit(trust))).otherwise(F.log(F.lit(max(other, 1e-9))))).otherwise(F.lit(0.0)) for x in languages))


def _plus(*arrays: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), arrays)


def identify(
    df: DataFrame,
    model: TextModel,
    *,
    text_col: str = "text",
    markup: Column | None = None,
    suffixes: Sequence[Column] = (),
    host: Column | None = None,
    domain: Column | None = None,
    markup_trust: float = 0.9,
    suffix_trust: float = 0.8,
    strength: float = 5.0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``row``, ``lang``, ``probability``, ``posterior`` (array in the order of ``model.languages``), ``text_evidence`` and ``other`` of every row.

    ``markup``, ``suffixes``, ``host`` and ``domain`` are columns of ``df``."""
    names, langs = df.columns, model.languages
    if not langs:
        return df.select(F.struct(*(names if keep is None else keep)).alias("row"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.array().cast("array<double>").alias("posterior"), F.lit(None).cast("array<double>").alias("text_evidence"), F.lit(None).cast("double").alias("other"))
    null = F.lit(None).cast("string")
    clues = F.struct(*((markup if markup is not None else null).cast("string").alias("markup"), F.array(*(s.cast("string") for s in suffixes), null).alias("suffixes"), (host if host is not None else null).cast("string").alias("host"), (domain if domain is not None else host if host is not None else null).cast("string").alias("domain")))
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in (names if keep is None else keep)]
    m, s = F.col("clues.markup"), F.col("clues.suffixes")
    flat = F.array(*(F.lit(0.0) for _ in langs))
    hints = _plus(flat, declared(m, langs, markup_trust), *(declared(s[i], langs, suffix_trust) for i in range(len(suffixes))))
    any_ = F.coalesce(m.isin(*langs), F.lit(False))
    for i in range(len(suffixes)):
        any_ |= F.coalesce(s[i].isin(*langs), F.lit(False))
    sent = df.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<text:array<double>,other:double,logs:array<double>,share:array<double>,seen:boolean>")
    def weigh(text: pa.Array, hints: pa.Array, any_: pa.Array) -> pa.Array:
        """Evidence of texts, fused with that of the declarations; only texts travel to Python, the rows wait where they are."""
        found = [sent.value.evidence(x) for x in texts(text)]
        logs, seen = _rows(hints).copy(), any_.to_numpy(zero_copy_only=False).astype(bool)
        for i, (x, _) in enumerate(found):
            if x is not None:
                logs[i] += x
                seen[i] = True
        share = _normal(logs) * seen[:, None] if len(found) else logs
        cols = [pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([x for _, x in found], pa.float64()), _lists(logs), _lists(share), pa.array(seen)]
        out = pa.StructArray.from_arrays(cols, names=["text", "other", "logs", "share", "seen"])
        trim()
        return out

    some = df.select(F.struct(*quoted).alias("row"), clues.alias("clues"), F.col(text_col).cast("string").alias("text"))
    own = some.select("row", F.col("clues.host").alias("host"), F.col("clues.domain").alias("domain"), weigh("text", hints, any_).alias("w"))
    own = written(own.select("row", "host", "domain", "w.logs", "w.share", "w.seen", F.col("w.text").alias("text_evidence"), "w.other"), "langid-evidence")

    # hierarchical counts: one aggregation by host, the levels above are sums of it
    by_host = own.where("seen").groupBy("host", "domain").agg(*(F.sum(F.col("share")[i]).alias(f"n{i}") for i in range(len(langs))))
    by_host = written(by_host, "langid-hosts")
    n = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(langs))]
    counts = lambda name: F.array(*(F.col(f"n{i}") for i in range(len(langs)))).alias(name)
    overall = np.array([float(x or 0.0) for x in by_host.agg(*n).first()])
    by_domain = by_host.where("domain is not null").groupBy("domain").agg(*n).select("domain", counts("of_domain"))
    # a table of known size: the planner sends it to all tasks if it is small, and else shuffles
    hosts = written(by_host.where("host is not null").select("host", "domain", counts("of_host")).join(by_domain, "domain"), "langid-levels")
    both = own.join(hosts, ["host", "domain"], "left")

    @arrow_udf("array<double>")
    def fuse(logs: pa.Array, share: pa.Array, known: pa.Array, of_host: pa.Array, of_domain: pa.Array) -> pa.Array:
        own_, above = _rows(share), np.full(len(langs), 1.0 / len(langs))
        # what a row adds to the counts is no evidence about it
        smoothed = lambda level, above, weight: (others := np.maximum(level - own_, 0.0), (others + weight * above) / (others.sum(axis=1, keepdims=True) + weight))[1]
        prior = smoothed(overall[None, :], above, float(len(langs)))
        local = smoothed(_rows(of_host), smoothed(_rows(of_domain), prior, strength), strength)
        given = np.where(known.to_numpy(zero_copy_only=False)[:, None], local, prior)
        return _lists(_normal(_rows(logs) + np.log(given)))

    posterior = fuse(F.col("logs"), F.col("share"), F.col("of_host").isNotNull(), F.coalesce("of_host", flat), F.coalesce("of_domain", flat))
    done = both.select("row", "seen", posterior.alias("posterior"), "text_evidence", "other")
    best = F.array_max("posterior")
    lang = F.element_at(F.array(*map(F.lit, langs)), F.array_position("posterior", best).cast("int"))
    return done.select("row", F.when(F.col("seen"), lang).alias("lang"), F.when(F.col("seen"), best).otherwise(0.0).alias("probability"), "posterior", "text_evidence", "other")


# --- clues of web pages -----------------------------------------------------------------


def page_clues(url: Column, html: Column) -> dict:
    """Columns for ``identify``: declared markup language, address suffixes, host and registered domain."""
    part = lambda text, rule: F.nullif(F.lower(F.regexp_extract(text, rule, 1)), F.lit(""))
    host = part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")
    return {
        "markup": part(html, r"(?i)<html\b[^<>]*\blang\s*=\s*[\"']?([A-Za-z]{2})"),
        "suffixes": [part(url, r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)"), F.nullif(F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lit(""))],
        "host": host,
        "domain": F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")),
    }


def page_text(html: Column) -> Column:
    """Text of a page: without scripts, styles and comments (to the end if they are not closed) and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    return F.regexp_replace(bare, r"<[^<>]*+>", " ")
