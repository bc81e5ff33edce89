"""Schemas held in string columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..schema.canonical import FINGERPRINTS, OTHER_NAMES, RABIN, canonical_form, rabin


def _canonical(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else canonical_form(t) for t in texts.to_pylist()], pa.string())


def _rabin(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else rabin(t.encode()) for t in texts.to_pylist()], pa.string())


def avro_canonical(col: Column) -> Column:
    """The parsing canonical form of each schema."""
    return arrow_udf(_canonical, "string")(col)


def avro_fingerprint(col: Column, algorithm: str = RABIN) -> Column:
    """Fingerprints of canonical forms: built-in functions where Spark has the algorithm."""
    if algorithm not in FINGERPRINTS:
        raise ValueError(f"Unknown schema fingerprint algorithm {algorithm}")
    name = OTHER_NAMES.get(algorithm, algorithm)
    if name == RABIN:
        return arrow_udf(_rabin, "string")(col)
    raw = col.cast("binary")
    if name == "md5":
        return F.md5(raw)
    if name == "sha1":
        return F.sha1(raw)
    if name in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(raw, int(name[3:]))

    def other(texts: pa.Array) -> pa.Array:
        import hashlib

        return pa.array([None if t is None else hashlib.new(name, t.encode()).hexdigest() for t in texts.to_pylist()], pa.string())

    return arrow_udf(other, "string")(col)
