"""Avro schemas on the driver: parsing, loading, canonical forms and Spark types."""

from .canonical import FINGERPRINTS, canonical_form, fingerprint, rabin
from .load import FlatDirectory, SchemaRepositoryError, expand_schema, load_schema, load_schema_ordered
from .model import (
    MISSING,
    Array,
    AvroSchema,
    Enum,
    Field,
    Fixed,
    Map,
    Primitive,
    Record,
    Ref,
    SchemaParseException,
    SchemaResolutionError,
    Union,
    UnknownType,
    fullname,
    parse_schema,
)
from .spark_types import from_spark_type, to_spark_type

__all__ = [name for name in dir() if name[0] != "_"]
