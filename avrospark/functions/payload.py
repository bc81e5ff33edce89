"""Bare messages: a binary column to typed values and back."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StructType

from ..kernels.decode import Decoder, messages
from ..kernels.encode import Encoder
from ..logical import custom_reader, custom_writer, named_unions
from ..plans.resolve import needed_fields, resolve
from ..schema.load import whole
from ..schema.model import parse_schema
from ..schema.spark_types import _spark, arrow_type
from ..shared import trim


@lru_cache(maxsize=64)
def _parsed(text: str):
    return parse_schema(text)


def _text(schema: Any) -> str:
    import json

    return json.dumps(whole(parse_schema(schema)))


def avro_decode(
    col: Column,
    writer_schema: Any,
    reader_schema: Any = None,
    *,
    unicode_errors: str = "strict",
    return_record_name: bool = False,
    return_record_name_override: bool = False,
    return_named_type: bool = False,
    return_named_type_override: bool = False,
) -> Column:
    """The value of each message, in the shape of ``reader_schema`` (default: the writer's). Only fields that the reader takes are decoded.

    Unions of several branches always come with the branch's name. ``return_record_name`` gives it for a record beside null too,
    ``return_named_type`` for any named type beside null (the record options are then ignored); an override takes it away again, as such a
    union has one named branch only."""
    ws = parse_schema(writer_schema)
    rs = parse_schema(reader_schema) if reader_schema is not None else None
    fields = None
    if rs is not None and rs.json() != ws.json():
        fields = needed_fields(ws, rs)
    text = _text(writer_schema)
    kind = Decoder(ws, fields).type()
    boxed = not pa.types.is_struct(kind)

    def decode(column: pa.Array) -> pa.Array:
        got = messages(column, Decoder(_parsed(text), fields, unicode_errors))
        trim(column.nbytes)
        return pa.StructArray.from_arrays([got], names=["value"]) if boxed else got

    spark_kind = _spark(pa.struct([("value", kind)]) if boxed else kind)
    assert isinstance(spark_kind, StructType)
    out = arrow_udf(decode, spark_kind)(col)
    out = out.getField("value") if boxed else out
    out = custom_reader(out, ws)
    out = resolve(out, ws, rs) if rs is not None else out
    named = return_named_type and not return_named_type_override
    return named_unions(out, rs or ws, records=return_record_name and not return_record_name_override and not return_named_type, named=named)


def avro_encode(col: Column, schema: Any, *, strict: bool = False, strict_allow_default: bool = False) -> Column:
    """The message of each value. Struct columns are matched by field name; what they lack comes from defaults or is null."""
    text = _text(schema)
    arrow_type(parse_schema(schema))

    def encode(column: pa.Array) -> pa.Array:
        out = Encoder(_parsed(text), strict, strict_allow_default).messages(column)
        trim(column.nbytes)
        return out

    return arrow_udf(encode, BinaryType())(custom_writer(col, _parsed(text)))
