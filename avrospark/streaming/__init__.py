"""Structured Streaming over Avro: folders of container files, and payload columns of any stream."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.payload import avro_decode
from ..schema.load import whole
from ..schema.model import parse_schema
from ..sources.files import register

__all__ = ["decode_stream", "read_stream", "write_stream"]


def read_stream(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """New container files of a folder, as a stream of rows; the schema is that of the files already there."""
    return register(spark).readStream.format("avro_native").options(**{k: str(v) for k, v in options.items()}).load(path)


def decode_stream(stream: DataFrame, payload: str, writer_schema: Any, reader_schema: Any = None, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """The messages in a stream's binary column as columns, beside those that ``keep`` names. It holds no state."""
    return stream.select(*keep, avro_decode(F.col(payload), writer_schema, reader_schema).alias("message")).select(*keep, "message.*")


def write_stream(stream: DataFrame, path: str, checkpoint: str, schema: Any = None, **options: Any) -> DataStreamWriter:
    """A writer of container files, to be started: one file a task and batch; a batch that is run again replaces its files."""
    register(stream.sparkSession)
    out = stream.writeStream.format("avro_native").option("checkpointLocation", checkpoint).option("path", path).options(**{k: str(v) for k, v in options.items()})
    return out.option("avroSchema", json.dumps(whole(parse_schema(schema)))) if schema is not None else out
