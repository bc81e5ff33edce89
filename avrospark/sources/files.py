"""Reading and writing container files as DataFrames."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from dataclasses import replace
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.container import is_avro_bytes, open_file, read_header
from ..functions.validation import avro_errors
from ..logical import READERS, custom_reader, custom_writer, named_unions
from ..plans.resolve import needed_fields, resolve
from ..schema.load import whole
from ..schema.model import AvroSchema, Record, parse_schema
from ..schema.spark_types import from_spark_type
from .datasource import AvroSource, BlocksSource, list_files
from .places import exists, found


def register(spark: SparkSession) -> SparkSession:
    """Makes ``avro_native`` and ``avro_blocks`` known to a session."""
    spark.dataSource.register(AvroSource)
    spark.dataSource.register(BlocksSource)
    return spark


def avro_metadata(path: str) -> dict[str, bytes]:
    with open_file(list_files(path)[0]) as f:
        return read_header(f).metadata


def avro_schema(path: str) -> Any:
    """The writer's schema of a file, as JSON."""
    return json.loads(avro_metadata(path)["avro.schema"])


def is_avro(source: str | bytes) -> bool:
    """Whether a file, or bytes, begin like a container file."""
    if isinstance(source, (bytes, bytearray)):
        return is_avro_bytes(source)
    with open_file(source) as f:
        return is_avro_bytes(f.read(4))


def are_avro(spark: SparkSession, path: str) -> DataFrame:
    """(path, is_avro) of many files."""
    return spark.read.format("binaryFile").load(path).select("path", (F.substring("content", 1, 4) == F.lit(b"Obj\x01")).alias("is_avro"))


#: Files whose headers the driver reads itself; more are read by tasks.
FEW_FILES = 64


def _by_schema(spark: SparkSession, files: list[tuple[str, int]]) -> dict[str, list[tuple[str, int]]]:
    """Files by the text of their schema. Of many files, tasks read the headers, and each schema comes once from each task."""
    groups: dict[str, list[tuple[str, int]]] = defaultdict(list)
    if len(files) <= FEW_FILES:
        for name, size in files:
            with open_file(name) as f:
                groups[read_header(f).metadata["avro.schema"].decode()].append((name, size))
        return groups

    def heads(batches):
        seen: set[str] = set()
        for b in batches:
            rows = []
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_file(name) as f:
                    text = read_header(f).metadata["avro.schema"].decode()
                key = hashlib.md5(text.encode()).hexdigest()
                rows.append({"name": name, "size": size, "key": key, "text": None if key in seen else text})
                seen.add(key)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("name", pa.string()), ("size", pa.int64()), ("key", pa.string()), ("text", pa.string())]))

    tasks = min(len(files) // FEW_FILES + 1, 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame(files, "name string, size long").repartition(tasks).mapInArrow(heads, "name string, size long, key string, text string").collect()
    texts = {r["key"]: r["text"] for r in rows if r["text"] is not None}
    for r in sorted(rows, key=lambda r: r["name"]):
        groups[texts[r["key"]]].append((r["name"], r["size"]))
    return groups


def read_avro(spark: SparkSession, path: str, reader_schema: Any = None, **options: Any) -> DataFrame:
    """Rows of container files. With a reader's schema, only fields that it takes are decoded, and the rest of resolution is
    a projection. Files may have different writer's schemas: each is resolved on its own. Registered custom logical types are read, and
    ``return_record_name``, ``return_named_type`` and their overrides are as for ``avro_decode``."""
    register(spark)
    lenient = reader_schema is not None
    names = {k: bool(options.pop(k, False)) for k in ("return_record_name", "return_record_name_override", "return_named_type", "return_named_type_override")}
    named = names["return_named_type"] and not names["return_named_type_override"]
    records = names["return_record_name"] and not names["return_record_name_override"] and not names["return_named_type"]
    groups = _by_schema(spark, [(f, n) for f, n, _ in found(path)])
    if not groups:
        raise FileNotFoundError(f"no files at {path}")
    rs = parse_schema(reader_schema) if reader_schema is not None else None
    frames = []
    for text, files in groups.items():
        ws = parse_schema(json.loads(text), ignore_default_errors=lenient)
        scan = spark.read.format("avro_native").option("files", json.dumps(files)).option("minPartitions", spark.sparkContext.defaultParallelism).options(**{k: str(v) for k, v in options.items()})
        if lenient:
            scan = scan.option("ignoreBadWriterDefaults", "true")
        fields = needed_fields(ws, rs) if rs is not None else None
        if fields:
            scan = scan.option("fields", json.dumps(fields))
        df = scan.load()
        custom = bool(READERS)
        if rs is None and not (custom or named or records):
            frames.append(df)
            continue
        whole_ = F.struct(*(F.col(f"`{c}`") for c in df.columns)) if isinstance(ws.get(ws.root), Record) else F.col("value")
        made = custom_reader(whole_, kept(ws, df.columns)) if custom else whole_
        made = named_unions(resolve(made, ws, rs) if rs is not None else made, rs or ws, records=records, named=named)
        out = df.select(made.alias("value"))
        frames.append(out.select("value.*") if isinstance((rs or ws).get((rs or ws).root), Record) else out)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def kept(schema: AvroSchema, columns: list[str]) -> AvroSchema:
    """A record's schema without the fields that were not decoded."""
    root = schema.get(schema.root)
    if not isinstance(root, Record) or len(columns) == len(root.fields):
        return schema
    return AvroSchema(replace(root, fields=tuple(f for f in root.fields if f.name in columns)), schema.names)


def write_avro(df: DataFrame, path: str, schema: Any = None, *, mode: str = "errorifexists", validator: bool = False, **options: Any) -> None:
    """Writes container files: ``codec``, ``codecLevel``, ``syncInterval``, ``syncMarker`` (32 hex digits), ``metadata.<key>``, ``strict``,
    ``strictAllowDefault``. ``validator`` fails at the first row that is not data of the schema. Custom logical types are written."""
    register(df.sparkSession)
    if mode == "errorifexists":
        if exists(path) and list_files(path):
            raise FileExistsError(path)
        mode = "append"
    if schema is not None:
        parsed = parse_schema(schema)
        record = isinstance(parsed.get(parsed.root), Record)
        row = F.struct(*(F.col(f"`{c}`") for c in df.columns)) if record else F.col(f"`{df.columns[0]}`")
        made = custom_writer(row, parsed)
        if made is not row:
            df = df.select(made.alias("r")).select("r.*") if record else df.select(made.alias(df.columns[0]))
    if validator:
        text = whole(parse_schema(schema)) if schema is not None else from_spark_type(df.schema)
        row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        wrong = avro_errors(row, df.schema, text)
        df = df.select(F.when(F.size(wrong) == 0, row).otherwise(F.raise_error(F.concat(F.lit("not data of the schema: "), F.to_json(wrong)))).alias("r")).select("r.*")
    out = df.write.format("avro_native").mode(mode).options(**{k: str(v) for k, v in options.items()})
    if schema is not None:
        out = out.option("avroSchema", json.dumps(whole(parse_schema(schema))))
    out.save(path)
