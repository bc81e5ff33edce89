"""Blocks as rows: copying, transcoding and decoding them without a driver's loop."""

from __future__ import annotations

import uuid
from typing import Any

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.codecs import CODECS, compress, decompress
from ..kernels.container import decode_some, header_bytes, new_sync
from ..kernels.decode import Decoder
from ..kernels.literal import zigzag
from ..plans.resolve import needed_fields, resolve
from ..schema.canonical import canonical_form
from ..schema.model import Record, parse_schema
from ..logical import READERS, custom_reader
from ..sources import places
from ..sources.datasource import table_type
from ..sources.files import kept, register


def read_blocks(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """path, offset, size, num_records, codec, schema and data (compressed) of every block; path and offset tell one from the others."""
    return register(spark).read.format("avro_blocks").options(**{k: str(v) for k, v in options.items()}).load(path)


def transcode(blocks: DataFrame, codec: str, level: int | None = None) -> DataFrame:
    """Blocks recompressed; records are not decoded."""
    if codec not in CODECS:
        raise ValueError(f"no codec is called {codec}")
    at, old = blocks.columns.index("data"), blocks.columns.index("codec")

    def run(batches):
        for b in batches:
            data = [compress(codec, decompress(c, d), level) for c, d in zip(b.column(old).to_pylist(), b.column(at).to_pylist(), strict=True)]
            cols = list(b.columns)
            cols[at], cols[old] = pa.array(data, pa.binary()), pa.array([codec] * len(data), pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return blocks.mapInArrow(run, blocks.schema)


def write_blocks(blocks: DataFrame, path: str, schema: Any = None) -> DataFrame:
    """Writes blocks to new files, one a task, in the order of their files and offsets; all must have one schema in canonical form
    and one codec. Returns (file, blocks). Tasks write hidden files; once all are done, those of the successful attempts get their names."""
    job, asked = uuid.uuid4().hex, canonical_form(schema) if schema is not None else None

    def run(batches):
        f = known = None
        n, sync = 0, new_sync()
        hidden = places.join(path, f".{job}-{uuid.uuid4().hex}.tmp")
        try:
            for b in batches:
                for text, codec, count, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if f is None:
                        places.make(path)
                        f, known = places.create(hidden), (canonical_form(text), codec)
                        f.write(header_bytes(parse_schema(text), codec, sync))
                        texts = {text}
                    elif codec != known[1] or text not in texts and canonical_form(text) != known[0]:
                        raise ValueError("blocks of one file must have one schema and one codec")
                    texts.add(text)
                    f.write(zigzag(count) + zigzag(len(data)) + data + sync)
                    n += 1
        finally:
            if f is not None:
                f.close()
        if f is not None:
            yield pa.RecordBatch.from_pylist([{"file": hidden, "blocks": n, "schema": known[0], "codec": known[1]}], schema=pa.schema([("file", pa.string()), ("blocks", pa.int64()), ("schema", pa.string()), ("codec", pa.string())]))

    done, out = [], []
    try:
        done = blocks.sortWithinPartitions("path", "offset").select("schema", "codec", "num_records", "data").mapInArrow(run, "file string, blocks long, schema string, codec string").collect()  # a row a task
        if len({(r["schema"], r["codec"]) for r in done}) > 1:
            raise ValueError("blocks of one file must have one schema and one codec")
        if asked is not None and any(r["schema"] != asked for r in done):
            raise ValueError("the blocks have another schema")
        for k, r in enumerate(done):
            out.append((places.join(path, f"part-{k:05d}-{job}.avro"), r["blocks"]))
            places.move(r["file"], out[-1][0])
    finally:
        if places.exists(path):
            system, inner = places.at(path)
            for x in system.get_file_info(fs.FileSelector(inner)):
                if x.base_name.startswith(f".{job}-"):  # of attempts that failed
                    system.delete_file(x.path)
    return blocks.sparkSession.createDataFrame(out, "file string, blocks long")


def explode_blocks(blocks: DataFrame, writer_schema: Any, reader_schema: Any = None) -> DataFrame:
    """The records of blocks of one writer's schema, as rows."""
    ws = parse_schema(writer_schema)
    rs = parse_schema(reader_schema) if reader_schema is not None else None
    fields = needed_fields(ws, rs) if rs is not None else None
    text = ws.text()

    def run(batches):
        decoder = Decoder(parse_schema(text), fields)
        for b in batches:
            found = ((n.as_py(), decompress(c.as_py(), d.as_py())) for n, c, d in zip(*b.columns, strict=True))
            for got in decode_some(found, decoder):
                yield pa.RecordBatch.from_struct_array(got if pa.types.is_struct(got.type) else pa.StructArray.from_arrays([got], names=["value"]))

    df = blocks.select("num_records", "codec", "data").mapInArrow(run, table_type(ws, fields))
    if rs is None and not READERS:
        return df
    record = isinstance(ws.get(ws.root), Record)
    made = custom_reader(F.struct(*df.columns) if record else F.col("value"), kept(ws, df.columns))
    out = df.select((resolve(made, ws, rs) if rs is not None else made).alias("value"))
    return out.select("value.*") if isinstance((rs or ws).get((rs or ws).root), Record) else out
