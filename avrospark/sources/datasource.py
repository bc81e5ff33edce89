"""Python data sources: ``avro_native`` (scan, sink, streams of both kinds) and ``avro_blocks``.

The driver lists files; ranges of about ``splitBytes`` bytes of them are the partitions. A task seeks the first sync marker
of its range, reads blocks as long as the marker before them begins inside it, decompresses them and decodes them lane by lane;
``fields`` prunes the columns inside the decoder. The sinks write one file a task under a temporary name, and the driver
renames the files of successful tasks when the job commits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..kernels.codecs import decompress
from ..kernels.container import SYNC_SIZE, Header, block_bytes, blocks, cut, decode_some, header_bytes, new_sync, open_file, read_header
from ..kernels.decode import Decoder
from ..kernels.encode import Encoder
from ..kernels.runs import pieces
from ..schema.model import AvroSchema, Record, parse_schema
from ..schema.spark_types import _spark, from_spark_type
from ..shared import trim
from . import places

SPLIT_BYTES = 32 << 20
LEAST_SPLIT = 1 << 19


def plain(options: Mapping) -> dict:
    """Options by their names in lower case, as Spark hands them over."""
    return {k.lower(): v for k, v in options.items()}


def list_files(path: str) -> list[str]:
    return [f for f, _, _ in places.found(path)]


def sized_files(options: dict) -> list[tuple[str, int]]:
    if "files" in options:
        return [(f, n) for f, n in json.loads(options["files"])]
    return [(f, n) for f, n, _ in places.found(options["path"])]


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: (path, start, end)."""

    files: list


def cut_ranges(files: list[tuple[str, int]], split: int, least: int = 1) -> list[Ranges]:
    """Ranges of about ``split`` bytes, smaller if there would be fewer than ``least`` of them; small files share one."""
    total = sum(n for _, n in files)
    split = max(1, min(split, max(total // max(1, least), LEAST_SPLIT)))
    out, some, size = [], [], 0
    for path, n in files:
        at = 0
        while True:
            end = min(n, at + split - size)
            some.append((path, at, end if end < n else 1 << 62))
            size += end - at
            at = end
            if size >= split:
                out.append(Ranges(some))
                some, size = [], 0
            if at >= n:
                break
    return [*out, Ranges(some)] if some else out


def decode_ranges(ranges: Ranges, fields: list[str] | None, errors: str, verify: bool, lenient: bool) -> Iterator[pa.RecordBatch]:
    for path, start, end in ranges.files:
        with open_file(path) as f:
            header = read_header(f)
            decoder = Decoder(header.schema(lenient), fields, errors)
            found = ((b.count, decompress(header.codec, raw, verify)) for b, raw in blocks(f, header, start, end))
            for got in decode_some(found, decoder):
                got = got if pa.types.is_struct(got.type) else pa.StructArray.from_arrays([got], names=["value"])
                whole = pa.RecordBatch.from_struct_array(got)
                for i in range(0, whole.num_rows, 65536):
                    yield whole.slice(i, 65536)
                del got, whole
                trim()


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name.lower(), default)).lower() == "true"


class _Common:
    options: dict

    def setup(self) -> None:
        o = self.options
        self.fields = json.loads(o["fields"]) if "fields" in o else None
        self.errors = o.get("handleunicodeerrors", "strict")
        self.verify, self.lenient = _flag(o, "verifyCrc", True), _flag(o, "ignoreBadWriterDefaults", False)
        self.split, self.least = int(o.get("splitbytes", SPLIT_BYTES)), int(o.get("minpartitions", 1))


class AvroReader(DataSourceReader, _Common):
    def __init__(self, options: dict):
        self.options = plain(options)
        self.setup()

    def partitions(self) -> list[Ranges]:
        return cut_ranges(sized_files(self.options), self.split, self.least) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from decode_ranges(partition, self.fields, self.errors, self.verify, self.lenient)


class AvroStreamReader(DataSourceStreamReader, _Common):
    """A folder as a stream. An offset is the latest time of a file that was seen, and the names of the files of that time; files
    are taken in the order of their times, which a rename sets anew."""

    def __init__(self, options: dict):
        self.options = plain(options)
        self.setup()

    def initialOffset(self) -> dict:
        return {"time": -1, "names": []}

    def latestOffset(self) -> dict:
        files = [(t, f) for f, _, t in places.found(self.options["path"])]
        last = max((t for t, _ in files), default=-1)
        return {"time": last, "names": sorted(f for t, f in files if t == last)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        def seen(t: int, f: str, offset: dict) -> bool:
            return t < offset["time"] or t == offset["time"] and f in offset["names"]

        return cut_ranges([(f, n) for f, n, t in places.found(self.options["path"]) if seen(t, f, end) and not seen(t, f, start)], self.split, self.least)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from decode_ranges(partition, self.fields, self.errors, self.verify, self.lenient)


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None


class _Sink:
    """What batch and stream sinks share."""

    def prepare(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.options, self.overwrite = plain(options), overwrite
        o = self.options
        self.path = o["path"]
        given = o.get("avroschema")
        made = parse_schema(given) if given else parse_schema(from_spark_type(schema, o.get("recordname", "topLevelRecord"), o.get("recordnamespace", "")))
        self.codec, self.level = o.get("codec", "null"), int(o["codeclevel"]) if "codeclevel" in o else None
        before = [] if overwrite or not places.exists(self.path) else list_files(self.path)
        if before:  # what is appended takes the schema and codec of what is there
            with open_file(before[0]) as f:
                header = read_header(f)
            made, self.codec = header.schema(), header.codec
        from ..schema.load import whole

        self.schema_text = json.dumps(whole(made))
        header_bytes(made, self.codec, b"\0" * SYNC_SIZE)  # an unknown codec fails here
        self.interval = int(o.get("syncinterval", 16000))
        self.marker = bytes.fromhex(o["syncmarker"]) if "syncmarker" in o else None
        if self.marker is not None and len(self.marker) != SYNC_SIZE:
            raise ValueError(f"a sync marker has {SYNC_SIZE} bytes")
        self.metadata = {k[len("metadata.") :]: v for k, v in o.items() if k.startswith("metadata.")}
        self.strict, self.allow = _flag(o, "strict", False), _flag(o, "strictAllowDefault", False)
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        schema, file = parse_schema(self.schema_text), None
        encoder, sync = Encoder(schema, self.strict, self.allow), self.marker or new_sync()
        places.make(self.path)
        temporary = places.join(self.path, f".{self.job}-{uuid.uuid4().hex}.tmp")
        try:
            for batch in iterator:
                if file is None:
                    file = places.create(temporary)
                    file.write(header_bytes(schema, self.codec, sync, self.metadata))
                arr = batch.to_struct_array() if hasattr(batch, "to_struct_array") else pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
                if not isinstance(schema.get(schema.root), Record):
                    arr = batch.column(0)
                for piece in pieces(arr):
                    for count, body in cut(encoder.rows(piece), self.interval):
                        file.write(block_bytes(count, body, self.codec, sync, self.level))
        finally:
            if file is not None:
                file.close()
        trim()
        return Written(temporary if file is not None else None)

    def sweep(self) -> None:
        """What attempts that did not succeed have left."""
        system, inner = places.at(self.path)
        import pyarrow.fs as fs

        for x in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if x.base_name.startswith(f".{self.job}-"):
                system.delete_file(x.path)


class AvroWriter(_Sink, DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.prepare(options, schema, overwrite)

    def commit(self, messages: list[Written | None]) -> None:
        places.make(self.path)
        # an overwrite hides the old files before the new ones appear, so that no reader sees both
        old = [(f, places.join(f.rpartition("/")[0], f".{self.job}-{k}.old")) for k, f in enumerate(list_files(self.path) if self.overwrite else [])]
        for f, hidden in old:
            places.move(f, hidden)
        found = [m.temporary for m in messages if m is not None and m.temporary]
        if not found:
            found = [places.join(self.path, f".{self.job}-empty.tmp")]
            with places.create(found[0]) as f:
                f.write(header_bytes(parse_schema(self.schema_text), self.codec, self.marker or new_sync(), self.metadata))
        for k, f in enumerate(found):
            places.move(f, places.join(self.path, f"part-{k:05d}-{self.job}.avro"))
        for _, hidden in old:
            places.remove(hidden)
        self.sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self.sweep()


class AvroStreamWriter(_Sink, DataSourceStreamArrowWriter):
    """Every batch's files bear its number; a batch that is run again takes the place of its first run."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.prepare(options, schema, overwrite)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        for f in list_files(self.path) if places.exists(self.path) else []:
            if f.rpartition("/")[2].startswith(f"batch-{batchId:010d}-"):
                places.remove(f)
        for k, m in enumerate(x for x in messages if x is not None and x.temporary):
            places.move(m.temporary, places.join(self.path, f"batch-{batchId:010d}-{k:05d}.avro"))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        for m in messages:
            if m is not None and m.temporary:
                places.remove(m.temporary)


def first_header(options: dict) -> Header:
    files = sized_files(options)
    if not files:
        raise FileNotFoundError(f"no files at {options.get('path')}")
    with open_file(files[0][0]) as f:
        return read_header(f)


def table_type(schema: AvroSchema, fields: list[str] | None) -> StructType:
    kind = Decoder(schema, fields).type()
    made = _spark(kind if pa.types.is_struct(kind) else pa.struct([("value", kind)]))
    assert isinstance(made, StructType)
    return made


class AvroSource(DataSource):
    """``avro_native``: rows of container files in the shape of their writer's schema. ``read_avro`` adds a reader's schema."""

    @classmethod
    def name(cls) -> str:
        return "avro_native"

    def schema(self) -> StructType:
        o = plain(self.options)
        return table_type(first_header(o).schema(_flag(o, "ignoreBadWriterDefaults", False)), json.loads(o["fields"]) if "fields" in o else None)

    def reader(self, schema: StructType) -> AvroReader:
        return AvroReader(self._with_fields(schema))

    def streamReader(self, schema: StructType) -> AvroStreamReader:
        return AvroStreamReader(self._with_fields(schema))

    def _with_fields(self, schema: StructType) -> dict:
        """A schema that the user gives prunes: only its columns are decoded."""
        o = plain(self.options)
        return o if "fields" in o or schema.names == ["value"] else {**o, "fields": json.dumps(schema.names)}

    def writer(self, schema: StructType, overwrite: bool) -> AvroWriter:
        return AvroWriter(plain(self.options), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> AvroStreamWriter:
        return AvroStreamWriter(plain(self.options), schema, overwrite)


BLOCK_TYPE = "path string, offset long, size long, num_records long, codec string, schema string, data binary"


class BlocksReader(DataSourceReader, _Common):
    def __init__(self, options: dict):
        self.options = plain(options)
        self.setup()

    def partitions(self) -> list[Ranges]:
        return cut_ranges(sized_files(self.options), self.split, self.least) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, start, end in partition.files:
            with open_file(path) as f:
                header = read_header(f)
                text = header.metadata["avro.schema"].decode()
                for b, raw in blocks(f, header, start, end):
                    yield (path, b.offset, b.size, b.count, header.codec, text, raw)


class BlocksSource(DataSource):
    """``avro_blocks``: one row a block, its data still compressed."""

    @classmethod
    def name(cls) -> str:
        return "avro_blocks"

    def schema(self) -> str:
        return BLOCK_TYPE

    def reader(self, schema: StructType) -> BlocksReader:
        return BlocksReader(plain(self.options))
