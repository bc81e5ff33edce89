"""Bytes: golden values, round trips of random data, codecs, block cuts and broken input."""

import datetime as dt
import io
import json
import lzma
import struct
import tracemalloc
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from avrospark.kernels import runs
from avrospark.kernels.codecs import CODECS, compress, decompress
from avrospark.kernels.container import block_bytes, blocks, cut, decode_blocks, header_bytes, read_header
from avrospark.kernels.decode import Decoder, messages
from avrospark.kernels.encode import Encoder
from avrospark.schema import parse_schema
from avrospark.schema.spark_types import arrow_type
from avrospark.sources.datasource import Ranges, decode_ranges


def encoded(schema, values):
    s = parse_schema(schema)
    return [x.hex().upper() for x in Encoder(s).rows(pa.array(values, arrow_type(s))).binary().to_pylist()]


def back(schema, raws, reader=None):
    return messages(pa.array(raws, pa.binary()), Decoder(parse_schema(schema))).to_pylist()


# Fixed values of the format.
LONGS = {0: "00", -1: "01", 1: "02", -2: "03", 2: "04", 2147483647: "FEFFFFFF0F", -2147483648: "FFFFFFFF0F", 9223372036854775807: "FEFFFFFFFFFFFFFFFF01", -9223372036854775808: "FFFFFFFFFFFFFFFFFF01"}
DECIMALS = {"0.0": "0200", "0.1": "0264", "-0.1": "029C", "0.2": "0400C8", "-0.2": "04FF38", "2.55": "0409F6", "-2.55": "04F60A", "2.90": "040B54", "-2.90": "04F4AC", "123.456": "0601E240"}


def test_golden_longs():
    assert encoded("long", list(LONGS)) == list(LONGS.values())
    assert back("long", [bytes.fromhex(x) for x in LONGS.values()]) == list(LONGS)


def test_golden_decimals():
    s = {"type": "bytes", "logicalType": "decimal", "precision": 20, "scale": 3}
    assert encoded(s, [Decimal(x) for x in DECIMALS]) == list(DECIMALS.values())
    assert back(s, [bytes.fromhex(x) for x in DECIMALS.values()]) == [Decimal(x) for x in DECIMALS]


def test_golden_others():
    assert encoded("string", ["foo", ""]) == ["06666F6F", "00"]
    assert encoded("boolean", [True, False]) == ["01", "00"]
    assert encoded("double", [1.5]) == [struct.pack("<d", 1.5).hex().upper()]
    assert encoded({"type": "array", "items": "long"}, [[3, 27], []]) == ["04063600", "00"]
    assert encoded({"type": "map", "values": "int"}, [[("a", 1)]]) == ["0202610200"]
    assert encoded(["string", "null"], [None, "a"]) == ["02", "000261"]
    assert back("boolean", [b"\x07"]) == [True]
    assert back({"type": "array", "items": "long"}, [bytes.fromhex("03040636" + "00")]) == [[3, 27]]  # a block with its size


def test_duplicate_map_keys_keep_the_last():
    assert back({"type": "map", "values": "int"}, [bytes.fromhex("04026102026104" + "00")]) == [[("a", 2)]]


def test_skipping_uses_block_sizes_and_pruning_keeps_the_rest():
    s = {"type": "record", "name": "R", "fields": [{"name": "a", "type": {"type": "array", "items": "string"}}, {"name": "m", "type": {"type": "map", "values": "long"}}, {"name": "u", "type": ["null", "string", "int"]}, {"name": "z", "type": "int"}]}
    raw = bytes.fromhex("03" + "08" + "0261" + "0262" + "00" + "02" + "0261" + "02" + "00" + "04" + "06" + "0A")
    assert messages(pa.array([raw]), Decoder(parse_schema(s), {"z"})).to_pylist() == [{"z": 5}]


ALL = {
    "type": "record", "name": "n.R", "fields": [
        {"name": "i", "type": "int"}, {"name": "l", "type": ["null", "long"]}, {"name": "s", "type": "string"}, {"name": "d", "type": ["double", "null"]}, {"name": "b", "type": "bytes"},
        {"name": "f", "type": {"type": "fixed", "name": "F", "size": 2}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}, {"name": "a", "type": {"type": "array", "items": ["null", "string"]}},
        {"name": "m", "type": {"type": "map", "values": {"type": "array", "items": "float"}}}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "y", "type": {"type": "int", "logicalType": "date"}},
        {"name": "x", "type": {"type": "fixed", "name": "X", "size": 9, "logicalType": "decimal", "precision": 20, "scale": 2}}, {"name": "r", "type": ["null", {"type": "record", "name": "S", "fields": [{"name": "q", "type": "boolean"}]}]},
    ],
}
row = st.fixed_dictionaries(
    {
        "i": st.integers(-(2**31), 2**31 - 1), "l": st.none() | st.integers(-(2**63), 2**63 - 1), "s": st.text(st.characters(exclude_categories=["Cs"])), "d": st.none() | st.floats(allow_nan=False), "b": st.binary(), "f": st.binary(min_size=2, max_size=2), "e": st.sampled_from("AB"),
        "a": st.lists(st.none() | st.text(st.characters(exclude_categories=["Cs"]), max_size=3), max_size=4), "m": st.dictionaries(st.text("abc", max_size=2), st.lists(st.floats(width=32, allow_nan=False), max_size=3), max_size=3).map(lambda d: list(d.items())),
        "t": st.integers(-(10**13), 10**13).map(lambda n: dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=n)), "y": st.dates(), "x": st.integers(-(10**20) + 1, 10**20 - 1).map(lambda n: Decimal(n).scaleb(-2)), "r": st.none() | st.fixed_dictionaries({"q": st.booleans()}),
    }
)


@settings(max_examples=60, deadline=None)
@given(st.lists(row, max_size=8))
def test_random_rows_survive(rows):
    s = parse_schema(ALL)
    arr = pa.array(rows, arrow_type(s))
    made = Encoder(s).rows(arr)
    assert messages(made.binary(), Decoder(s)).equals(arr)
    some = list(cut(made, 40))
    assert sum(n for n, _ in some) == len(rows)
    got = list(decode_blocks([b for _, b in some], [n for n, _ in some], Decoder(s)))
    assert (pa.concat_arrays(got) if got else arr[:0]).equals(arr)


@pytest.mark.parametrize("codec", CODECS)
@pytest.mark.parametrize("data", [b"", b"x", b"abc" * 5000])
def test_codecs(codec, data):
    assert decompress(codec, compress(codec, data)) == data


def test_codec_edges():
    with pytest.raises(ValueError, match="no codec is called"):
        compress("nope", b"")
    with pytest.raises(ValueError, match="no codec is called"):
        decompress("nope", b"")
    bad = compress("snappy", b"abc")[:-1] + b"\0"
    with pytest.raises(ValueError, match="checksum"):
        decompress("snappy", bad)
    assert decompress("snappy", bad, verify=False) == b"abc"
    assert decompress("deflate", compress("deflate", b"abc") + b"\1\2\3") == b"abc"


def test_block_layout():
    """Blocks of known data lie where the cut rule puts them."""
    s = parse_schema({"type": "record", "name": "R", "fields": [{"name": "nullable_str", "type": ["string", "null"]}, {"name": "str_field", "type": "string"}, {"name": "int_field", "type": "int"}]})
    rows = [{"nullable_str": None if i % 3 == 0 else f"{i}-{i}", "str_field": f"{i} {i} {i}", "int_field": i * 10} for i in range(2000)]
    made = Encoder(s).rows(pa.array(rows, arrow_type(s)))
    sizes = [(n, len(b), len(block_bytes(n, b, "null", b"\0" * 16))) for n, b in cut(made)]
    # Records, payload bytes and bytes of each block; a record before 16000 bytes, sync marker and counts after.
    assert [(n, size) for n, _, size in sizes] == [(811, 16025), (656, 16037), (533, 13698)]
    assert [p for _, p, _ in sizes] == [16004, 16016, 13677]


def container(schema, values, codec="null"):
    s = parse_schema(schema)
    sync = b"s" * 16
    body = b"".join(block_bytes(n, b, codec, sync) for n, b in cut(Encoder(s).rows(pa.array(values, arrow_type(s))), 30))
    return header_bytes(s, codec, sync, {"k": b"v"}) + body


def read(raw):
    f = io.BytesIO(raw)
    h = read_header(f)
    return [x for b, raw in blocks(f, h) for a in decode_blocks([decompress(h.codec, raw)], [b.count], Decoder(h.schema())) for x in a.to_pylist()]


def test_broken_files():
    raw = container("string", ["a" * 20, "b" * 20, "c"])
    assert read(raw) == ["a" * 20, "b" * 20, "c"]
    assert read_header(io.BytesIO(raw)).metadata["k"] == b"v"
    with pytest.raises(ValueError, match="no container file"):
        read(b"nope" + raw[4:])
    with pytest.raises(ValueError, match="sync marker"):
        read(raw[:-1] + b"x")
    with pytest.raises(EOFError):
        read(raw[:-3])


def test_broken_messages():
    for schema, raw in (("string", b"\x08ab"), ("long", b"\xff\xff"), ("double", b"1234"), ({"type": "array", "items": "int"}, b"\x04\x02")):
        with pytest.raises((EOFError, ValueError)):
            back(schema, [raw])
    with pytest.raises(UnicodeDecodeError):
        back("string", [b"\x02\xff"])
    assert messages(pa.array([b"\x02\xff"]), Decoder(parse_schema("string"), unicode_errors="replace")).to_pylist() == ["�"]
    with pytest.raises(ValueError):
        back(["null", "int"], [b"\x04"])


def test_encoder_errors():
    for schema, values, kind in (("int", [None], pa.int32()), ({"type": "fixed", "name": "F", "size": 2}, [b"abc"], pa.binary()), ({"type": "enum", "name": "E", "symbols": ["A"]}, ["B"], pa.string()), ("int", [1 << 40], pa.int64())):
        with pytest.raises((ValueError, pa.ArrowInvalid)):
            Encoder(parse_schema(schema)).rows(pa.array(values, kind))


def test_missing_and_extra_fields():
    s = parse_schema({"type": "record", "name": "R", "fields": [{"name": "a", "type": "int"}, {"name": "b", "type": ["null", "string"], "default": None}, {"name": "c", "type": "float", "default": "nan"}]})
    arr = pa.array([{"a": 1}])
    assert np.isnan(messages(Encoder(s).rows(arr).binary(), Decoder(s)).to_pylist()[0]["c"])
    Encoder(s, strict_allow_default=True).rows(arr)
    with pytest.raises(ValueError, match="lacks"):
        Encoder(s, strict=True).rows(arr)
    with pytest.raises(ValueError, match="no field"):
        Encoder(s, strict_allow_default=True).rows(pa.array([{"a": 1, "z": 2}]))
    with pytest.raises(ValueError, match="no value and no default"):
        Encoder(s).rows(pa.array([{"b": "x"}]))


def test_files_that_the_jvm_library_reads_and_writes(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    text = json.dumps(ALL)
    s = parse_schema(ALL)
    values = [{"i": 1, "l": None, "s": "é", "d": 2.5, "b": b"\0\1", "f": b"ab", "e": "B", "a": ["x", None], "m": [("k", [1.5])], "t": dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), "y": dt.date(2020, 1, 1), "x": Decimal("-12.34"), "r": {"q": True}}] * 7
    for codec in ("null", "deflate", "bzip2", "xz", "snappy", "zstandard"):
        path = tmp_path / f"{codec}.avro"
        path.write_bytes(container(ALL, values, codec))
        reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(str(path)), jvm.org.apache.avro.generic.GenericDatumReader())
        copy = tmp_path / f"{codec}-copy.avro"
        writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter())
        writer.setCodec(jvm.org.apache.avro.file.CodecFactory.fromString(codec))
        writer.create(jvm.org.apache.avro.Schema.Parser().parse(text), jvm.java.io.File(str(copy)))
        n = 0
        while reader.hasNext():
            writer.append(reader.next())
            n += 1
        writer.close()
        assert n == 7
        want = pa.array(values, arrow_type(s)).to_pylist()
        assert read(copy.read_bytes()) == want


def peak(run):
    """What ``run`` gives, and the most bytes of numpy and Python that it held."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_range_is_decoded_by_few_blocks_at_once(tmp_path):
    s, sync, n = parse_schema("string"), b"s" * 16, 2600
    made = Encoder(s).rows(pa.array([f"{i:0100d}" for i in range(157)]))
    (count, payload), *more = cut(made)
    assert not more
    (tmp_path / "t.avro").write_bytes(header_bytes(s, "null", sync) + block_bytes(count, payload, "null", sync) * n)
    held, most = peak(lambda: sum(b.num_rows for b in decode_ranges(Ranges([(str(tmp_path / "t.avro"), 0, 1 << 62)]), None, "strict", True, False)))
    assert held == count * n
    assert len(payload) * n > 40e6 and most < 40e6


def test_xz_dictionaries_fit_the_block():
    for data in (b"", b"abc" * 5000):
        assert lzma.LZMADecompressor(memlimit=1 << 20).decompress(compress("xz", data)) == data


def test_large_batches_of_messages_take_little_more_than_themselves():
    s = parse_schema({"type": "record", "name": "R", "fields": [{"name": "i", "type": "long"}, {"name": "turns", "type": {"type": "array", "items": {"type": "record", "name": "T", "fields": [{"name": "t", "type": ["null", "string"]}]}}}]})
    rows = [{"i": i, "turns": [{"t": f"{i} {k}" * 60} if k else {"t": None} for k in range(i % 7)]} for i in range(3000)] * 8
    arr = pa.array(rows, arrow_type(s))
    made, most = peak(lambda: Encoder(s).messages(arr))
    assert made.nbytes > 15e6 and most < 2 * made.nbytes
    back, most = peak(lambda: messages(made, Decoder(s)))
    assert back.equals(arr) and most < 2 * made.nbytes


@pytest.mark.parametrize("piece", [1, 50, 1 << 10])
def test_pieces_change_nothing(piece, monkeypatch):
    item = {"type": "record", "name": "T", "fields": [{"name": "s", "type": ["null", "string"]}, {"name": "f", "type": {"type": "array", "items": "double"}}]}
    s = parse_schema({"type": "record", "name": "R", "fields": [{"name": "m", "type": {"type": "map", "values": item}}, {"name": "u", "type": ["null", "long", "string"]}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}]})
    kind = arrow_type(s)
    rows = [{"m": [(f"k{k}", {"s": "x" * (i * k) if k % 3 else None, "f": [0.5] * k}) for k in range(i % 5)], "u": {"tag": ("null", "long", "string")[i % 3], "member0": None, "member1": i if i % 3 == 1 else None, "member2": "y" * i if i % 3 == 2 else None}, "d": Decimal(i - 50) / 100} for i in range(200)]
    arr = pa.array(rows, kind)
    want = Encoder(s).rows(arr).binary()
    monkeypatch.setattr(runs, "PIECE", piece)
    monkeypatch.setattr(runs, "STEP", 100)
    monkeypatch.setattr(runs, "LONG", 150)
    assert Encoder(s).messages(arr).equals(want)
    assert Encoder(s).messages(arr.slice(7, 90)).equals(want.slice(7, 90))
    some = pa.array([None if i % 11 == 3 else x for i, x in enumerate(want.to_pylist())], pa.binary())
    assert messages(some, Decoder(s)).to_pylist() == [None if i % 11 == 3 else x for i, x in enumerate(arr.to_pylist())]
