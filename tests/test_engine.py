"""Resolution, unions, JSON, validation, sources, blocks, streams and the command line."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from avrospark import logical
from avrospark.__main__ import main
from avrospark.functions import avro_decode, avro_encode, avro_errors, avro_from_json, avro_to_json, avro_valid
from avrospark.kernels.container import blocks, read_header
from avrospark.operators import anonymize_schema, explode_blocks, generate, read_blocks, transcode, write_blocks
from avrospark.schema import SchemaResolutionError, from_spark_type, parse_schema, to_spark_type
from avrospark.sources import avro_metadata, avro_schema, is_avro, read_avro, write_avro
from avrospark.sources.datasource import cut_ranges
from avrospark.streaming import read_stream, write_stream


def rec(*fields, name="R", **more):
    return {"type": "record", "name": name, "fields": [{"name": n, "type": t, **(rest[0] if rest else {})} for n, t, *rest in fields], **more}


def read_as(spark, rows, writer, reader):
    df = spark.createDataFrame(rows, to_spark_type(writer))
    out = df.select(avro_encode(F.struct(*df.columns), writer).alias("m")).select(avro_decode("m", writer, reader).alias("r"))
    return [r["r"].asDict(recursive=True) for r in out.collect()]


@pytest.mark.parametrize(
    ("w", "r", "value", "want"),
    [
        ("int", "long", 3, 3), ("int", "double", 3, 3.0), ("long", "float", 3, 3.0), ("float", "double", 1.5, 1.5), ("string", "bytes", "é", "é".encode()), ("bytes", "string", b"ab", "ab"),
        ("int", ["null", "long"], 3, 3), (["null", "int"], ["long", "null"], None, None), (["null", "int"], "long", 4, 4), ("int", ["float", "int"], 3, {"tag": "float", "member0": 3.0, "member1": None}),
        ({"type": "array", "items": "int"}, {"type": "array", "items": "double"}, [1], [1.0]), ({"type": "map", "values": "int"}, {"type": "map", "values": "long"}, {"a": 1}, {"a": 1}),
        ({"type": "enum", "name": "x.E", "symbols": ["A", "B"]}, {"type": "enum", "name": "E", "symbols": ["A"], "default": "A"}, "B", "A"),
    ],
)
def test_resolution(spark, w, r, value, want):
    assert read_as(spark, [(value,)], rec(("f", w)), rec(("f", r))) == [{"f": want}]


def test_resolution_of_fields(spark):
    w = rec(("a", "int"), ("gone", "string"), ("old", "string"))
    r = rec(("new", "string", {"aliases": ["old"]}), ("a", "int"), ("d", {"type": "bytes"}, {"default": "ÿ"}), ("n", rec(("q", "int", {"default": 5}), name="N"), {"default": {}}))
    assert read_as(spark, [(1, "x", "y")], w, r) == [{"new": "y", "a": 1, "d": b"\xff", "n": {"q": 5}}]


def test_resolution_errors(spark):
    with pytest.raises(SchemaResolutionError, match="No default value for field b"):
        read_as(spark, [(1,)], rec(("a", "int")), rec(("b", "int")))
    for w, r in (("long", "int"), ("string", "int"), ({"type": "fixed", "name": "F", "size": 1}, {"type": "fixed", "name": "F", "size": 2}), ({"type": "array", "items": "int"}, {"type": "map", "values": "int"})):
        with pytest.raises(SchemaResolutionError):
            read_as(spark, [], rec(("a", w)), rec(("a", r)))
    # settled row by row: fails only where the branch occurs
    w, r = rec(("a", ["null", "string"])), rec(("a", ["null", "int"]))
    assert read_as(spark, [(None,)], w, r) == [{"a": None}]
    with pytest.raises(Exception, match="Schema mismatch"):
        read_as(spark, [("x",)], w, r)
    e = lambda *s: rec(("e", {"type": "enum", "name": "E", "symbols": list(s)}))
    with pytest.raises(Exception, match="is no symbol of the reader"):
        read_as(spark, [("B",)], e("A", "B"), e("A"))


def test_record_and_alias_names(spark):
    assert read_as(spark, [(1,)], rec(("a", "int"), name="x.Old"), rec(("a", "int"), name="New", aliases=["Old"])) == [{"a": 1}]
    with pytest.raises(SchemaResolutionError):
        read_as(spark, [(1,)], rec(("a", "int"), name="Old"), rec(("a", "int"), name="New"))


def test_recursive_records(spark):
    s = {"type": "record", "name": "L", "fields": [{"name": "v", "type": "int"}, {"name": "next", "type": ["null", "L"]}]}
    assert read_as(spark, [(1, (2, (3, None)))], s, s) == [{"v": 1, "next": {"v": 2, "next": {"v": 3, "next": None}}}]


def test_bare_values_and_nulls(spark):
    df = spark.createDataFrame([(b"\x06foo",), (None,)], "m binary").select(avro_decode("m", "string").alias("v"))
    assert [r.v for r in df.collect()] == ["foo", None]


def test_json(spark):
    s = rec(("u", ["null", "int", "string"]), ("b", "bytes"), ("m", {"type": "map", "values": ["null", "long"]}), ("a", {"type": "array", "items": rec(("x", "double"), name="I")}), ("t", {"type": "long", "logicalType": "timestamp-millis"}), ("d", {"type": "bytes", "logicalType": "decimal", "precision": 8, "scale": 2}), ("s", "string", {"default": "dflt"}))
    from decimal import Decimal

    row = (("string", None, None, 'q"\n'), b"\xff\0", {"k": None, "l": 5}, [(1.5,)], dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), Decimal("-1.25"), "x")
    df = spark.createDataFrame([row], to_spark_type(s))
    out = df.select(F.struct(*df.columns).alias("a"), avro_to_json(F.struct(*df.columns), s).alias("j")).select("a", "j", avro_from_json("j", s).alias("b")).first()
    assert out.a == out.b
    text = json.loads(out.j)
    assert text["u"] == {"string": 'q"\n'} and text["b"] == "\xff\0" and text["m"] == {"k": None, "l": {"long": 5}} and text["t"] == 1577836800000
    some = spark.createDataFrame([('{"a":{"int":3}}',), ("{}",)], "j string")
    assert some.select(avro_from_json("j", rec(("a", ["null", "int"], {"default": None}), ("z", "string", {"default": "q"}))).alias("r")).select("r.*").collect() == [(3, "q"), (None, "q")]
    with pytest.raises(Exception, match="no value and no default"):
        some.select(avro_from_json("j", rec(("a", ["null", "int"])))).collect()


def test_validation(spark):
    df = spark.createDataFrame([("a", "b", 1, None), (None, None, None, 2)], "str_null string, str string, integ int, integ_null long")
    s = rec(("str_null", ["null", "string"]), ("str", "string"), ("integ_null", ["null", "int"]), ("integ", "int"))
    c = F.struct(*df.columns)
    got = df.select(avro_valid(c, df.schema, s).alias("ok"), avro_errors(c, df.schema, s).alias("e")).collect()
    assert [r.ok for r in got] == [True, False] and got[0].e == [] and [x.field for x in got[1].e] == ["str", "integ"]
    big = spark.createDataFrame([(1 << 40,), (5,)], "n long")
    assert [r[0] for r in big.select(avro_valid(F.col("n"), big.schema["n"].dataType, "int")).collect()] == [False, True]
    extra = rec(("str", "string"))
    assert df.select(avro_valid(c, df.schema, extra), avro_valid(c, df.schema, extra, strict=True)).first() == (True, False)


def test_files(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select("id", F.concat(F.lit("s"), "id").alias("s"), F.array("id").alias("a")).repartition(3)
    write_avro(df, path, codec="deflate", **{"metadata.who": "me", "syncInterval": 500})
    with pytest.raises(FileExistsError):
        write_avro(df, path)
    assert sorted(read_avro(spark, path).collect()) == sorted(df.collect())
    assert avro_metadata(path)["who"] == b"me" and avro_metadata(path)["avro.codec"] == b"deflate"
    write_avro(df, path, mode="append", codec="null")
    assert read_avro(spark, path).count() == 2000
    assert {read_header(open(os.path.join(path, f), "rb")).codec for f in os.listdir(path) if f.endswith(".avro")} == {"deflate"}
    write_avro(df.limit(1), path, mode="overwrite")
    assert read_avro(spark, path).count() == 1
    empty = str(tmp_path / "e")
    write_avro(df.limit(0), empty)
    assert read_avro(spark, empty).count() == 0 and read_avro(spark, empty).columns == ["id", "s", "a"]
    assert is_avro(os.path.join(path, [f for f in os.listdir(path) if f.endswith(".avro")][0])) and not is_avro(b"nope")
    pruned = read_avro(spark, path, {"type": "record", "name": "topLevelRecord", "fields": [{"name": "id", "type": ["null", "long"]}]})
    assert pruned.columns == ["id"] and "s#" not in pruned._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="no codec is called"):
        write_avro(df, str(tmp_path / "u"), codec="nope")


def test_files_of_two_schemas_are_resolved_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    for i, s in enumerate((rec(("a", "int")), rec(("a", "long"), ("b", "string")))):
        df = spark.createDataFrame([(i, "x")], "a int, b string").select(*(f["name"] for f in s["fields"]))
        write_avro(df, f"{path}/{i}", s)
    out = read_avro(spark, path, rec(("a", "double"), ("b", ["null", "string"], {"default": None})))
    assert sorted(out.collect()) == [(0.0, None), (1.0, "x")]


def test_blocks(spark, tmp_path):
    path, copy = str(tmp_path / "t"), str(tmp_path / "c")
    df = spark.range(500).withColumn("s", F.lit("x" * 10)).coalesce(1)
    write_avro(df, path, syncInterval=1000)
    b = read_blocks(spark, path)
    assert b.count() > 3 and b.agg(F.sum("num_records")).first()[0] == 500
    write_blocks(transcode(b, "bzip2"), copy)
    assert avro_metadata(copy)["avro.codec"] == b"bzip2"
    assert sorted(read_avro(spark, copy).collect()) == sorted(df.collect())
    assert explode_blocks(b, avro_schema(path)).count() == 500
    with pytest.raises(ValueError, match="another schema"):
        write_blocks(b, copy, "int")


def test_generate_and_anonymize(spark):
    s = rec(("i", "int"), ("u", ["null", "string", "long"]), ("e", {"type": "enum", "name": "E", "symbols": ["A"]}), ("f", {"type": "fixed", "name": "F", "size": 11}), ("m", {"type": "map", "values": "boolean"}), ("d", {"type": "bytes", "logicalType": "decimal", "precision": 6, "scale": 2}), ("id", {"type": "string", "logicalType": "uuid"}), ("t", {"type": "long", "logicalType": "local-timestamp-millis"}), ("l", ["null", "R"]))
    one, two = generate(spark, s, 20, 3), generate(spark, s, 20, 3)
    assert one.collect() == two.collect() and one.count() == 20
    assert one.select(F.bool_and(avro_valid(F.struct(*one.columns), one.schema, s))).first()[0]
    hidden = anonymize_schema(s)
    assert hidden["name"].startswith("A_") and len(hidden["fields"][0]["name"]) == 32 and parse_schema(hidden)


def test_custom_logical_type(spark):
    s = rec(("c", {"type": "string", "logicalType": "shout"}))
    logical.register("string-shout", reader=F.upper)
    try:
        assert read_as(spark, [("a",)], s, s) == [{"c": "A"}]
    finally:
        logical.READERS.clear()


def test_custom_types_in_depth(spark, tmp_path):
    shout = {"type": "string", "logicalType": "shout"}
    s = rec(("c", shout), ("a", {"type": "array", "items": ["null", shout]}), ("m", {"type": "map", "values": shout}), ("n", rec(("x", ["null", shout]), name="N")), ("f", {"type": "fixed", "name": "F", "size": 2, "logicalType": "flip"}))
    row = ("a", ["b", None], {"k": "c"}, ("d",), b"xy")
    df = spark.createDataFrame([row], to_spark_type(s))
    logical.register("string-shout", writer=F.upper, reader=lambda c: F.concat(c, F.lit("!")))
    flip = lambda c: F.concat(F.substring(c, 2, 1), F.substring(c, 1, 1))
    logical.register("fixed-flip", writer=flip, reader=flip)
    try:
        assert spark.createDataFrame([("ab",)], "v string").select(avro_encode(F.col("v"), shout)).first()[0] == b"\x04AB"
        path = str(tmp_path / "t")
        write_avro(df, path, s)
        want = ("A!", ["B!", None], {"k": "C!"}, ("D!",), b"xy")
        assert read_avro(spark, path).first() == want
        assert read_avro(spark, path, s).select("c", "n").first() == (want[0], want[3])
        assert explode_blocks(read_blocks(spark, path), s).first() == want
        few = {**s, "fields": s["fields"][1:3]}
        assert read_avro(spark, path, few).first() == want[1:3]
    finally:
        logical.READERS.clear()
        logical.WRITERS.clear()
    assert read_avro(spark, path).first() == ("A", ["B", None], {"k": "C"}, ("D",), b"yx")


def test_names_of_records_beside_null(spark, tmp_path):
    s = rec(("u", ["null", rec(("x", "int"), name="ns.A")]), ("e", [{"type": "enum", "name": "E", "symbols": ["P"]}, "null"]), ("w", ["null", "string", "int"]))
    df = spark.createDataFrame([((1,), "P", ("int", None, None, 5)), (None, None, None)], to_spark_type(s)).coalesce(1)
    m = df.select(avro_encode(F.struct(*df.columns), s).alias("m"))

    def got(**options):
        return [(r.u, r.e) for r in m.select(avro_decode("m", s, **options).alias("r")).select("r.*").collect()]

    assert got() == [((1,), "P"), (None, None)]
    assert got(return_record_name=True) == [(("ns.A", (1,)), "P"), (None, None)]
    assert got(return_named_type=True, return_record_name=True) == [(("ns.A", (1,)), ("E", "P")), (None, None)]
    assert got(return_record_name=True, return_record_name_override=True) == got(return_named_type=True, return_named_type_override=True) == got()
    write_avro(df, str(tmp_path / "t"), s)
    assert read_avro(spark, str(tmp_path / "t"), return_record_name=True).where("u.tag = 'ns.A'").count() == 1


def test_splits_inside_blocks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5000).withColumn("s", F.concat(F.lit("row "), "id")).coalesce(1)
    write_avro(df, path, codec="deflate", syncInterval=700)
    file = os.path.join(path, [f for f in os.listdir(path) if f.endswith(".avro")][0])
    whole = None
    for split in (13, 100, 1 << 12, 1 << 30):
        with open(file, "rb") as f:
            header = read_header(f)
            size = os.path.getsize(file)
            found = [b.offset for at in range(0, size, split) for b, _ in blocks(f, header, at, at + split)]
        whole = whole or found
        assert found == whole and len(whole) > 50  # every block once, wherever the cuts are
    parts = cut_ranges([(file, size), (file, size)], 3000)
    assert sum(len(p.files) for p in parts) >= len(parts) > 5
    for option in ({"splitBytes": 3000}, {"minPartitions": 3}):
        scan = spark.read.format("avro_native").options(**{"minPartitions": 1 << 20, **option}).load(path)
        assert sorted(scan.collect()) == sorted(df.collect())
    one = read_blocks(spark, path, splitBytes=5000)
    assert one.select("offset").distinct().count() == one.count() == len(whole)
    assert sorted(read_avro(spark, "file://" + path).collect()) == sorted(df.collect())


def test_many_files_are_grouped_by_tasks(spark, tmp_path, monkeypatch):
    from avrospark.sources import files

    monkeypatch.setattr(files, "FEW_FILES", 2)
    for i in range(6):
        write_avro(spark.createDataFrame([(i,)], "a int" if i % 2 else "b long"), str(tmp_path / "t" / str(i)))
    assert sorted((r.a, r.b) for r in read_avro(spark, str(tmp_path / "t")).collect() if r.a is not None) == [(1, None), (3, None), (5, None)]


def test_writer_options(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string").coalesce(1)
    path = str(tmp_path / "t")
    write_avro(df, path, syncMarker="00112233445566778899aabbccddeeff")
    with open(os.path.join(path, [f for f in os.listdir(path) if f.endswith(".avro")][0]), "rb") as f:
        assert read_header(f).sync.hex() == "00112233445566778899aabbccddeeff"
    with pytest.raises(Exception, match="sync marker has 16 bytes"):
        write_avro(df, path, mode="append", syncMarker="0011")
    with pytest.raises(Exception, match="not data of the schema"):
        write_avro(df, str(tmp_path / "v"), rec(("a", "int"), ("b", "string")), validator=True)
    write_avro(df.limit(1), "file://" + str(tmp_path / "w"), rec(("a", "int"), ("b", "string")), validator=True)
    assert read_avro(spark, str(tmp_path / "w")).collect() == [(1, "x")]
    write_avro(df, path, mode="overwrite")
    assert read_avro(spark, path).count() == 2 and not [f for f in os.listdir(path) if f.startswith(".") and f.endswith((".tmp", ".old"))]


def test_blocks_of_failed_attempts_leave_nothing(spark, tmp_path):
    path, copy = str(tmp_path / "t"), str(tmp_path / "c")
    write_avro(spark.range(300).coalesce(1), path, syncInterval=200)
    mixed = read_blocks(spark, path).coalesce(1).withColumn("codec", F.when(F.col("offset") > 400, "deflate").otherwise(F.col("codec")))
    with pytest.raises(Exception, match="one schema and one codec"):
        write_blocks(mixed, copy)
    assert not os.path.exists(copy) or os.listdir(copy) == []
    # attempts that were repeated wrote files of their own, which nobody has named
    made = write_blocks(read_blocks(spark, path).repartition(3, "offset"), copy).collect()
    assert sorted(r.file for r in made) == sorted(os.path.join(copy, f) for f in os.listdir(copy) if f.endswith(".avro"))
    assert read_avro(spark, copy).count() == 300


def test_stream_sink(spark, tmp_path):
    source, sink = str(tmp_path / "s"), str(tmp_path / "o")
    write_avro(spark.range(10), source)
    stream = lambda: write_stream(read_stream(spark, source), sink, str(tmp_path / "c"), codec="deflate").trigger(availableNow=True).start().awaitTermination()
    stream()
    assert sorted(r.id for r in read_avro(spark, sink).collect()) == list(range(10))
    write_avro(spark.range(10, 15), source, mode="append")
    stream()
    stream()
    assert sorted(r.id for r in read_avro(spark, sink).collect()) == list(range(15))
    names = [f for f in os.listdir(sink) if f.endswith(".avro")]
    assert {f[:16] for f in names} == {"batch-0000000000", "batch-0000000001"} and avro_metadata(sink)["avro.codec"] == b"deflate"


def test_stream(spark, tmp_path):
    path = str(tmp_path / "t")
    write_avro(spark.range(10), path)
    q = read_stream(spark, path).groupBy().count().writeStream.outputMode("complete").format("memory").queryName("engine_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("engine_stream").first()[0] == 10


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    write_avro(spark.createDataFrame([(1, dt.date(2020, 1, 2))], "a int, d date"), path)
    file = os.path.join(path, [f for f in os.listdir(path) if f.endswith(".avro")][0])
    main([file])
    assert json.loads(capsys.readouterr().out) == {"a": 1, "d": "2020-01-02"}
    main(["--schema", file])
    assert json.loads(capsys.readouterr().out)["name"] == "topLevelRecord"
    main(["--metadata", file])
    assert json.loads(capsys.readouterr().out)["avro.codec"] == "null"
    main(["--codecs"])
    assert "zstandard" in capsys.readouterr().out


def test_dataframe_schema_to_avro(spark):
    df = spark.createDataFrame([], "a int not null, b array<string>, c struct<x: date>")
    assert from_spark_type(df.schema)["fields"][0] == {"name": "a", "type": "int"}
    assert from_spark_type(df.schema)["fields"][2]["type"][1]["name"] == "topLevelRecord.c"


def test_every_query_has_sql_with_its_columns():
    from avrospark import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
