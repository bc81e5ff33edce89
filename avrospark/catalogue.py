"""Queries that pass the synthetic tables through the engine, and the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import avro_canonical, avro_decode, avro_encode, avro_errors, avro_fingerprint, avro_from_json, avro_to_json, avro_valid
from .kernels.codecs import CODECS
from .operators import anonymize, explode_blocks, generate, read_blocks, transcode, write_blocks
from .schema import SchemaParseException, UnknownType, expand_schema, from_spark_type, load_schema, parse_schema
from .schema.load import whole
from .shared import scratch
from .sources import are_avro, avro_schema, read_avro, write_avro
from .streaming import decode_stream, read_stream, write_stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record(name: str, /, **fields: Any) -> dict:
    """A record schema; a field is a type, or a dict with type and more under ``_``."""
    return {"type": "record", "name": name, "fields": [{"name": k, **v["_"]} if isinstance(v, dict) and "_" in v else {"name": k, "type": v} for k, v in fields.items()]}


def whole_row(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def messages(df: DataFrame, schema: Any = None, reader: Any = None) -> DataFrame:
    """``df`` encoded as messages and decoded again."""
    schema = schema or from_spark_type(df.schema)
    return df.select(avro_encode(whole_row(df), schema).alias("m")).select(avro_decode(F.col("m"), schema, reader).alias("r")).select("r.*")


def container(df: DataFrame, schema: Any = None, reader: Any = None, **options: Any) -> DataFrame:
    """``df`` written to container files and read again."""
    path = scratch(df.sparkSession, "avro")
    write_avro(df, path, schema, **options)
    return read_avro(df.sparkSession, path, reader)


def hex_of(c: Column) -> Column:
    return F.hex(c)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pricing summary over Avro-encoded line items; only four fields are decoded."""
    li = container(table(spark, sf_dir, "lineitem"), codec="zstandard", reader=record("topLevelRecord", l_returnflag=["null", "string"], l_linestatus=["null", "string"], l_quantity=["null", "double"]))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count("*").alias("n"))


def roundtrip(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(table(spark, sf_dir, name))


def array_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = messages(table(spark, sf_dir, "embeddings"))
    return df.select("vec_id", F.size("embedding").alias("n"), F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"))


def array_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    schema = record("Conversation", conv_id="long", turns={"type": "array", "items": record("Turn", turn="long", role="string", text="string")})
    return messages(turns, schema).select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")


def map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string")).alias("m"))
    out = messages(e, record("E", event_id="long", m={"type": "map", "values": ["null", "string"]}))
    return out.select("event_id", F.col("m")["type"].alias("m_type"), F.col("m")["user"].alias("m_user"))


def nested_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct("c_name", "c_nationkey", "c_mktsegment").alias("who"))
    return messages(c).select("c_custkey", "who.*")


def region_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select("r_regionkey", hex_of(avro_encode(whole_row(r), record("R", r_regionkey="int", r_name="string"))).alias("h"))


def varint_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", hex_of(avro_encode(F.col("o_orderkey"), "long")).alias("h"))


def encoded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.select(F.length(avro_encode(whole_row(c), record("C", c_custkey="long", c_name="string"))).cast("long").alias("b")).agg(F.sum("b").alias("bytes"))


def evolved(name: str, writer: dict, reader: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written with one schema and read with another."""
    names = [f["name"] for f in writer["fields"]]
    return container(table(spark, sf_dir, name).select(*names), writer, reader)


def string_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, r = record("R", r_regionkey="int", r_name="string"), record("R", r_regionkey="int", r_name="bytes")
    return messages(table(spark, sf_dir, "region"), w, r).select("r_regionkey", hex_of(F.col("r_name")).alias("h"))


def enum_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda symbols, **more: {"type": "enum", "name": "Flag", "symbols": symbols, **more}
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    return messages(li, record("L", l_orderkey="long", l_linenumber="int", flag=flag(["A", "N", "R"])), record("L", l_orderkey="long", l_linenumber="int", flag=flag(["A", "N"], default="N")))


def union_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("v"))
    return messages(e, record("E", event_id="long", v=["string", "null"]))


TAGGED = record("E", event_id="long", u=["null", "long", "string"])


def tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    u = F.struct(F.when(even, "long").otherwise("string").alias("tag"), F.when(even, F.col("user_id")).alias("member1"), F.when(~even, F.col("event_type")).alias("member2"))
    return table(spark, sf_dir, "events").select("event_id", u.alias("u"))


def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(tagged_events(spark, sf_dir), TAGGED).select("event_id", "u.tag", F.col("u.member1").alias("l"), F.col("u.member2").alias("s"))


def union_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union read as another: the first branch of the reader that fits, promotions included."""
    out = messages(tagged_events(spark, sf_dir), TAGGED, record("E", event_id="long", u=["string", "double"]))
    return out.select("event_id", "u.tag", F.col("u.member1").alias("d"), F.col("u.member0").alias("s"))


def decimals(kind: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("d"))
    return messages(o, record("O", o_orderkey="long", d={**kind, "logicalType": "decimal", "precision": 18, "scale": 2}))


def logical(table_name: str, key: str, value: Callable[[], Column], name: str, kind: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, table_name).select(key, value().alias(name))
    return messages(df, record("T", **{key: "long", name: kind}))


def utc_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))).alias("ts"))
    out = messages(e, record("T", event_id="long", ts={"type": "long", "logicalType": "timestamp-micros"}))
    return out.select("event_id", F.unix_micros("ts").alias("us"))


def uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.regexp_replace(F.upper(F.md5(F.col("p_name").cast("binary"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return messages(table(spark, sf_dir, "part").select("p_partkey", id_.alias("id")), record("P", p_partkey="long", id={"type": "string", "logicalType": "uuid"}))


def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.md5(F.col("p_name").cast("binary"))).alias("h"))
    return messages(p, record("P", p_partkey="long", h={"type": "fixed", "name": "Md5", "size": 16})).select("p_partkey", F.hex("h").alias("h"))


JSON_REGION = record("R", r_regionkey="int", r_name=["null", "string"])


def json_encode(named: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select("r_regionkey", avro_to_json(whole_row(r), JSON_REGION, write_union_type=named).alias("j"))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    schema = from_spark_type(c.schema)
    return c.select(avro_to_json(whole_row(c), schema).alias("j")).select(avro_from_json(F.col("j"), schema).alias("r")).select("r.*")


def json_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    w = record("N", n_nationkey="int", n_name="string")
    r = {**w, "fields": [*w["fields"], {"name": "note", "type": "string", "default": "NONE"}]}
    return n.select(avro_to_json(whole_row(n), w).alias("j")).select(avro_from_json(F.col("j"), r).alias("r")).select("r.*")


def json_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    w = record("N", n_nationkey="int", n_name="string")
    r = record("N", key={"_": {"type": "long", "aliases": ["n_nationkey"]}})
    return n.select(avro_to_json(whole_row(n), w).alias("j")).select(avro_from_json(F.col("j"), w, r).alias("r")).select("r.*")


def validate_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ok = avro_valid(F.col("l_returnflag"), li.schema["l_returnflag"].dataType, {"type": "enum", "name": "Flag", "symbols": ["A", "N"]})
    return li.select(ok.alias("valid")).groupBy("valid").agg(F.count("*").alias("n"))


def validate_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(avro_valid(F.col("p_size"), p.schema["p_size"].dataType, "int").alias("ok")).agg(F.bool_and("ok").alias("ok"))


def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("v"))
    errors = avro_errors(whole_row(e), e.schema, record("E", event_id="int", v="string"))
    return e.select("event_id", F.explode(errors).alias("x")).select("event_id", "x.field", "x.expected")


def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, path = table(spark, sf_dir, "region"), scratch(spark, "append")
    write_avro(r, path, codec="deflate")
    write_avro(r, path, mode="append", codec="snappy")  # the codec of what is there stays
    return read_avro(spark, path)


def codec(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many blocks; splits begin inside them."""
    return container(table(spark, sf_dir, "lineitem"), codec=name)


def booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("big"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax") == 0).alias("free"))
    out = messages(li, record("L", l_orderkey="long", l_linenumber="int", big="boolean", free=["null", "boolean"]))
    return out.withColumn("free", F.col("free").cast("string"))


def utc_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))).alias("ts"))
    out = messages(e, record("T", event_id="long", ts={"type": "long", "logicalType": "timestamp-millis"}))
    return out.select("event_id", F.unix_millis("ts").alias("ms"))


def resolved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists and values of maps, promoted and renamed inside."""
    point = lambda name, kind, **more: record("Point", **{name: {"_": {"type": kind, **more}}})
    p = table(spark, sf_dir, "part").select("p_partkey", F.array("p_size", F.col("p_size") + 1).alias("a"), F.create_map(F.lit("k"), F.struct(F.col("p_size").alias("x"))).alias("m"))
    w = record("P", p_partkey="long", a={"type": "array", "items": "int"}, m={"type": "map", "values": point("x", "int")})
    r = record("P", p_partkey="long", a={"type": "array", "items": "double"}, m={"type": "map", "values": point("y", "long", aliases=["x"])})
    out = messages(p, w, r)
    return out.select("p_partkey", F.col("a")[0].alias("first"), F.col("a")[1].alias("second"), F.col("m")["k"]["y"].alias("y"))


def validate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of a column are data of each kind of schema."""
    o, third = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3 == 0
    big = F.when(third, F.lit(1 << 40)).otherwise(F.col("o_orderkey"))
    md5 = F.unhex(F.md5(F.col("o_orderstatus").cast("binary")))
    cases = {
        "boolean": (third, "boolean"),
        "bytes": (md5, "bytes"),
        "string": (F.when(~third, F.col("o_orderstatus")), "string"),
        "long": (F.when(~third, big), "long"),
        "int": (big, "int"),
        "double": (F.col("o_totalprice"), "double"),
        "float": (F.when(third, F.col("o_totalprice")), "float"),
        "fixed": (F.when(third, md5).otherwise(F.substring(md5, 1, 8)), {"type": "fixed", "name": "F", "size": 16}),
        "array": (F.array(F.lit(1).cast("long"), big), {"type": "array", "items": "int"}),
        "map": (F.create_map(F.lit("k"), F.when(~third, F.lit("v"))), {"type": "map", "values": "string"}),
        "union": (F.when(~third, big), ["null", "long"]),
        "narrow": (F.when(~third, big), ["null", "boolean"]),
    }
    columns = o.select(*(c.alias(k) for k, (c, _) in cases.items()))
    counts = columns.select(*(F.sum(avro_valid(F.col(f"`{k}`"), columns.schema[k].dataType, schema).cast("int")).alias(k) for k, (_, schema) in cases.items()))
    return counts.select(F.explode(F.create_map(*(x for k in cases for x in (F.lit(k), F.col(f"`{k}`"))))).alias("kind", "n"))


def files_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are containers, by their first bytes."""
    path = scratch(spark, "told")
    write_avro(table(spark, sf_dir, "region"), path)
    told = are_avro(spark, path).union(are_avro(spark, f"{sf_dir}/region.parquet"))
    return told.groupBy("is_avro").agg((F.count("*") > 0).alias("found"))


def custom_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logical type of one's own, written and read, inside a list."""
    from . import logical as types

    schema = record("N", n_nationkey="int", names={"type": "array", "items": {"type": "string", "logicalType": "catalogue-shout"}})
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.lower("n_name")).alias("names"))
    types.register("string-catalogue-shout", writer=F.upper, reader=lambda c: F.concat(c, F.lit("!")))
    try:
        return container(n, schema).select("n_nationkey", F.col("names")[0].alias("name"))
    finally:
        types.READERS.pop("string-catalogue-shout")
        types.WRITERS.pop("string-catalogue-shout")


def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records beside null, with their names."""
    schema = record("N", n_nationkey="int", at=["null", record("geo.Region", n_regionkey="int")])
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 1, F.struct("n_regionkey")).alias("at"))
    m = n.select(avro_encode(whole_row(n), schema).alias("m"))
    return m.select(avro_decode(F.col("m"), schema, return_record_name=True).alias("r")).select("r.n_nationkey", "r.at.tag", F.coalesce("r.at.member1.n_regionkey", F.lit(-1)).alias("region"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, r = scratch(spark, "valid"), table(spark, sf_dir, "region")
    write_avro(r, path, record("R", r_regionkey="int", r_name="string"), validator=True, syncMarker="0f" * 16)
    return read_avro(spark, path)


def stream_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container files read as a stream and written as a stream."""
    path, copy = scratch(spark, "stream"), scratch(spark, "copy")
    write_avro(table(spark, sf_dir, "events"), path)
    write_stream(read_stream(spark, path), copy, scratch(spark, "stream-state"), codec="snappy").trigger(availableNow=True).start().awaitTermination()
    return read_avro(spark, copy)


class _Shelf:
    """Schemas by name, held in memory."""

    def __init__(self, **schemas: Any):
        self.schemas = schemas

    def load(self, name: str) -> Any:
        return self.schemas[name]


def schemas_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of nations through a schema whose types are loaded from a repository, expanded, and used as a reader's."""
    shelf = _Shelf(Nation=record("Nation", n_nationkey="int", flag="Flag"), Flag={"type": "enum", "name": "Flag", "symbols": ["EVEN", "ODD"]})
    schema = expand_schema(whole(load_schema("Nation", repository=shelf)))
    flag = F.when(F.col("n_nationkey") % 2 == 0, "EVEN").otherwise("ODD")
    return messages(table(spark, sf_dir, "nation").select("n_nationkey", flag.alias("flag")), schema)


def schemas_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which schemas are refused: wrong defaults and symbols, unknown names."""
    cases = {
        "default": record("R", a={"_": {"type": "int", "default": "x"}}),
        "fine": record("R", a={"_": {"type": ["null", "int"], "default": None}}),
        "symbol": {"type": "enum", "name": "E", "symbols": ["a-b"]},
        "symbols": {"type": "enum", "name": "E", "symbols": ["A", "A"]},
        "unknown": record("R", a="Other"),
    }

    def refused(schema: Any) -> bool:
        try:
            parse_schema(schema)
        except (SchemaParseException, UnknownType, ValueError):
            return True
        return False

    return spark.createDataFrame([(k, refused(v)) for k, v in cases.items()], "what string, refused boolean")


def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "blocks")
    write_avro(table(spark, sf_dir, "orders"), path, codec="deflate")
    return read_blocks(spark, path).agg(F.sum("num_records").alias("n"))


def transcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one codec copied as another, then read as rows."""
    path, copy = scratch(spark, "blocks"), scratch(spark, "copy")
    write_avro(table(spark, sf_dir, "orders"), path, codec="deflate")
    write_blocks(transcode(read_blocks(spark, path), "zstandard"), copy)
    return read_avro(spark, copy)


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "blocks")
    write_avro(table(spark, sf_dir, "supplier"), path, codec="snappy")
    return explode_blocks(read_blocks(spark, path), avro_schema(path))


def fingerprint(form: Any, algorithm: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(json.dumps(form),)], "s string").select(avro_fingerprint(avro_canonical(F.col("s")), algorithm).alias("fp"))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = json.dumps({"type": "error", "name": "E", "namespace": "a.b", "doc": "x", "fields": [{"name": "f", "type": {"type": "string"}, "default": ""}]})
    return spark.createDataFrame([(text,)], "s string").select(avro_canonical(F.col("s")).alias("form"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many generated rows as there are nations, through the codec."""
    schema = record("G", i="int", u=["null", "string"], e={"type": "enum", "name": "E", "symbols": ["A", "B"]}, l={"type": "array", "items": "double"})
    return messages(generate(spark, schema, table(spark, sf_dir, "nation").count()), schema).select(F.size("l").alias("items")).agg(F.count("*").alias("n"), F.sum("items").alias("items"))


def anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return anonymize(r, from_spark_type(r.schema))


def hidden(name: str) -> str:
    return hashlib.md5(name.encode()).hexdigest()


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a stream, decoded and counted by an incremental query."""
    path, name = scratch(spark, "stream"), f"counts_{abs(hash(sf_dir))}"
    e = table(spark, sf_dir, "events")
    schema = from_spark_type(e.schema)
    write_avro(e.select(avro_encode(whole_row(e), schema).alias("payload")), path)
    counts = decode_stream(read_stream(spark, path), "payload", schema).groupBy("event_type").agg(F.count("*").alias("n"))
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


DECIMAL_BYTES, DECIMAL_FIXED = {"type": "bytes"}, {"type": "fixed", "name": "D", "size": 9}
ENUM_FORM = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "int", "doc": "dropped"}]}
VARINT_SQL = "SELECT o_orderkey, " + "CASE " + " ".join(f"WHEN z < {1 << 7 * k} THEN printf('{'%02X' * k}', {', '.join(f'{"128 + " if i < k - 1 else ""}(z >> {7 * i}) % 128' for i in range(k))})" for k in range(1, 6)) + " END AS h FROM (SELECT o_orderkey, 2 * o_orderkey AS z FROM orders)"

#: name: (query, SQL or None)
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "flagship_q1": (flagship, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ALL"),
    **{f"roundtrip_{t}": (partial(roundtrip, t), f"SELECT * FROM {t}") for t in ("lineitem", "events", "orders", "customer")},
    "container_lineitem": (lambda s, d: container(table(s, d, "lineitem"), codec="deflate"), "SELECT * FROM lineitem"),
    "roundtrip_array_float": (array_float, "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings"),
    "roundtrip_array_record": (array_record, "SELECT conv_id, turn, role, text FROM conversations"),
    "roundtrip_map": (map_fields, "SELECT event_id, event_type AS m_type, CAST(user_id AS VARCHAR) AS m_user FROM events"),
    "roundtrip_nested_record": (nested_record, "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"),
    "encode_region_hex": (region_hex, "SELECT r_regionkey, printf('%02X', 2*r_regionkey) || printf('%02X', 2*octet_length(encode(r_name))) || hex(encode(r_name)) AS h FROM region"),
    "encode_varint_hex": (varint_hex, VARINT_SQL),
    "encoded_size": (encoded_size, "SELECT CAST(sum(CASE WHEN 2*c_custkey < 128 THEN 1 WHEN 2*c_custkey < 16384 THEN 2 WHEN 2*c_custkey < 2097152 THEN 3 ELSE 4 END + 1 + octet_length(encode(c_name))) AS BIGINT) AS bytes FROM customer"),
    "project_drop": (partial(evolved, "orders", record("O", o_orderkey="long", o_custkey="long", o_totalprice="double"), record("O", o_orderkey="long", o_totalprice="double")), "SELECT o_orderkey, o_totalprice FROM orders"),
    "rename_alias": (partial(evolved, "customer", record("C", c_custkey="long", c_name="string"), record("C", customer_id={"_": {"type": "long", "aliases": ["c_custkey"]}}, name={"_": {"type": "string", "aliases": ["c_name"]}})), "SELECT c_custkey AS customer_id, c_name AS name FROM customer"),
    "default_fill": (partial(evolved, "part", record("P", p_partkey="long", p_name="string"), record("P", p_partkey="long", p_name="string", stock={"_": {"type": "int", "default": -1}}, bin={"_": {"type": "string", "default": "NONE"}})), "SELECT p_partkey, p_name, -1 AS stock, 'NONE' AS bin FROM part"),
    "promote_int_long": (partial(evolved, "nation", record("N", n_nationkey="int"), record("N", k={"_": {"type": "long", "aliases": ["n_nationkey"]}})), "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation"),
    "promote_int_double": (partial(evolved, "part", record("P", p_size="int"), record("P", k={"_": {"type": "double", "aliases": ["p_size"]}})), "SELECT CAST(p_size AS DOUBLE) AS k FROM part"),
    "promote_long_float": (partial(evolved, "supplier", record("S", s_suppkey="long"), record("S", k={"_": {"type": "float", "aliases": ["s_suppkey"]}})), "SELECT CAST(s_suppkey AS FLOAT) AS k FROM supplier"),
    "promote_string_bytes": (string_bytes, "SELECT r_regionkey, hex(encode(r_name)) AS h FROM region"),
    "enum_default": (enum_default, "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A','N') THEN l_returnflag ELSE 'N' END AS flag FROM lineitem"),
    "union_nullable": (union_nullable, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS v FROM events"),
    "union_tagged": (union_tagged, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'string' END AS tag, CASE WHEN event_id % 2 = 0 THEN user_id END AS l, CASE WHEN event_id % 2 <> 0 THEN event_type END AS s FROM events"),
    "union_widened": (union_widened, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'double' ELSE 'string' END AS tag, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) END AS d, CASE WHEN event_id % 2 <> 0 THEN event_type END AS s FROM events"),
    "logical_decimal": (partial(decimals, DECIMAL_BYTES), "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS d FROM orders"),
    "logical_decimal_fixed": (partial(decimals, DECIMAL_FIXED), "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS d FROM orders"),
    "logical_date": (partial(logical, "orders", "o_orderkey", lambda: F.col("o_orderdate").cast("date"), "d", {"type": "int", "logicalType": "date"}), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders"),
    "logical_local_micros": (partial(logical, "events", "event_id", lambda: F.col("ts"), "ts", {"type": "long", "logicalType": "local-timestamp-micros"}), "SELECT event_id, ts FROM events"),
    "logical_local_millis": (partial(logical, "events", "event_id", lambda: F.col("ts"), "ts", {"type": "long", "logicalType": "local-timestamp-millis"}), "SELECT event_id, date_trunc('milliseconds', ts) AS ts FROM events"),
    "logical_utc_micros": (utc_micros, "SELECT event_id, epoch_us(ts) AS us FROM events"),
    "logical_time_micros": (partial(logical, "events", "event_id", lambda: F.expr("cast(extract(hour from ts) as bigint) * 3600000000 + cast(extract(minute from ts) as bigint) * 60000000 + cast(extract(second from ts) * 1000000 as bigint)"), "t", {"type": "long", "logicalType": "time-micros"}), "SELECT event_id, CAST(epoch_us(ts) % 86400000000 AS BIGINT) AS t FROM events"),
    "logical_uuid": (uuids, "SELECT p_partkey, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS id FROM (SELECT p_partkey, md5(p_name) AS h FROM part)"),
    "fixed_roundtrip": (fixed, "SELECT p_partkey, upper(md5(p_name)) AS h FROM part"),
    "json_encode": (partial(json_encode, True), """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":{"string":"' || r_name || '"}}' AS j FROM region"""),
    "json_encode_plain": (partial(json_encode, False), """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS j FROM region"""),
    "json_roundtrip": (json_roundtrip, "SELECT * FROM customer"),
    "json_decode_default": (json_default, "SELECT n_nationkey, n_name, 'NONE' AS note FROM nation"),
    "json_resolved": (json_resolved, "SELECT CAST(n_nationkey AS BIGINT) AS key FROM nation"),
    "validate_enum": (validate_enum, "SELECT l_returnflag IN ('A','N') AS valid, count(*) AS n FROM lineitem GROUP BY ALL"),
    "validate_many": (validate_many, "SELECT bool_and(p_size BETWEEN -2147483648 AND 2147483647) AS ok FROM part"),
    "validate_errors": (validate_errors, "SELECT event_id, 'v' AS field, 'string' AS expected FROM events WHERE event_id % 3 = 0"),
    "append_concat": (append, "SELECT * FROM region UNION ALL SELECT * FROM region"),
    **{f"codec_{c}": (partial(codec, c), "SELECT * FROM lineitem") for c in CODECS},
    "roundtrip_boolean": (booleans, "SELECT l_orderkey, l_linenumber, l_quantity > 25 AS big, CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_tax = 0 AS VARCHAR) END AS free FROM lineitem"),
    "logical_utc_millis": (utc_millis, "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events"),
    "logical_time_millis": (partial(logical, "events", "event_id", lambda: F.expr("cast(extract(hour from ts) * 3600000 + extract(minute from ts) * 60000 + floor(extract(second from ts)) * 1000 as int)"), "t", {"type": "int", "logicalType": "time-millis"}), "SELECT event_id, CAST(hour(ts) * 3600000 + minute(ts) * 60000 + second(ts) * 1000 AS INTEGER) AS t FROM events"),
    "resolve_items": (resolved_items, "SELECT p_partkey, CAST(p_size AS DOUBLE) AS first, CAST(p_size + 1 AS DOUBLE) AS second, CAST(p_size AS BIGINT) AS y FROM part"),
    "validate_kinds": (
        validate_kinds,
        "SELECT u.kind, CAST(CASE WHEN u.kind IN ('boolean', 'bytes', 'double', 'union') THEN a WHEN u.kind IN ('string', 'long', 'int', 'array', 'map') THEN a - t ELSE t END AS BIGINT) AS n "
        "FROM (SELECT count(*) AS a, count(*) FILTER (o_orderkey % 3 = 0) AS t FROM orders), unnest(['boolean', 'bytes', 'string', 'long', 'int', 'double', 'float', 'fixed', 'array', 'map', 'union', 'narrow']) AS u(kind)",
    ),
    "files_told": (files_told, "SELECT * FROM (VALUES (true, true), (false, true)) AS v(is_avro, found)"),
    "logical_custom": (custom_type, "SELECT n_nationkey, upper(n_name) || '!' AS name FROM nation"),
    "record_names": (record_names, "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN 'geo.Region' END AS tag, CASE WHEN n_regionkey > 1 THEN n_regionkey ELSE -1 END AS region FROM nation"),
    "write_validated": (validated, "SELECT * FROM region"),
    "stream_copy": (stream_copied, "SELECT * FROM events"),
    "schemas_loaded": (schemas_loaded, "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS flag FROM nation"),
    "schemas_refused": (schemas_refused, "SELECT * FROM (VALUES ('default', true), ('fine', false), ('symbol', true), ('symbols', true), ('unknown', true)) AS v(what, refused)"),
    "block_counts": (block_counts, "SELECT count(*) AS n FROM orders"),
    "block_transcode": (transcoded, "SELECT * FROM orders"),
    "block_explode": (exploded, "SELECT * FROM supplier"),
    "fingerprint_md5": (partial(fingerprint, "int", "md5"), "SELECT md5('\"int\"') AS fp"),
    "fingerprint_sha256": (partial(fingerprint, ENUM_FORM, "SHA-256"), """SELECT sha256('{"name":"R","type":"record","fields":[{"name":"a","type":"int"}]}') AS fp"""),
    "fingerprint_rabin": (partial(fingerprint, "int", "CRC-64-AVRO"), "SELECT '8f5c393f1ad57572' AS fp"),
    "canonical_form": (canonical, """SELECT '{"name":"a.b.E","type":"record","fields":[{"name":"f","type":"string"}]}' AS form"""),
    "generate": (generated, "SELECT count(*) AS n, CAST(10 * count(*) AS BIGINT) AS items FROM nation"),
    "anonymize": (anonymized, f'SELECT r_regionkey AS "{hidden("r_regionkey")}", r_name AS "{hidden("r_name")}" FROM region'),
    "stream_decode_counts": (streamed, "SELECT event_type, count(*) AS n FROM events GROUP BY ALL"),
}

QUERIES = {name: query for name, (query, _) in CATALOGUE.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in CATALOGUE.items() if sql is not None}
