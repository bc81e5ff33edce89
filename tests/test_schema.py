"""Parsing rules, canonical forms, fingerprints, loading and expansion."""

import hashlib
import json

import pytest

from avrospark.schema import (
    FINGERPRINTS,
    FlatDirectory,
    SchemaParseException,
    SchemaRepositoryError,
    UnknownType,
    canonical_form,
    expand_schema,
    fingerprint,
    from_spark_type,
    fullname,
    load_schema,
    load_schema_ordered,
    parse_schema,
    to_spark_type,
)

R = {"type": "record", "name": "R", "namespace": "a.b", "fields": [{"name": "x", "type": "int", "note": "kept"}], "doc": "d"}


def test_names_and_extras():
    out = parse_schema(R).json()
    assert out["name"] == "a.b.R" and out["doc"] == "d" and out["fields"][0]["note"] == "kept" and "namespace" not in out
    assert fullname(R) == "a.b.R" and fullname({"name": "c.D", "namespace": "x"}) == "c.D"


def test_null_namespace_clears_what_is_inherited():
    s = {"type": "record", "name": "R", "namespace": "a", "fields": [{"name": "e", "type": {"type": "enum", "name": "E", "namespace": None, "symbols": ["A"]}}, {"name": "f", "type": {"type": "fixed", "name": "F", "size": 1}}]}
    assert set(parse_schema(s).names) == {"a.R", "E", "a.F"}


@pytest.mark.parametrize(
    ("schema", "error"),
    [
        ({"type": "record", "fields": []}, SchemaParseException),
        ("nope", UnknownType),
        ({"type": "array", "items": "nope"}, UnknownType),
        ([{"type": "fixed", "name": "F", "size": 1}, {"type": "fixed", "name": "F", "size": 1}], SchemaParseException),
        ({"type": "bytes", "logicalType": "decimal", "precision": 2, "scale": 3}, SchemaParseException),
        ({"type": "bytes", "logicalType": "decimal", "precision": 0}, SchemaParseException),
        ({"type": "bytes", "logicalType": "decimal", "precision": 2, "scale": -1}, SchemaParseException),
        ({"type": "fixed", "name": "F", "size": 2, "logicalType": "decimal", "precision": 5}, SchemaParseException),
        ({"type": "enum", "name": "E", "symbols": ["1-A"]}, SchemaParseException),
        ({"type": "enum", "name": "E", "symbols": ["A", "A"]}, SchemaParseException),
        ({"type": "enum", "name": "E", "symbols": ["A"], "default": "B"}, SchemaParseException),
        ({"type": "record", "name": "R", "fields": [{"name": "x", "type": "int", "aliases": "y"}]}, SchemaParseException),
        ({"type": "record", "name": "R", "fields": [{"name": "x", "type": "int", "default": "y"}]}, SchemaParseException),
        ({"type": "record", "name": "R", "fields": [{"name": "x", "type": {"type": "array", "items": "int"}, "default": {}}]}, SchemaParseException),
        ({"type": "record", "name": "R", "fields": [{"name": "x", "type": ["int", "null"], "default": "y"}]}, SchemaParseException),
    ],
)
def test_bad_schemas(schema, error):
    with pytest.raises(error):
        parse_schema(schema)


@pytest.mark.parametrize("default", [None, 3])
def test_a_union_default_fits_any_branch(default):
    parse_schema({"type": "record", "name": "R", "fields": [{"name": "x", "type": ["int", "null"], "default": default}]})


def test_canonical_form_and_fingerprints():
    s = {"type": "error", "name": "E", "namespace": "n", "doc": "x", "aliases": ["q"], "fields": [{"name": "a", "type": ["null", {"type": "string"}], "default": None}, {"name": "b", "type": {"type": "fixed", "size": 3, "name": "F"}}, {"name": "c", "type": "F"}]}
    form = canonical_form(s)
    assert form == '{"name":"n.E","type":"record","fields":[{"name":"a","type":["null","string"]},{"name":"b","type":{"name":"n.F","type":"fixed","size":3}},{"name":"c","type":"n.F"}]}'
    assert canonical_form(json.loads(form)) == form
    assert fingerprint('"int"', "CRC-64-AVRO") == "8f5c393f1ad57572"
    assert fingerprint('"int"', "SHA-256") == hashlib.sha256(b'"int"').hexdigest()
    assert fingerprint('"int"', "md5") == fingerprint('"int"', "MD5")
    assert "shake_128" not in FINGERPRINTS
    with pytest.raises(ValueError, match="no fingerprint is called"):
        fingerprint('"int"', "shake_128")


def test_same_canonical_form_and_fingerprint_as_the_jvm_library(spark):
    jvm = spark.sparkContext._jvm.org.apache.avro
    for s in (R, "int", ["null", "long"], {"type": "enum", "name": "x.E", "symbols": ["A", "B"]}, {"type": "map", "values": {"type": "array", "items": "bytes"}}):
        theirs = jvm.SchemaNormalization.toParsingForm(jvm.Schema.Parser().parse(json.dumps(s)))
        assert canonical_form(s) == theirs
        assert int(jvm.SchemaNormalization.parsingFingerprint64(jvm.Schema.Parser().parse(json.dumps(s)))).to_bytes(8, "little", signed=True).hex() == fingerprint(theirs, "CRC-64-AVRO")


def test_load_and_expand(tmp_path):
    files = {"P": {"type": "record", "name": "P", "fields": [{"name": "c", "type": ["null", "n.C"]}, {"name": "d", "type": "n.C"}]}, "n.C": {"type": "record", "name": "C", "namespace": "n", "fields": [{"name": "e", "type": "E"}]}, "n.E": {"type": "enum", "name": "n.E", "symbols": ["A"]}}
    for name, s in files.items():
        (tmp_path / f"{name}.avsc").write_text(json.dumps(s))
    made = load_schema(str(tmp_path / "P.avsc"))
    assert set(made.names) == {"P", "n.C", "n.E"}
    assert load_schema("P", repository=FlatDirectory(str(tmp_path))).json() == made.json()
    assert load_schema_ordered([str(tmp_path / f"{n}.avsc") for n in ("n.E", "n.C", "P")]).json() == made.json()
    with pytest.raises(UnknownType):
        load_schema_ordered([str(tmp_path / "P.avsc")])
    (tmp_path / "Q.avsc").write_text(json.dumps({"type": "record", "name": "Q", "fields": [{"name": "x", "type": "Missing"}]}))
    with pytest.raises(SchemaRepositoryError):
        load_schema(str(tmp_path / "Q.avsc"))
    loop = {"type": "record", "name": "L", "fields": [{"name": "next", "type": ["null", "L"]}]}
    assert expand_schema(loop)["fields"][0]["type"] == ["null", "L"]
    twice = {"type": "record", "name": "T", "fields": [{"name": "a", "type": {"type": "fixed", "name": "F", "size": 1}}, {"name": "b", "type": "F"}]}
    assert expand_schema(twice)["fields"][1]["type"] == {"type": "fixed", "name": "F", "size": 1}


def test_spark_types():
    s = {"type": "record", "name": "R", "fields": [{"name": "a", "type": ["null", "long"]}, {"name": "u", "type": ["int", "string"]}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 4, "scale": 1}}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "w", "type": {"type": "long", "logicalType": "made-up"}}]}
    assert to_spark_type(s).simpleString() == "struct<a:bigint,u:struct<tag:string,member0:int,member1:string>,d:decimal(4,1),t:timestamp,w:bigint>"
    back = from_spark_type(to_spark_type({"type": "map", "values": "int"}))
    assert back == {"type": "map", "values": ["null", "int"]}
    from pyspark.sql.types import IntegerType, MapType

    with pytest.raises(ValueError, match="map keys"):
        from_spark_type(MapType(IntegerType(), IntegerType()))
