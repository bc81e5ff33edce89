"""Sources and sinks for container files."""

from .files import are_avro, avro_metadata, avro_schema, is_avro, read_avro, register, write_avro

__all__ = ["are_avro", "avro_metadata", "avro_schema", "is_avro", "read_avro", "register", "write_avro"]
