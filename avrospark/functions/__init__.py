"""Column functions over Avro data."""

from .avro_json import avro_from_json, avro_to_json
from .payload import avro_decode, avro_encode
from .schemas import avro_canonical, avro_fingerprint
from .validation import avro_errors, avro_valid

__all__ = ["avro_canonical", "avro_decode", "avro_encode", "avro_errors", "avro_fingerprint", "avro_from_json", "avro_to_json", "avro_valid"]
