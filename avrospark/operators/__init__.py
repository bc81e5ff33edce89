"""Operators over files, blocks and schemas."""

from .anonymize import anonymize, anonymize_schema
from .blocks import explode_blocks, read_blocks, transcode, write_blocks
from .generate import generate

__all__ = ["anonymize", "anonymize_schema", "explode_blocks", "generate", "read_blocks", "transcode", "write_blocks"]
