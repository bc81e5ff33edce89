"""``python -m avrospark``: dumps container files as JSON lines, or their schema or metadata."""

from __future__ import annotations

import argparse
import base64
import datetime as dt
import json
import shutil
import sys
import tempfile
from decimal import Decimal
from typing import Any

from . import __version__
from .kernels.codecs import CODECS, decompress
from .kernels.container import blocks, decode_blocks, open_file, read_header
from .kernels.decode import Decoder


def plain(x: Any) -> Any:
    if isinstance(x, bytes):
        return x.decode("latin-1")
    if isinstance(x, (dt.date, dt.datetime, dt.time)):
        return x.isoformat()
    return str(x) if isinstance(x, Decimal) else base64.b64encode(bytes(x)).decode()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="avrospark", description="Dump Avro container files as JSON")
    parser.add_argument("files", nargs="*", help="files, - for standard input")
    parser.add_argument("--schema", action="store_true", help="print the schema instead of records")
    parser.add_argument("--metadata", action="store_true", help="print the metadata instead of records")
    parser.add_argument("--codecs", action="store_true", help="print the supported codecs")
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("-p", "--pretty", action="store_true", help="indent the output")
    said = parser.parse_args(args)
    indent = 4 if said.pretty else None
    if said.codecs:
        print("\n".join(sorted(CODECS)))
        return 0
    for name in said.files or ["-"]:
        with tempfile.NamedTemporaryFile() as copy:
            if name == "-":
                shutil.copyfileobj(sys.stdin.buffer, copy)
                copy.flush()
                name = copy.name
            with open_file(name) as f:
                header = read_header(f)
                if said.schema:
                    print(json.dumps(json.loads(header.metadata["avro.schema"]), indent=indent))
                    continue
                if said.metadata:
                    print(json.dumps({k: v.decode() for k, v in header.metadata.items() if k != "avro.schema"}, indent=indent))
                    continue
                decoder = Decoder(header.schema())
                for b, raw in blocks(f, header):
                    for records in decode_blocks([decompress(header.codec, raw)], [b.count], decoder):
                        for r in records.to_pylist(maps_as_pydicts="strict"):
                            print(json.dumps(r, default=plain, indent=indent))
    return 0


if __name__ == "__main__":
    sys.exit(main())
