"""Files of any file system that Arrow knows; paths without a scheme are local."""

from __future__ import annotations

import glob
import os

import pyarrow.fs as fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def scheme(path: str) -> str:
    return path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""


def found(path: str) -> list[tuple[str, int, int]]:
    """(file, size, time in ns) of the data files of comma-separated paths: files, folders or patterns; names that begin with . or _
    are none. The time of a local file is that of its last change of name or content."""
    out: list[tuple[str, int, int]] = []
    for one in path.split(","):
        system, inner = at(one)
        if isinstance(system, fs.LocalFileSystem):
            names = sorted(os.path.join(d, f) for d, _, some in os.walk(inner) for f in some) if os.path.isdir(inner) else sorted(glob.glob(inner)) or [inner]
            stats = [(x, os.stat(x)) for x in names if os.path.basename(x)[:1] not in (".", "_") and os.path.exists(x)]
            out += [(x, s.st_size, max(s.st_ctime_ns, s.st_mtime_ns)) for x, s in stats]
            if not stats and not os.path.exists(inner):
                out.append((inner, 0, 0))  # opening it tells what is wrong
            continue
        info = system.get_file_info(inner)
        some = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
        out += sorted((scheme(one) + x.path, x.size, x.mtime_ns or 0) for x in some if x.is_file and x.base_name[:1] not in (".", "_"))
    return out


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def make(folder: str) -> None:
    system, inner = at(folder)
    system.create_dir(inner, recursive=True)


def exists(path: str) -> bool:
    system, inner = at(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def create(path: str):
    system, inner = at(path)
    return system.open_output_stream(inner)


def move(old: str, new: str) -> None:
    system, inner = at(old)
    system.move(inner, at(new)[1])


def remove(path: str) -> None:
    system, inner = at(path)
    if system.get_file_info(inner).is_file:
        system.delete_file(inner)
