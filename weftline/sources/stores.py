"""Files by path or address, for sources and sinks that read and write bytes in tasks."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (``file:/...``, ``s3://...``, ``hdfs://...`` or a plain one) and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files under a folder, or of the one file, without hidden ones, by name."""
    store, inside = opened(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(inside, info.size)]
    found = store.get_file_info(fs.FileSelector(inside))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def ranges(size: int, each: int) -> list[tuple[int, int]]:
    """(from, to) of the pieces of ``each`` bytes of a file."""
    return [(k, min(k + each, size)) for k in range(0, size, each)]
