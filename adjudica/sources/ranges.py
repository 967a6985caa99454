"""Byte ranges, listings and small writes in any store, alike on the driver and in tasks.

Paths are plain or URIs. Local files, HDFS and object stores go through Arrow's file
systems, and a scheme that Arrow doesn't know through the Hadoop client.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs

#: Headers asked for at a time.
THREADS = 16


def at(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path there, what to put before such a path to have a URI again)."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", path)
    if scheme is None:
        return fs.LocalFileSystem(), path, ""
    if scheme[1] == "file":
        inner = re.sub("^file:/*", "/", path)
        return fs.LocalFileSystem(), inner, "file://"
    uri = re.sub("^s3[an]:", "s3:", path)
    try:
        system, inner = fs.FileSystem.from_uri(uri)
    except (ValueError, NotImplementedError):  # no scheme of Arrow's: the Hadoop client may know it
        root = re.match(r"[^:]+://[^/]*", path)[0]
        system, inner = fs.HadoopFileSystem(root), path[len(root) :]
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def canonical(path: str) -> str:
    """The path as listings give it."""
    _, inner, before = at(path)
    return before + inner


def join(folder: str, *names: str) -> str:
    return posixpath.join(folder.rstrip("/"), *names)


def files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files with that suffix, in name order; hidden ones are left out."""
    system, inner, before = at(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    kept = [i for i in found if i.type == fs.FileType.File and i.path.endswith(suffix) and not i.base_name.startswith((".", "_"))]
    return [(before + i.path, i.size) for i in sorted(kept, key=lambda i: i.path)]


def exists(path: str) -> bool:
    system, inner, _ = at(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


class Ranges:
    """One file, read by ranges."""

    def __init__(self, path: str):
        system, inner, _ = at(path)
        self.path, self.file = path, system.open_input_file(inner)

    def read(self, start: int, length: int) -> bytes:
        """Exactly these bytes; a shorter file is an error."""
        raw = self.file.read_at(length, start)
        if len(raw) != length:
            raise ValueError(f"{self.path} ends before byte {start + length}")
        return raw

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def headers(paths: Iterable[str], read) -> list:
    """``read(path)`` for each path, several at a time."""
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(read, paths))


def create(path: str):
    """A stream to a new file; its folder is made."""
    system, inner, _ = at(path)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    return system.open_output_stream(inner)


def put(path: str, raw: bytes) -> None:
    """A small file that appears whole: written under another name in its folder, then renamed over the old one."""
    aside = join(posixpath.dirname(path), f".{posixpath.basename(path)}.new")
    with create(aside) as out:
        out.write(raw)
    move(aside, path)


def get(path: str) -> bytes:
    system, inner, _ = at(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def move(source: str, target: str) -> None:
    """Rename within a store; the target's folder is made."""
    system, inner, _ = at(source)
    to = at(target)[1]
    if posixpath.dirname(to) != posixpath.dirname(inner):
        system.create_dir(posixpath.dirname(to), recursive=True)
    system.move(inner, to)


def remove(path: str) -> None:
    """A file or a folder with all that is in it; nothing if it isn't there."""
    system, inner, _ = at(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        system.delete_dir(inner)
    elif kind != fs.FileType.NotFound:
        system.delete_file(inner)
