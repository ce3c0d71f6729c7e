"""Files by path or URI: local ones, and every store that Arrow reaches (hdfs, s3, gs, abfs).

The driver and the executors use these alike, so nothing depends on a shared mount."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    path = str(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def join(path: str, *parts: str) -> str:
    return posixpath.join(str(path), *parts)


def _info(path: str) -> fs.FileInfo:
    store, inner = at(path)
    return store.get_file_info(inner)


def exists(path: str) -> bool:
    return _info(path).type != fs.FileType.NotFound


def is_file(path: str) -> bool:
    return _info(path).type == fs.FileType.File


def is_dir(path: str) -> bool:
    return _info(path).type == fs.FileType.Directory


def size(path: str) -> int:
    return _info(path).size or 0


def listing(path: str, recursive: bool = False) -> list[tuple[str, bool]]:
    """(path, is a folder) of what is below a folder, in order, in the notation of ``path``."""
    store, inner = at(path)
    found = store.get_file_info(fs.FileSelector(inner, recursive=recursive, allow_not_found=True))
    lead = len(inner.rstrip("/"))
    return sorted((str(path).rstrip("/") + f.path[lead:], f.type == fs.FileType.Directory) for f in found)


def open_input(path: str):
    """A file to read and seek in."""
    store, inner = at(path)
    return store.open_input_file(inner)


def read(path: str) -> bytes:
    with open_input(path) as file:
        return file.read()


def write(path: str, data: bytes) -> None:
    with create(path) as file:
        file.write(data)


def create(path: str):
    """A new file to write to; its folders are made."""
    store, inner = at(path)
    store.create_dir(posixpath.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


def move(old: str, new: str) -> None:
    """In one store; what was there before goes."""
    store, inner = at(old)
    goal = at(new)[1]
    store.create_dir(posixpath.dirname(goal), recursive=True)
    remove(new)
    store.move(inner, goal)


def remove(path: str) -> None:
    store, inner = at(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        store.delete_dir(inner)
    elif info.type == fs.FileType.File:
        store.delete_file(inner)
