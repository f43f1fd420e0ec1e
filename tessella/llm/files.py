"""Files that executors write and read themselves, in the shared folder, by its URI (any file system that pyarrow knows)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


@contextmanager
def new_file(folder: str, name: str) -> Iterator[tuple[object, str]]:
    """An output stream and the path that it has once closed. Each attempt of a task writes a file of its own, and
    only files that reached their end are named in a manifest, so a lost or repeated task leaves no half file in use."""
    system, base = _at(folder)
    system.create_dir(base, recursive=True)
    stem, dot, ending = name.partition(".")
    path = f"{stem}-{uuid.uuid4().hex[:12]}{dot}{ending}"
    with system.open_output_stream(f"{base}/{path}") as out:
        yield out, f"{folder}/{path}"


def open_stream(path: str):
    """For reading from start to end."""
    system, at = _at(path)
    return system.open_input_stream(at)


def open_file(path: str):
    """For reading at any place."""
    system, at = _at(path)
    return system.open_input_file(at)
