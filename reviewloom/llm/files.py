"""Binary files in the folder that all executors share.

Tasks write and read through ``pyarrow.fs``, so the folder can be a local
mount or any store pyarrow knows. A file is written under a name of its own
attempt and listed by the task that finished it, so that a lost executor
leaves at worst an unlisted file.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def resolve(path: str):
    """File system and path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@contextmanager
def new_file(folder: str, suffix: str):
    """Yields (path, stream); the file gets its final name when the block ends well."""
    system, inner = resolve(folder)
    system.create_dir(inner, recursive=True)
    name = uuid.uuid4().hex
    partial = f"{inner}/_{name}{suffix}.partial"
    with system.open_output_stream(partial, compression=None) as stream:
        yield f"{folder}/{name}{suffix}", stream
    system.move(partial, f"{inner}/{name}{suffix}")


def open_file(path: str):
    system, inner = resolve(path)
    return system.open_input_file(inner)


def open_stream(path: str):
    system, inner = resolve(path)
    return system.open_input_stream(inner, compression=None)
