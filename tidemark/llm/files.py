"""Binary files that tasks write into the shared folder, and the manifest that makes them count.

A task writes each file under a name of its own and returns a manifest row.
The manifest is a table that Spark writes when all tasks are done: files that a
lost or repeated task leaves behind are in no manifest and are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, stem: str, suffix: str, data: bytes) -> str:
    """The name under the folder uri that data was written to."""
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return name


def read_file(uri: str, name: str) -> bytes:
    system, path = open_folder(uri)
    with system.open_input_stream(f"{path}/{name}", compression=None) as source:
        return source.read()
