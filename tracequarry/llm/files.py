"""Binary files in the shared folder, reachable from the driver and every executor."""

from __future__ import annotations

import uuid


def open_store(uri: str):
    """(filesystem, path) of a URI, for any store that pyarrow reaches."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, name: str, data: bytes) -> str:
    """Write a file under another name and move it into place, so that a task that runs twice
    leaves one whole file."""
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, f"{path}/{name}")
    return f"{uri.rstrip('/')}/{name}"


def read_whole(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_stream(path) as f:
        return f.read()
