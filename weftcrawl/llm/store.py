"""Binary files in the shared folder, from any process: the folder's URI decides the file system."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A stream for a new file. Writers give each attempt its own name; only names in a committed manifest count."""
    store, path = at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_file(uri: str):
    store, path = at(uri)
    return store.open_input_file(path)
