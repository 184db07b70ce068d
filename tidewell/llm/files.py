"""Opening files of the shared folder inside Python workers, by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str):
    """(filesystem, path) of a URI or an absolute path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put(uri: str, write) -> None:
    """Call ``write(stream)`` on a private name and move the file in place: attempts of one task never mix."""
    store, path = resolve(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(private, compression=None) as out:
        write(out)
    store.move(private, path)
