"""Files that Python workers write to and read from the shared folder, by any store pyarrow knows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """(filesystem, path) of a URI; a path without a scheme is local."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


@contextmanager
def committed(folder: str, suffix: str):
    """(stream, path): a new file that gets its final name only once it is whole.

    Each attempt of a task takes a name of its own, and only names in the rows of attempts that
    succeeded are read later; what a lost executor leaves is never seen.
    """
    fs, base = open_fs(folder)
    name = uuid.uuid4().hex
    fs.create_dir(base, recursive=True)
    tmp, final = f"{base}/_{name}.tmp", f"{base}/{name}{suffix}"
    with fs.open_output_stream(tmp) as out:
        yield out, f"{folder}/{name}{suffix}"
    fs.move(tmp, final)
