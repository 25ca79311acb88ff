"""File systems by URI, for the files that tasks read and write themselves."""

from __future__ import annotations

from pyarrow import fs

#: Schemes by which Spark's Hadoop connectors call a store that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a plain path, and the path within it."""
    scheme, separator, rest = uri.partition("://")
    if separator:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.FileSystem.from_uri(uri) if uri.startswith("file:") else (fs.LocalFileSystem(), uri)
