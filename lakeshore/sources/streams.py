"""Byte streams of single files inside tasks, for facts that Spark's readers
do not give (a magic number, a footer, a digest, an encoding)."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

#: Schemes as Hadoop names them, and the same store's name here.
SCHEMES = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "hdfs",
           "abfs": "abfs", "abfss": "abfss"}


def filesystem(path: str):
    """(file system, path in it).  An unknown scheme is an error, never a null."""
    import pyarrow.fs as pafs
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return pafs.LocalFileSystem(), path
    scheme = urlsplit(path).scheme.lower()
    if scheme not in SCHEMES or "://" not in path and scheme != "file":
        raise ValueError(f"no byte reader for {path.split('/')[0]} paths")
    if scheme == "file":
        return pafs.LocalFileSystem(), urlsplit(path).path
    return pafs.FileSystem.from_uri(SCHEMES[scheme] + path[len(scheme):])


def open_stream(path: str):
    fs, p = filesystem(path)
    return fs.open_input_stream(p)


def open_file(path: str):
    fs, p = filesystem(path)
    return fs.open_input_file(p)
