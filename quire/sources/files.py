"""File systems inside tasks: any that pyarrow opens by URI (local, HDFS, S3, GCS, Azure), as executors have no Spark of their own."""

from __future__ import annotations

import re

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match("file:/(?!/)", uri):  # as Spark writes local paths
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def files_under(uri: str) -> list[fs.FileInfo]:
    """All files under a folder, or the one file that is named; none where there is nothing."""
    system, path = file_system(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    return [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True)) if f.type == fs.FileType.File]
