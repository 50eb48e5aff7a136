"""Files that tasks write to and read from the shared folder, by URI (no local paths assumed)."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of ``file:/x``, ``file:///x``, ``/x``, ``hdfs://...``, ``s3://...``."""
    if re.match(r"file:/(?!//)", uri):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write under a name of its own, then move into place: a repeated or lost task attempt
    leaves either nothing or the same complete file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    if fs.get_file_info(path).type == pafs.FileType.File:
        fs.delete_file(path)
    fs.move(tmp, path)


def get(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def listing(uri: str, suffix: str) -> list[tuple[str, int]]:
    """``(path, size)`` of the files directly in a folder, sorted by path."""
    fs, path = filesystem(uri)
    found = fs.get_file_info(pafs.FileSelector(path))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix))
