"""Files in the shared folder, read and written by tasks through Arrow's file systems (local, HDFS, S3, ...)."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", uri))


def write_whole(uri: str, parts: list[bytes]) -> None:
    """Write under another name and rename, so a file is whole or absent and a repeated task replaces it."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    system.move(draft, path)


def read_whole(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read()


def read_part(uri: str, begin: int, size: int) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, begin)
