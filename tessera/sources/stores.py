"""Files and folders of any store that pyarrow knows, for code that runs in Python tasks."""

from __future__ import annotations

import re

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a plain path or a URI."""
    if local := re.match(r"file:/*(/.*)$", path):
        path = local[1]
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def exists(at: fs.FileSystem, path: str) -> bool:
    return at.get_file_info(path).type != fs.FileType.NotFound


def drop(at: fs.FileSystem, path: str) -> None:
    """Remove a folder or file if it is there."""
    kind = at.get_file_info(path).type
    if kind == fs.FileType.Directory:
        at.delete_dir(path)
    elif kind == fs.FileType.File:
        at.delete_file(path)


def replace(at: fs.FileSystem, path: str, content: bytes, tag: str) -> None:
    """Write a small file beside ``path`` and rename it there, so that readers see the old content or the new."""
    with at.open_output_stream(f"{path}.tmp-{tag}") as out:
        out.write(content)
    at.move(f"{path}.tmp-{tag}", path)
