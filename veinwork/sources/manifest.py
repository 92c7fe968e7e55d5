"""Small JSON files in folders that Spark writes too; a file is replaced by a rename."""

from __future__ import annotations

import json
import posixpath
import uuid


def file_system(folder: str):
    """(Arrow's file system, path) of a folder; Spark writes ``file:/x`` where Arrow wants ``file:///x``."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = f"file://{folder[5:]}"
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def read_json(folder: str, name: str) -> dict | None:
    from pyarrow import fs

    files, path = file_system(folder)
    at = posixpath.join(path, name)
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(at) as f:
        return json.loads(f.read())


def replace_json(folder: str, name: str, value: dict) -> None:
    """Write under another name, then rename: readers see the old file or the new one."""
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    at = posixpath.join(path, f".{name}-{uuid.uuid4().hex}")
    with files.open_output_stream(at) as f:
        f.write(json.dumps(value).encode())
    files.move(at, posixpath.join(path, name))
