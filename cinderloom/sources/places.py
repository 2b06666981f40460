"""Files that Python itself opens: any file system that Arrow knows, and folders whose files appear only when a write is committed."""

from __future__ import annotations

import os
import posixpath
import re
import uuid

from pyarrow import fs

#: Schemes of file systems that Arrow opens by itself; anything else is read through Spark.
SCHEMES = {"", "file", "s3", "gs", "abfs", "abfss"}


def scheme(path: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found[1].lower() if found else ""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if scheme(path) in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/*(?=/)", "", path))
    return fs.FileSystem.from_uri(path)


class Folder:
    """A folder that is written by many tasks: files are made below a hidden name and moved when all tasks are done.

    The driver makes the hidden place and takes it away, so a task that is late after a failure has nowhere to write.
    """

    def __init__(self, path: str):
        self.path, self.hidden = path, f"_writing-{uuid.uuid4().hex}"
        files, root = opened(path)
        files.create_dir(posixpath.join(root, self.hidden), recursive=True)

    def write(self, data: bytes) -> str:
        """A new hidden file with these bytes; its name."""
        files, root = opened(self.path)
        name = posixpath.join(root, self.hidden, uuid.uuid4().hex)
        with files.open_output_stream(name) as f:
            f.write(data)
        return name

    def publish(self, moves: list[tuple[str, str]], overwrite: bool) -> None:
        """Move hidden files to their names; what lay in the folder goes first if it is overwritten."""
        files, root = opened(self.path)
        for old in files.get_file_info(fs.FileSelector(root)):
            if overwrite and posixpath.basename(old.path) != self.hidden:
                files.delete_dir(old.path) if old.type == fs.FileType.Directory else files.delete_file(old.path)
        for hidden, name in moves:
            files.move(hidden, posixpath.join(root, name))
        self.clear()

    def clear(self) -> None:
        files, root = opened(self.path)
        if files.get_file_info(place := posixpath.join(root, self.hidden)).type == fs.FileType.Directory:
            files.delete_dir(place)
