"""Files in any store that pyarrow.fs opens: local paths, URIs, or a store that a function makes.

A ``factory`` is "module:function", importable on the driver and the executors; it returns a pyarrow FileSystem, and paths
are then the store's own. Missing folders list nothing; hidden files (a name that begins with a dot) are listed only if asked
for. No step needs a rename to be atomic; only files of tensors are read at chosen places.
"""

from __future__ import annotations

import importlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs


class Store:
    """A folder of a store."""

    def __init__(self, path: str, factory: str = ""):
        if factory:
            module, _, name = factory.partition(":")
            self.fs, self.root = getattr(importlib.import_module(module), name)(), path
        elif "://" in path and not path.startswith("file:"):
            self.fs, self.root = fs.FileSystem.from_uri(path)
        else:
            self.fs, self.root = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
        self.root = self.root.rstrip("/") or "/"

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def names(self, suffix: str = "", hidden: bool = False) -> list[str]:
        """The files directly in the folder, sorted."""
        return sorted(n for n, is_file in self.entries() if is_file and n.endswith(suffix) and (hidden or not n.startswith(".")))

    def entries(self, folder: str | None = None) -> Iterator[tuple[str, bool]]:
        """(name, is a file) of what a folder holds. A local one is read without looking at each file or holding their names."""
        if isinstance(self.fs, fs.LocalFileSystem):
            try:
                with os.scandir(folder or self.root) as found:
                    yield from ((e.name, e.is_file()) for e in found if e.is_file() or e.is_dir())
            except FileNotFoundError:
                pass
            return
        found = self.fs.get_file_info(fs.FileSelector(folder or self.root, allow_not_found=True))
        yield from ((i.base_name, i.type == fs.FileType.File) for i in found if i.type in (fs.FileType.File, fs.FileType.Directory))

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(self.at(name)).type == fs.FileType.File

    def reader(self, name: str) -> pa.NativeFile:
        return self.fs.open_input_stream(self.at(name), compression=None)

    def random(self, name: str) -> pa.NativeFile:
        """A file to read at any place."""
        return self.fs.open_input_file(self.at(name))

    def size(self, name: str) -> int:
        return self.fs.get_file_info(self.at(name)).size

    def read(self, name: str) -> bytes:
        with self.reader(name) as f:
            return f.read()

    def writer(self, name: str) -> pa.NativeFile:
        return self.fs.open_output_stream(self.at(name), compression=None)

    def write(self, name: str, body: bytes) -> None:
        with self.writer(name) as f:
            f.write(body)

    def make(self) -> None:
        self.fs.create_dir(self.root, recursive=True)

    def move(self, name: str, to: str) -> None:
        """A file that has the new name goes first: not every store replaces it."""
        if self.exists(to):
            self.remove(to)
        self.fs.move(self.at(name), self.at(to))

    def remove(self, name: str) -> None:
        self.fs.delete_file(self.at(name))
