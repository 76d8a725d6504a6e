"""A data source of source trees: every file below a folder, whatever its name.

Spark's own file sources leave out names that begin with _ or a dot, such as __init__.py. This one lists trees itself, and
plans partitions by bytes: files in the order of their paths, up to partition_bytes or MOST_FILES a partition. With `depth`, the
plan lists folders down to that depth only (1 for authors, 2 for their projects) and each task lists what lies below its
folders, so the driver holds as many names as there are projects, not files.

Rows: file (below the root, with slashes), size, content, error. A file or folder that can't be read is a row with an error;
an empty file is a row with empty content. Links to files are read, links to folders aren't followed. A root that isn't there
is an error of the query. Paths are of file systems that all machines share: plain ones, file:, or any that pyarrow opens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, size long, content binary, error string"
PARTITION_BYTES, MOST_FILES, BATCH_BYTES = 128 << 20, 20_000, 8 << 20
#: Bytes that opening a file counts for, as in Spark's own plans of files.
OPENING = 4096


@dataclass
class Part(InputPartition):
    """Files, or folders to list (with a slash at the end), below the root, and what listing them failed with."""

    names: list[str]
    errors: list[tuple[str, str]]


class Local:
    """Files of a mounted file system."""

    def __init__(self, root: str):
        self.root = root

    def kind(self) -> str | None:
        return "file" if os.path.isfile(self.root) else "folder" if os.path.isdir(self.root) else None

    def folder(self, name: str) -> Iterator[tuple[str, bool, int]]:
        """Entries of a folder: name, whether it is a folder, size. A link that leads nowhere is a file."""
        with os.scandir(os.path.join(self.root, name)) as entries:
            for e in entries:
                try:
                    folder, size = e.is_dir(follow_symlinks=False), e.stat().st_size
                except OSError:
                    folder, size = False, 0
                if folder or not os.path.isdir(e.path):
                    yield e.name, folder, size

    def content(self, name: str) -> bytes:
        with open(os.path.join(self.root, name) if name else self.root, "rb") as file:
            return file.read()


class Remote:
    """Files of a store that pyarrow opens."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def kind(self) -> str | None:
        return {"File": "file", "Directory": "folder"}.get(self.fs.get_file_info(self.root).type.name)

    def folder(self, name: str) -> Iterator[tuple[str, bool, int]]:
        from pyarrow import fs

        for e in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{name}".rstrip("/"))):
            yield e.base_name, e.type == fs.FileType.Directory, e.size or 0

    def content(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}" if name else self.root) as file:
            return file.read()


def store(path: str) -> Local | Remote:
    scheme = urlparse(path).scheme if "://" in path or path.startswith("file:") else ""
    if scheme in ("", "file"):
        return Local(unquote(urlparse(path).path) if scheme else path)
    return Remote(path)


def listed(tree: Local | Remote, name: str, suffixes: tuple[str, ...], errors: list[tuple[str, str]]) -> tuple[list[str], list[tuple[str, int]]]:
    """Folders and files (with sizes) of one folder, sorted; what went wrong goes to errors."""
    folders, files = [], []
    try:
        for entry, is_folder, size in tree.folder(name):
            if is_folder:
                folders.append(f"{name}{entry}/")
            elif entry.endswith(suffixes):
                files.append((f"{name}{entry}", size))
    except OSError as error:
        errors.append((name, str(error)))
    return sorted(folders), sorted(files)


def walk(tree: Local | Remote, name: str, suffixes: tuple[str, ...], errors: list[tuple[str, str]]) -> Iterator[tuple[str, int]]:
    todo = [name]
    while todo:
        folders, files = listed(tree, todo.pop(), suffixes, errors)
        yield from files
        todo += reversed(folders)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.suffixes = tuple(options.get("suffixes", ".py").split(","))
        self.bytes, self.depth = int(options.get("partition_bytes", PARTITION_BYTES)), int(options.get("depth", 0))

    def partitions(self) -> list[Part]:
        tree, errors = store(self.root), []
        if (kind := tree.kind()) is None:
            raise FileNotFoundError(f"no such file or folder: {self.root}")
        if kind == "file":
            return [Part([""], [])]
        found: list[tuple[str, int]] = []
        level, at = [""], 0
        while level and not (self.depth and at == self.depth):
            below = [listed(tree, name, self.suffixes, errors) for name in level]
            level, at = [f for folders, _ in below for f in folders], at + 1
            found += [f for _, files in below for f in files]
        found += [(name, self.bytes // 64) for name in level]  # folders of unknown size
        parts, held, names = [], 0, []
        for name, size in sorted(found):
            if names and (held + size > self.bytes or len(names) >= MOST_FILES):
                parts.append(Part(names, []))
                held, names = 0, []
            names.append(name)
            held += size + OPENING
        return [*parts, Part(names, errors)] if names or errors else [*parts, Part([], [])]

    def read(self, partition: Part) -> Iterator:
        import pyarrow as pa

        tree, errors, base = store(self.root), list(partition.errors), os.path.basename(self.root)
        rows, held = [], 0
        kinds = pa.schema([("file", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
        for name in partition.names:
            for file, _ in walk(tree, name, self.suffixes, errors) if name.endswith("/") else [(name, 0)]:
                try:
                    content, error = tree.content(file), None
                except OSError as e:
                    content, error = None, str(e)
                rows.append((_readable(file or base), len(content or b""), content, error))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        rows += [(_readable(name), 0, None, error) for name, error in errors]
        if rows:
            yield batch()


def _readable(name: str) -> str:
    """A name whose bytes aren't UTF-8 with replacement signs."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(root); options suffixes (".py,.pyi"), partition_bytes, depth."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
