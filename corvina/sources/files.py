"""A sink of one file a row with a commit protocol, as a Python data source.

Tasks stage their files below the target; only when all tasks have ended are those of the attempts that Spark committed moved
in, with their folders. A failed job, and attempts that were lost or run twice, leave no file behind.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "corvina_files"
STAGING = "_staging"
#: Moves under way at a time when a job commits.
MOVES = 32


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)


def store_of(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub("^file:(//)?", "", path).rstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def checked(name: str | None) -> str:
    """A name that stays below the target: relative, without empty, '.' or '..' parts, and not the staging folder."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts) or parts[0] == STAGING:
        raise ValueError(f"not a file name below a folder: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class FileSink(DataSource):
    """Rows (name, content): content goes to the file name, folders included, below the option path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], overwrite)


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows) -> Staged:
        """Stage a task's rows. A name that comes twice in a job is an error in a task, and the last to move in across tasks."""
        store, root = store_of(self.path)
        folder, names = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", set()
        for row in rows:
            name = checked(row.name)
            if name in names:
                raise ValueError(f"two files are called {name!r}")
            names.add(name)
            store.create_dir(f"{folder}/{name}".rsplit("/", 1)[0])
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(row.content or b""))
        return Staged(folder, sorted(names))

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        store.create_dir(root)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name != STAGING:
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        staged = [(m.folder, n) for m in messages if m is not None for n in m.names]
        for folder in sorted({n.rsplit("/", 1)[0] for _, n in staged if "/" in n}):
            store.create_dir(f"{root}/{folder}")
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda x: store.move(f"{x[0]}/{x[1]}", f"{root}/{x[1]}"), staged))
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*store_of(self.path))

    def _clear(self, store, root: str) -> None:
        """Delete this job's staging, with what lost attempts left there, and the staging folder if no other job uses it."""
        from pyarrow import fs

        if store.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}/{self.job}")
        if store.get_file_info(f"{root}/{STAGING}").type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            store.delete_dir(f"{root}/{STAGING}")
