"""A data source that writes one text file a row."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class TextFiles(DataSource):
    """``df.write.format("text_files").save(path)``: columns ``name`` and ``value``, in UTF-8.

    A task writes into a folder of its own attempt, under ``<path>/_pending-<run>``.  When
    all tasks are done, the driver moves the files to ``<path>/<name>``, each at once;
    when one fails for good, the pending folder goes and the path is as it was before.
    Mode ``append`` replaces files of the same name and leaves others; ``overwrite`` first
    deletes all files of the path, those of its folders not included.  Names must be
    plain file names; a null value is an empty file.  Of rows of one name one counts,
    so names should tell the content or be unique.

    For exports, whose files the driver can list, as readers of them must.
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [(f.name, f.dataType.simpleString()) for f in schema] != [("name", "string"), ("value", "string")]:
            raise ValueError("text_files takes the columns name and value, both strings")
        return _Writer(self.options["path"], overwrite)


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path belongs to, and its name there."""
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex
        fs, base = _system(self.path)
        fs.create_dir(self._pending(base), recursive=True)

    def _pending(self, base: str) -> str:
        return posixpath.join(base, f"_pending-{self.run}")

    def write(self, iterator: Iterator[Row]) -> _Written:
        fs, base = _system(self.path)
        task = TaskContext.get()
        folder = posixpath.join(self._pending(base), f"{task.partitionId()}-{task.taskAttemptId()}")
        fs.create_dir(folder, recursive=False)  # once the run is aborted, a task that begins late finds no place to write to
        names: list[str] = []
        for row in iterator:
            name = row["name"]
            if not name or name != posixpath.basename(name) or name.startswith(("_", ".")):
                raise ValueError(f"not the plain name of a file that readers see: {name!r}")
            with fs.open_output_stream(posixpath.join(folder, name)) as f:
                f.write((row["value"] or "").encode("utf-8"))
            names.append(name)
        return _Written(folder, sorted(set(names)))

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base = _system(self.path)
        fs.create_dir(base, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(base)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        for m in messages:
            for name in m.names if m else []:
                fs.move(posixpath.join(m.folder, name), posixpath.join(base, name))
        self._clear(fs, base)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_system(self.path))

    def _clear(self, fs: pafs.FileSystem, base: str) -> None:
        if fs.get_file_info(self._pending(base)).type == pafs.FileType.Directory:
            fs.delete_dir(self._pending(base))


def write(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``name`` and ``value`` as files."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(TextFiles)
    files.select("name", "value").write.format("text_files").mode(mode).save(path)
