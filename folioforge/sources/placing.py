"""Files placed under their final names: a data source that stages, checks, commits and undoes."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: What is read and written of a file at a time.
STEP = 4 << 20
COLUMNS = "name string, origin string, content binary, sha256 string, quarantined boolean"


class Mismatch(ValueError):
    """A file doesn't have the digest that its record names."""


@dataclass
class Placed(WriterCommitMessage):
    """The folder that a task has staged."""

    folder: str
    files: int
    bytes: int


class PlacingWriter(DataSourceWriter):
    """Every task copies its files, step by step and whatever their size, into a staging folder of its own and
    checks their digests.  The commit moves them to their names under ``path`` or, for quarantined ones, under
    ``quarantine``.  An abort deletes the job's staging folder with its mark ``_open``; a task that is still writing
    then finds no mark and deletes what it has, and what a killed one leaves goes with the next job's end.  A
    repeated task writes to a folder of its own, and only the folders of tasks that are committed are moved."""

    def __init__(self, path: str, quarantine: str | None):
        self.path, self.quarantine = path, quarantine or posixpath.join(path, "_quarantine")
        self.job = posixpath.join(path, f"_staging-{uuid.uuid4().hex}")
        fs, name = FileSystem.from_uri(self.job)
        fs.create_dir(name, recursive=True)
        fs.open_output_stream(posixpath.join(name, "_open")).close()

    def write(self, iterator: Iterator) -> Placed:
        context = TaskContext.get()
        folder = posixpath.join(self.job, f"{context.partitionId()}-{context.taskAttemptId()}")
        files = size = 0
        for row in iterator:
            parts = [p for p in (row.name or "").split("/") if p]
            if not parts or {".", ".."} & set(parts):
                raise ValueError(f"no name for a file: {row.name!r}")
            target = posixpath.join(folder, "quarantine" if row.quarantined else "files", *parts)
            fs, name = FileSystem.from_uri(target)
            fs.create_dir(posixpath.dirname(name), recursive=True)
            digest = hashlib.sha256()
            with fs.open_output_stream(name) as out:
                for piece in self._pieces(row):
                    digest.update(piece)
                    out.write(piece)
                    size += len(piece)
            if row.sha256 and digest.hexdigest() != row.sha256:
                raise Mismatch(f"{row.name}: digest {digest.hexdigest()}, expected {row.sha256}")
            files += 1
        if not self._open(self.job):
            self._drop(self.job)
            raise RuntimeError("the job was given up meanwhile")
        return Placed(folder, files, size)

    @staticmethod
    def _pieces(row) -> Iterator[bytes]:
        if row.origin:
            fs, name = FileSystem.from_uri(row.origin)
            with fs.open_input_stream(name) as source:
                while piece := source.read(STEP):
                    yield piece
        else:
            yield bytes(row.content or b"")

    def commit(self, messages: list) -> None:
        for m in messages:
            for kind, root in (("files", self.path), ("quarantine", self.quarantine)):
                self._move(posixpath.join(m.folder, kind), root)
        self._drop(self.job)
        self._sweep()

    def _move(self, staged: str, root: str) -> None:
        fs, base = FileSystem.from_uri(staged)
        if fs.get_file_info(base).type == FileType.NotFound:
            return
        _, final = FileSystem.from_uri(root)
        for x in fs.get_file_info(FileSelector(base, recursive=True)):
            if x.type == FileType.File:
                name = posixpath.join(final, x.path[len(base) :].lstrip("/"))
                fs.create_dir(posixpath.dirname(name), recursive=True)
                fs.move(x.path, name)

    def abort(self, messages: list) -> None:
        self._drop(self.job)
        self._sweep()

    @staticmethod
    def _open(folder: str) -> bool:
        fs, name = FileSystem.from_uri(posixpath.join(folder, "_open"))
        return fs.get_file_info(name).type == FileType.File

    @staticmethod
    def _drop(folder: str) -> None:
        fs, name = FileSystem.from_uri(folder)
        if fs.get_file_info(name).type != FileType.NotFound:
            mark = posixpath.join(name, "_open")
            if fs.get_file_info(mark).type == FileType.File:
                fs.delete_file(mark)
            fs.delete_dir(name)

    def _sweep(self) -> None:
        """Deletes what tasks of jobs that have ended left behind."""
        fs, name = FileSystem.from_uri(self.path)
        for x in fs.get_file_info(FileSelector(name)):
            if x.type == FileType.Directory and x.base_name.startswith("_staging-") and fs.get_file_info(posixpath.join(x.path, "_open")).type == FileType.NotFound:
                fs.delete_dir(x.path)


class PlacedFiles(DataSource):
    """The format ``placed``: ``df.write.format("placed").mode("append").option("path", uri).save()`` of rows
    (name, origin, content, sha256, quarantined): origin is the captured file, else content is the file.
    Options: path, quarantine, as URIs that all machines see."""

    @classmethod
    def name(cls) -> str:
        return "placed"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> PlacingWriter:
        return PlacingWriter(self.options["path"].rstrip("/"), self.options.get("quarantine"))
