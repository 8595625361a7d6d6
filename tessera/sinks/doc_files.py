"""One text file per document, ``id_<id>.txt``: a data source writer.

Tasks write into a staging folder of their own inside the target; only when all have
ended are the files moved to their place, so a failed task, a repeated attempt or a
failed job leaves no file behind. For reading see ``sources.files``: Spark's own text
reader packs many small files into a partition by their bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import patterns as P

STAGING = "_staging"
MOVERS = 16  # files moved at a time when the job ends


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    n_files: int


class DocFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/{STAGING}-{self.job}"

    def write(self, iterator: Iterator) -> Staged:
        fs, root = file_system(self.path)
        folder, n = f"{self._staging(root)}/{uuid.uuid4().hex}", 0
        fs.create_dir(folder, recursive=True)
        for doc_id, body in iterator:
            file = f"{folder}/{P.DOC_FILE_PREFIX}{doc_id}{P.DOC_FILE_SUFFIX}"
            if fs.get_file_info(file).type != pafs.FileType.NotFound:
                raise ValueError(f"two documents with id {doc_id}: they would share a file")
            with fs.open_output_stream(file) as out:
                out.write(body.encode("utf-8"))
            n += 1
        return Staged(folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = file_system(self.path)
        if self.overwrite:
            old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and f.base_name.startswith(P.DOC_FILE_PREFIX)]
        else:
            old = []
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(fs.delete_file, old))
            for m in messages:
                if m is not None:
                    files = [f.path for f in fs.get_file_info(pafs.FileSelector(m.folder))]
                    list(pool.map(lambda f: fs.move(f, f"{root}/{PurePosixPath(f).name}"), files))
        self._clear(fs, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(self._staging(root)).type != pafs.FileType.NotFound:
            fs.delete_dir(self._staging(root))


class DocFilesSource(DataSource):
    """``df(doc_id, body).write.format("doc_files").mode(...).save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "doc_files"

    def schema(self) -> str:
        return "doc_id bigint, body string"

    def writer(self, schema, overwrite: bool) -> DocFilesWriter:
        return DocFilesWriter(self.options["path"], overwrite)
