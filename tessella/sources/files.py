"""A sink for rows that are files: df(name, content).write.format("tessella_files").save(folder).

Executors write each row's bytes under its name by pyarrow's file systems (local, HDFS, S3 and others by the folder's
URI). A file is written under a name of its own and then moved, and a row always gives the same file, so tasks that run
again after an executor is lost only replace files by equal ones. The driver gets counts alone, then adds _SUCCESS.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "tessella_files"


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = opened(self.folder)
        stores = system.type_name in ("s3", "gcs", "abfs")  # these show a file only when it is whole
        made, files, size = set(), 0, 0
        for row in iterator:
            if row["name"] is None or row["content"] is None:
                continue
            name = posixpath.normpath(row["name"])
            if name.startswith(("/", "..")):
                raise ValueError(f"a name outside the folder: {row['name']}")
            path = posixpath.join(root, name)
            parent = posixpath.dirname(path)
            if parent not in made and not stores:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            part = path if stores else posixpath.join(parent, f".{uuid.uuid4().hex}")
            with system.open_output_stream(part) as out:
                out.write(bytes(row["content"]))
            if not stores:
                system.move(part, path)
            files, size = files + 1, size + len(row["content"])
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(posixpath.join(root, "_SUCCESS")):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """Files that are whole stay; without _SUCCESS the folder counts as unfinished."""


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("files need the columns name and content")
        return FilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """name, content: each row a file below folder. Rows without name or content give none; of rows of one name, one stays."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("name", "content").write.format(FORMAT).mode("append").save(folder)
