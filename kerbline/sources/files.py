"""Single files for tasks that must open or write them, and a sink of many small named text files.

Paths are of a file system that tasks reach: a plain path or ``file:`` for a folder all of them share, or a scheme
that pyarrow knows (``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def system_of(path: str):
    """The file system of a path, and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A file to read and seek in."""
    system, inside = system_of(path)
    return system.open_input_file(inside)


@contextmanager
def drafted(path: str):
    """A stream to write a file under another name; it is moved into place at the end, so a lost task leaves none by halves."""
    system, inside = system_of(path)
    system.create_dir(inside.rpartition("/")[0], recursive=True)
    draft = f"{inside}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, inside)


def with_scheme(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers take it: one without a scheme is of the default file system."""
    if ":" in path.split("/", 1)[0]:
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if default.startswith("file:") else default.rstrip("/") + path


class _TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.stage = f"{self.path}/_stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        folders = set()
        for row in iterator:
            folder = row["folder"] or ""
            folders.add(folder)
            with drafted("/".join(x for x in (self.stage, folder, row["name"]) if x)) as out:
                out.write((row["text"] or "").encode())
        message = WriterCommitMessage()
        message.folders = tuple(sorted(folders))
        return message

    def commit(self, messages: list) -> None:
        """Put whole folders in place; before this, readers see nothing of the new files."""
        system, stage = system_of(self.stage)
        _, path = system_of(self.path)
        from pyarrow import fs

        if self.overwrite:
            for found in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if found.path.rstrip("/") != stage.rstrip("/"):
                    system.delete_dir(found.path) if found.type == fs.FileType.Directory else system.delete_file(found.path)
        for folder in sorted({f for m in messages if m is not None for f in m.folders}):
            source = f"{stage}/{folder}" if folder else stage
            for found in system.get_file_info(fs.FileSelector(source)) if not folder or not self.overwrite else ():
                if found.type != fs.FileType.Directory:
                    system.create_dir(f"{path}/{folder}".rstrip("/"), recursive=True)
                    system.move(found.path, f"{path}/{folder}/{found.base_name}".replace("//", "/"))
            if folder and self.overwrite:
                system.create_dir(f"{path}/{folder}".rpartition("/")[0], recursive=True)
                system.move(source, f"{path}/{folder}")
        if system.get_file_info(stage).type != fs.FileType.NotFound:
            system.delete_dir(stage)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, stage = system_of(self.stage)
        if system.get_file_info(stage).type != fs.FileType.NotFound:
            system.delete_dir(stage)


class TextFiles(DataSource):
    """A sink of named text files: rows are ``(folder, name, text)``, an empty text is an empty file."""

    @classmethod
    def name(cls) -> str:
        return "named_text_files"

    def schema(self) -> str:
        return "folder string, name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TextFilesWriter(self.options["path"], overwrite)


def write_text_files(files: DataFrame, path: str) -> None:
    """Write ``(folder, name, text)`` as files ``<path>/<folder>/<name>``, replacing what was there when all are written.

    Tasks write into a folder of their own beside the old files; the commit moves whole folders into place. Folders
    do not lie in each other.
    """
    files.sparkSession.dataSource.register(TextFiles)
    files.select("folder", "name", "text").write.format("named_text_files").mode("overwrite").option("path", path).save()
