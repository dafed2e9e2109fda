"""A sink of binary files: one file for each row, for page images and other results that are files by nature.

``write_files`` is a Spark data source: each task writes its files under names of its own, and the driver's commit moves none of the
contents, only lets tasks' files stand.  A file is written to a draft name first and put in place whole, so that a reader never sees
half a file, and a task that runs again writes the same files again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from marlgate.shipping import ship


def as_uri(path: str) -> str:
    """Spark writes local paths as file:/x, which others read as file:///x."""
    return f"file:///{path[6:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def read_bytes(path: str) -> bytes:
    """The content of a file, wherever it lies."""
    from pyarrow.fs import FileSystem

    fs, place = FileSystem.from_uri(as_uri(path))
    with fs.open_input_file(place) as f:
        return f.read()


@dataclass
class Stored(WriterCommitMessage):
    files: int
    size: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stored:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(as_uri(self.path))
        made, files, size = set(), 0, 0
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place = f"{root}/{name}"
                folder = place.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                raw = content.as_buffer() or pa.py_buffer(b"")
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(raw)
                fs.move(draft, place)
                files, size = files + 1, size + raw.size
        return Stored(files, size)

    def commit(self, messages: list[Stored | None]) -> None:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(as_uri(self.path))
        fs.create_dir(root, recursive=True)
        fs.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[Stored | None]) -> None:
        """What was written stays: the next run puts the same files in their places."""


class FileSink(DataSource):
    """``format("files")``: rows of (name, content), names relative to the option path."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def write_files(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """Writes a file for each row; equal names are the same file, and rows without a name or content are left out."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(FileSink)
    kept = rows.where(F.col(name).isNotNull() & F.col(content).isNotNull())
    kept.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).write.format("files").mode("append").save(path)
