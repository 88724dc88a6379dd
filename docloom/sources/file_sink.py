"""A sink of one text file per row, as a Python data source.

Tasks write their files into a staging folder beside the target; the commit moves them to
their places, after what stood there was set aside as .bak, once: an older backup stays.
A task that fails or is repeated leaves nothing but staged files, which the commit or the
abort removes. Paths go through pyarrow's file systems, so any shared store will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

NAME = "docloom_text_files"
BACKUP = ".bak"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Staged(WriterCommitMessage):
    """What one task has staged: (staged file, place)."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, backup: bool) -> None:
        self.path, self.backup = path.rstrip("/"), backup
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = _open(self.path)
        own, files = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        for n, row in enumerate(iterator):
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"no place under the target: {name!r}")
            with store.open_output_stream(f"{own}/{n}") as out:
                out.write((row["text"] or "").encode())
            files.append((f"{own}/{n}", f"{root}/{name}"))
        return _Staged(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = _open(self.path)
        places = [place for m in messages if m for _, place in m.files]
        if len(places) != len(set(places)):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        is_file = lambda p: store.get_file_info(p).type == fs.FileType.File
        for message in messages:
            for staged, place in message.files if message else ():
                store.create_dir(place.rpartition("/")[0], recursive=True)
                if is_file(place):
                    if self.backup and not is_file(place + BACKUP):
                        store.move(place, place + BACKUP)
                    else:
                        store.delete_file(place)
                store.move(staged, place)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = _open(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class TextFiles(DataSource):
    """Rows (name: a path under the target; text). Option backup (true)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("backup", "true").lower() == "true")


def write_files(rows: DataFrame, path: str, backup: bool = True) -> None:
    """Writes each of rows (name, text) to the file of that name under path. Files of other
    names stay. Nothing is moved to its place before every task has staged its rows."""
    register(rows.sparkSession)
    rows.select("name", "text").write.format(NAME).option("backup", str(backup).lower()).mode("append").save(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFiles)
