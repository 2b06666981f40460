"""``df.write.format("files")``: each row (name, content) becomes a file of that name; all appear when the write is committed, or none."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .places import Folder


@dataclass
class Named(WriterCommitMessage):
    moves: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = Folder(options["path"]), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Named:
        moves = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for name, content in zip(rows["name"].to_pylist(), rows["content"].to_pylist(), strict=True):
                moves.append((self.folder.write(content), name))
        return Named(moves)

    def commit(self, messages: list[Named | None]) -> None:
        moves = [m for x in messages if x for m in x.moves]
        if len({name for _, name in moves}) < len(moves):
            self.folder.clear()
            raise ValueError("two rows have one name")
        self.folder.publish(moves, self.overwrite)

    def abort(self, messages: list[Named | None]) -> None:
        self.folder.clear()


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options, overwrite)


def write_files(rows: DataFrame, path: str) -> None:
    """Rows (name, content) as files below ``path``, in place of what lay there."""
    rows.sparkSession.dataSource.register(FilesSource)
    rows.select("name", "content").write.format("files").mode("overwrite").save(path)
