"""``df.write.format("callmatrix")``: calls as a matrix in CSV parts, a line for each marker and a field for each sample.

Rows are (snp_id, sample_idx, call) in the order of ``ordered()``: ranges of markers are dealt to tasks by one shuffle, and a task
writes its lines as they pass, a marker at a time, so neither a pivot nor a column for each sample is planned.  The header
stands once, in a part of its own.  Parts get their names, in the order of their markers, when all tasks are done; a failed write leaves none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .places import Folder

#: Characters that a task gathers before they go to its file.
HEADER, PIECE = "SNP_ID", 1 << 24


@dataclass
class Part(WriterCommitMessage):
    first: int | None
    last: int | None
    files: list[str]


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = Folder(options["path"]), overwrite
        self.samples = options["samples"].split("\n") if options.get("samples") else []

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        width, first, last, lines, size, files = len(self.samples), None, None, [], 0, []
        fields: list[str] = []

        def line(marker: int) -> None:
            nonlocal first, size
            first = marker if first is None else first
            lines.append(f"{marker},{','.join(fields)}\n")
            size += len(lines[-1])
            if size > PIECE:
                flush()

        def flush() -> None:
            nonlocal size
            if lines:
                files.append(self.folder.write("".join(lines).encode()))
            lines.clear()
            size = 0

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            ids, at, calls = rows["snp_id"].to_numpy(), rows["sample_idx"].to_numpy(), rows["call"].to_pylist()
            ends = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(ends, ends[1:], strict=False):
                if a == b:
                    continue
                marker = int(ids[a])
                if marker != last:
                    if last is not None:
                        if marker < last:
                            raise ValueError("markers don't ascend: write ordered() rows")
                        line(last)
                    last, fields = marker, [""] * width
                for k, call in zip(at[a:b].tolist(), calls[a:b], strict=True):
                    fields[k] = call or ""
        if last is not None:
            line(last)
        flush()
        return Part(first, last, files)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.first is not None), key=lambda m: m.first)
        if any(a.last >= b.first for a, b in zip(parts, parts[1:], strict=False)):
            self.folder.clear()
            raise ValueError("a marker's rows are in several places: write ordered() rows")
        head = self.folder.write(f"{','.join([HEADER, *self.samples])}\n".encode())
        files = [head, *(f for m in parts for f in m.files)]
        self.folder.publish([(f, f"part-{k:06d}.csv") for k, f in enumerate(files)], self.overwrite)

    def abort(self, messages: list[Part | None]) -> None:
        self.folder.clear()


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "callmatrix"

    def schema(self) -> str:
        return "snp_id long, sample_idx int, call string"

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


def ordered(called: DataFrame) -> DataFrame:
    """Rows (snp_id, sample_idx, call), ranges of markers in tasks, ascending."""
    return called.select("snp_id", "sample_idx", "call").repartitionByRange("snp_id").sortWithinPartitions("snp_id", "sample_idx")


def write_matrix(called: DataFrame, samples: list[str], path: str) -> None:
    """The calls (snp_id, sample_idx, call) of all samples, whose names are those of their numbers, as the matrix at ``path``."""
    called.sparkSession.dataSource.register(MatrixSource)
    ordered(called).write.format("callmatrix").option("samples", "\n".join(samples)).mode("overwrite").save(path)


def read_matrix(spark: SparkSession, path: str, samples: int) -> DataFrame:
    """snp_id, s0, s1, ... of a written matrix; empty fields are null."""
    names = [f"s{k}" for k in range(samples)]
    lines = spark.read.schema(", ".join(["snp_id string", *(f"{n} string" for n in names)])).csv(f"{path}/part-*.csv")
    return lines.where(F.col("snp_id") != HEADER).select(F.col("snp_id").cast("long").alias("snp_id"), *names)
