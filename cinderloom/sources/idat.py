"""Two-channel binary array files: discovery, pairing, decoding, and a writer for tests and exports."""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.features import sample_name
from .places import SCHEMES, scheme

#: Fixed values of the file format: field codes, version, most fields.
N_SNPS, IDS, MEANS = 1000, 102, 104
VERSION, MOST_FIELDS = 3, 50_000
NAME = r"^(.*)_(Grn|Green|Red)\.idat(\.gz)?$"


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, means) of a file's bytes, plain or gzipped."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if raw[:4] != b"IDAT":
        raise ValueError("bad magic")

    def read(kind: str, at: int) -> tuple:
        if at + struct.calcsize(kind) > len(raw):
            raise ValueError("short read")
        return struct.unpack_from(kind, raw, at)

    version, fields = read("<QI", 4)
    if version & 0xFFFFFFFF != VERSION:
        raise ValueError("unsupported version")
    if not 1 <= fields <= MOST_FIELDS:
        raise ValueError("unreasonable number of fields")
    where: dict[int, int] = {}
    for i in range(fields):
        code, offset = read("<HQ", 16 + 10 * i)
        where.setdefault(code, offset)
    if missing := {N_SNPS, IDS, MEANS} - where.keys():
        raise ValueError(f"missing field {min(missing)}")
    n = read("<I", where[N_SNPS])[0]
    out = []
    for code, kind in ((IDS, "<u4"), (MEANS, "<u2")):
        if where[code] + n * np.dtype(kind).itemsize > len(raw):
            raise ValueError("short read")
        out.append(np.frombuffer(raw, kind, n, where[code]).astype(np.int64))
    return out[0], out[1]


def encode(ids: np.ndarray, means: np.ndarray) -> bytes:
    """The bytes of a file with these ids and means."""
    ids, means = np.asarray(ids).astype("<u4"), np.asarray(means).astype("<u2")
    start = 16 + 3 * 10
    offsets = {N_SNPS: start, IDS: start + 4, MEANS: start + 4 + ids.nbytes}
    head = b"IDAT" + struct.pack("<QI", VERSION, 3) + b"".join(struct.pack("<HQ", c, o) for c, o in offsets.items())
    return head + struct.pack("<I", len(ids)) + ids.tobytes() + means.tobytes()


def channel_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(base, channel, path) of paths that name a channel file; others are left out."""
    name = F.element_at(F.split(path, "/"), -1)
    kind = F.regexp_extract(name, NAME, 2)
    return paths.where(name.rlike(NAME)).select(F.regexp_extract(name, NAME, 1).alias("base"), F.when(kind == "Red", "red").otherwise("green").alias("channel"), F.col(path).alias("path"))


def one_path(paths: Column) -> Column:
    """The only path; two files for one channel of one base are an error."""
    return F.when(F.size(paths) > 1, F.raise_error(F.concat(F.lit("several files for one channel: "), F.array_join(paths, ", "))).cast("string")).otherwise(F.element_at(paths, 1))


def pair_channels(files: DataFrame) -> DataFrame:
    """(base, green_path, red_path) of bases that have both channels."""
    side = lambda c: F.array_sort(F.collect_set(F.when(F.col("channel") == c, F.col("path"))))
    pairs = files.groupBy("base").agg(side("green").alias("green"), side("red").alias("red")).where("size(green) > 0 and size(red) > 0")
    return pairs.select("base", one_path(F.col("green")).alias("green_path"), one_path(F.col("red")).alias("red_path"))


def find_pairs(spark: SparkSession, root: str, first: int = 0) -> DataFrame:
    """(sample_idx, sample, base, green_path, red_path) below ``root``, in the order of the green paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{idat,idat.gz}").load(root).select("path")
    # One row for each sample, so one task may number them.
    pairs = pair_channels(channel_files(found)).withColumn("sample_idx", (F.row_number().over(Window.orderBy("green_path")) - 1).cast("int"))
    pairs = pairs.select("sample_idx", sample_name(F.col("green_path")).alias("sample"), "base", "green_path", "red_path")
    return pairs.where(F.col("sample_idx") < first) if first else pairs


def stem(name: str) -> str:
    """The sample of a green file's name, as ``sample_name`` gives it."""
    return re.sub(r"\.[^.]*$", "", name).removesuffix("_Grn")


def paired(green: tuple[np.ndarray, np.ndarray], red: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, red, green means) of two decoded channels: they meet by position, as far as the shorter goes; ids are the green file's."""
    n = min(len(green[1]), len(red[1]))
    if not n:
        raise ValueError("empty pair")
    return green[0][:n], red[1][:n], green[1][:n]


def zipped(files: DataFrame) -> DataFrame:
    """(sample_idx, snp_id, red, grn) of files (sample_idx, channel, content); a sample with one channel only is left out.

    The two files of a sample meet, as they are, and are decoded and paired in one task: no decoded value is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, green, red in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, r, g = paired(decode(green), decode(red))
                columns = [np.full(len(ids), sample, np.int32), ids, r.astype(np.int32), g.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sample_idx", "snp_id", "red", "grn"])

    side = lambda c: F.first(F.when(F.col("channel") == c, F.col("content")), ignorenulls=True).alias(c)
    both = files.groupBy("sample_idx").agg(side("green"), side("red")).where("green is not null and red is not null")
    return both.mapInArrow(run, "sample_idx int, snp_id long, red int, grn int")


def read_probes(spark: SparkSession, root: str, first: int = 0, markers: str | None = None) -> DataFrame:
    """(sample_idx, sample, snp_id, red, grn) of the samples below ``root``; only files of these samples are read, once each.

    Stores that Python opens are read by the ``idat`` source, a sample a task, others through Spark's own files.  ``markers`` is the
    path of a Bloom filter (``idat_source.write_bloom``): most cells of other markers are left out where they are decoded.
    """
    from . import idat_source

    if scheme(root) in SCHEMES:
        idat_source.register(spark)
        options = {"first": str(first)} | ({"markers": markers} if markers else {})
        return spark.read.format("idat").options(**options).load(root)
    return through_spark(spark, root, first)


def through_spark(spark: SparkSession, root: str, first: int = 0) -> DataFrame:
    """The rows of ``read_probes`` where only Spark reaches the files."""
    pairs = find_pairs(spark, root, first)
    sides = pairs.select("sample_idx", F.explode(F.create_map(F.lit("green"), "green_path", F.lit("red"), "red_path")).alias("channel", "path"))
    # Two names for each sample: the driver lists as many files anyway.
    paths = [r.path for r in sides.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "sample_idx int, sample string, snp_id long, red int, grn int")
    files = spark.read.format("binaryFile").load(paths).select("path", "content").join(sides, "path")
    return zipped(files).join(pairs.select("sample_idx", "sample"), "sample_idx").select("sample_idx", "sample", "snp_id", "red", "grn")
