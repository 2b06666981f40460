"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; where that is unset, a local session gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder for intermediate tables")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/cinderloom/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, mb: int = 16) -> None:
    """Batches that go to Python are cut by bytes too, so that long texts don't make huge ones.

    The setting is read when a query runs, so it stays in the session; a smaller one of the user's is kept.
    """
    name, bound = "spark.sql.execution.arrow.maxBytesPerBatch", mb << 20
    now = spark.conf.get(name, None)
    if not (now and now.isdigit() and 0 < int(now) <= bound):
        spark.conf.set(name, str(bound))


def give_back() -> None:
    """Return this process's free memory to the system: Arrow's pool, and the C library's heap (where it is glibc)."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker gives free memory back when a task ends: workers stay, for tasks of other operators."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them has been written."""
    for df in frames:
        place = None
        for file in df.inputFiles()[:1]:
            place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if place is not None:
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: A key with more than this part of all rows is frequent; so no more keys than this can be.
SHARES = 1000


def frequent(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """(key, parts) of frequent keys, ``SHARES`` rows at most; ``counts`` has one row for each key."""
    return counts.where(F.col(n) * SHARES > total).select(key, F.ceil(F.col(n) * SHARES / F.lit(max(total, 1))).cast("int").alias("parts"))


def spread_join(left: DataFrame, right: DataFrame, key: str, often: DataFrame, by: list[str], how: str = "inner", merge: bool = False) -> DataFrame:
    """``left.join(right, key, how)``, where rows of ``left`` with a frequent key are dealt over many tasks.

    Each row gets a part by its columns ``by`` and its partition; ``right`` is copied to all parts of its key.
    ``merge``: never broadcast ``right``.  A broadcast table of two keys takes a page of each executor's heap, however small
    it is (by Spark's formula 16 MB of 1.8 GB), until the driver happens to collect it; that adds up where many such joins follow each other.
    """
    own = unused([*left.columns, *right.columns])
    parts, part = own + "parts", own + "part"
    often = F.broadcast(often.withColumnRenamed("parts", parts))  # at most SHARES rows
    which = F.coalesce(F.pmod(F.xxhash64(F.spark_partition_id(), *by), F.col(parts)), F.lit(0)).cast("int")
    dealt = left.join(often, key, "left").withColumn(part, which).drop(parts)
    copied = right.join(often, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    copied = copied.hint("merge") if merge else copied
    return dealt.join(copied, [key, part], how).drop(part)


def unused(columns: list[str]) -> str:
    """A prefix that none of ``columns`` begins with, for columns of an operator's own (names are compared without case)."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def body(col: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row at least): bounds memory for any batch."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = self._grow(1 << 12)

    def _grow(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for b in (self.base, self.inverse):
            x = np.full(n, b, np.uint64)
            x[:1] = 1
            out.append(np.multiply.accumulate(x))
        return out[0], out[1]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = self._grow(1 << max(12, int(n).bit_length()))
        return self.up, self.down


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


CHARS = Powers(0x9E3779B97F4A7C15)
ITEMS = Powers(0xD1342543DE82EF95)


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of value * base**position; any stretch's hash then costs two lookups."""
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the stretches [start, end), independent of where they stand."""
    _, down = powers.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs without white space) of each row: start, end, row, and the non-space mask."""
    ink = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] |= ink[inner]
    last[inner - 1] |= ink[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1, ink


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each of many ranges, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
