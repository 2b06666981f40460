"""Operator 6: token ids in a binary, word-aligned format (Simple-8b).

Each 64-bit word holds a 4-bit selector and up to 60 small ids; the selector says how many and how wide they
are.  Ids of 2**60 and more follow an escape word as they are.  Ids are kept in blocks of whole documents; a
block's row has its offset in the file, so that blocks are decoded by themselves and with array operations.
A file is one range of document ids; Spark's commit protocol makes its writing safe against lost executors,
and the files can lie in any store that Spark writes to.

Defined results: null or empty text is one id (the end id).  Rows with one doc_id follow each other in the
order of a 64-bit hash of their texts; null doc_ids come first.  A long text is encoded in one piece and is in one block,
which then has more ids than others.  An empty table gives no files and an empty result.  Columns other than
doc_id and text are not stored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import body, bounded_batches, chunks, documents, shared_dir, utf8
from .pretoken import BatchEncoder, library_encoder

#: Selector 1, 2, ...: how many ids a word holds and their bits.  Selector 0 is the escape.
LAYOUTS = [(60 // bits, bits) for bits in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)]
BLOCK_IDS = 1 << 16
END_ID = 0
CHUNK_BYTES = 1 << 20
#: Files up to which their offsets are broadcast (16 bytes each); above, they are joined by a shuffle.
BROADCAST_FILES = 100_000


def bit_lengths(values: np.ndarray) -> np.ndarray:
    high = values >> np.uint64(32)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return (np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low) if high.any() else low).astype(np.uint8)


def pack(values: np.ndarray) -> np.ndarray:
    """Values as Simple-8b words: each word takes as many of the next values as fit."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    values = values.astype(np.uint64)
    bits = bit_lengths(values)
    widest = np.zeros(n + 60, np.uint8)
    widest[:n] = bits
    padded, span = widest.copy(), 1
    take, selector = np.ones(n, np.int64), np.full(n, len(LAYOUTS), np.int64)
    for s in range(len(LAYOUTS), 0, -1):
        count, width = LAYOUTS[s - 1]
        while span < count:
            widest[: len(padded) - span] = np.maximum(widest[: len(padded) - span], padded[span:])
            span += 1
        fits = widest[:n] <= width
        if not fits.any():
            break
        take[fits], selector[fits] = count, s
    escaped = bits > 60
    take[escaped], selector[escaped] = 1, 0
    start = _chain(take)
    kind = selector[start]
    size = 1 + (kind == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    wide = np.concatenate([values, np.zeros(60, np.uint64)])
    for s, (count, width) in enumerate(LAYOUTS, 1):
        rows = np.flatnonzero(kind == s)
        if len(rows):
            word = np.full(len(rows), s << 60, np.uint64)
            for k in range(count):
                word |= wide[start[rows] + k] << np.uint64(k * width)
            words[place[rows]] = word
    words[place[kind == 0] + 1] = values[start[kind == 0]]
    return words


def _chain(take: np.ndarray) -> np.ndarray:
    """0, take[0], and so on to the end: each word's first value."""
    n = len(take)
    jump, starts, hops = np.append(np.minimum(np.arange(n) + take, n), n), [0], []
    stride = 1
    while stride < 32:  # five doublings: from every place to 32 words on
        hops.append(jump)
        jump = jump[jump]
        stride *= 2
    far = jump.tolist()
    while (at := far[starts[-1]]) < n:
        starts.append(at)
    found = np.array(starts)
    for hop in reversed(hops):
        found = np.concatenate([found, hop[found]])
    return np.sort(found[found < n])


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of packed words."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(kind == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    many = np.array([1, *(count for count, _ in LAYOUTS), 0])[kind]
    many[raw] = 0
    place = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.uint64)
    for s, (count, width) in enumerate(LAYOUTS, 1):
        rows = np.flatnonzero((kind == s) & ~raw)
        for k in range(count if len(rows) else 0):
            out[place[rows] + k] = (words[rows] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    rows = np.flatnonzero((kind == 0) & ~raw)
    out[place[rows]] = words[rows + 1]
    return out[:n]


def write_token_files(docs: DataFrame, path: str, encoder: Callable[[], BatchEncoder], end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write ``docs`` (doc_id, text) in ascending doc_id order to ``path``, one file for each range of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, block, start = encoder(), TaskContext.get().partitionId(), 0, 0
        names, sizes, ids = pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

        def out(n: int, held: int) -> pa.RecordBatch:
            """The first ``n`` documents, which have ``held`` ids, as one block."""
            ends = pa.array([0, n], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (names.slice(0, n), pa.array(sizes[:n]))]
            head = [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([start]), pa.array([held])]
            return pa.RecordBatch.from_arrays([*head, *lists, pa.array([pack(ids[:held]).tobytes()], pa.binary())], ["file", "block", "start", "n_ids", "doc_ids", "sizes", "words"])

        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                new, at = coder.encode_utf8(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names = pa.concat_arrays([names, batch.column(0).slice(i, j - i)])
                ids, sizes = np.concatenate([ids, np.insert(new, at[1:], end_id)]), np.concatenate([sizes, np.diff(at) + 1])
                while len(ids) >= block_ids:
                    n = int(np.searchsorted(np.cumsum(sizes), block_ids)) + 1
                    held = int(sizes[:n].sum())
                    yield out(n, held)
                    names, sizes, ids, block, start = names.slice(n), sizes[n:], ids[held:], block + 1, start + held
        if len(names):
            yield out(len(names), len(ids))

    bounded_batches(docs.sparkSession)
    # Equal ids are ordered by a hash of their texts, so that ranges can cut through them and no text is a bound.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(body()).alias("mark"))
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    ordered.mapInArrow(run, "file int, block int, start long, n_ids long, doc_ids array<long>, sizes array<long>, words binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it), n_tokens, ids (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], np.uint64), row["n_ids"]).astype("<u4")
                size = np.array(row["sizes"], np.int64)
                at = np.append(0, np.cumsum(size))
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(4 * at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1] + row["start"] + row["before"]), pa.array(size), raw.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    bounded_batches(spark)
    blocks = spark.read.parquet(path)
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    # A row for each file (that is, for each task that wrote), so one task may order them.
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if len(blocks.inputFiles()) <= BROADCAST_FILES:
        files = F.broadcast(files)
    rows = blocks.join(files, "file").select("start", "n_ids", "doc_ids", "sizes", "words", "before")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def checksums(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by its CRC-32."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, vocab = shared_dir(spark, "token_files"), vocabulary_path()
    write_token_files(documents(spark, sf_dir), path, lambda: library_encoder(vocab))
    return checksums(read_token_files(spark, path))
