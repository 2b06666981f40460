"""Operator 7: token counts by a separator scan of flat, unindexed token files.

A flat file is a sequence of fixed-size blocks of little-endian ids in which an end-of-document id closes each
document; nothing says where documents start.  Every block is searched by itself with one array comparison; a
prefix scan over the blocks' summaries (length, last separator) then tells how many ids each block's first
document has in earlier blocks.

Defined results: null or empty text counts 0 ids.  Repeated rows and null doc_ids count row by row.  Ids after
the last separator of a file are a document that is not closed.  A long text goes through as many blocks as it needs.
Columns other than doc_id and text are not stored, so their names can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import bounded_batches, chunks, documents, shared_dir, utf8
from .pretoken import BatchEncoder, library_encoder

BLOCK_IDS = 1 << 16
CHUNK_BYTES = 1 << 20
#: The end-of-document id of the vocabulary.
SEPARATOR = 50256


def write_flat(docs: DataFrame, path: str, encoder: Callable[[], BatchEncoder], separator: int = SEPARATOR, kind: str = "<u2", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, a separator after each, as blocks of ``block_ids`` ids; a task writes a file.

    ``names`` lists the documents that a block closes, in order; the scan does not need it to count.
    The separator's own text is taken as ordinary characters, so ids in a text never look like one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, block = encoder(), TaskContext.get().partitionId(), 0
        rest, ends, names = np.zeros(0, kind), np.zeros(0, np.int64), pa.array([], pa.int64())

        def out(size: int, closed: int) -> pa.RecordBatch:
            """The first ``size`` ids, which close ``closed`` documents, as one block."""
            lists = pa.ListArray.from_arrays(pa.array([0, closed], pa.int32()), names.slice(0, closed))
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([rest[:size].tobytes()], pa.binary()), lists], ["file", "block", "ids", "names"])

        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                ids, at = coder.encode_utf8(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat = np.insert(ids, at[1:], separator).astype(kind)
                ends = np.concatenate([ends, len(rest) + at[1:] + np.arange(len(at) - 1)])
                rest, names = np.concatenate([rest, flat]), pa.concat_arrays([names, batch.column(0).slice(i, j - i)])
                while len(rest) >= block_ids:
                    closed = int(np.searchsorted(ends, block_ids))
                    yield out(block_ids, closed)
                    rest, ends, names, block = rest[block_ids:], ends[closed:] - block_ids, names.slice(closed), block + 1
        if len(rest):
            yield out(len(rest), len(names))

    bounded_batches(docs.sparkSession)
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file int, block int, ids binary, names array<long>")
    flat.write.option("compression", "zstd").parquet(path)


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, kind: str = "<u2") -> DataFrame:
    """(file, ordinal, start, n_tokens, closed, name) of each document in flat blocks (file, block, ids, names)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, kind) for x in batch.column(2).to_pylist()]
            hits = [np.flatnonzero(x == separator) for x in found]
            ends = np.append(0, np.cumsum([len(h) for h in hits])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *hits])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), lists, batch.column(3)], ["file", "block", "n", "hits", "names"])

    bounded_batches(blocks.sparkSession)
    summary = blocks.select("file", "block", "ids", "names").mapInArrow(scan, "file int, block int, n long, hits array<long>, names array<long>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy(F.desc("block"))
    placed = summary.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "closes": F.size("hits"), "last": F.row_number().over(later) == 1})
    placed = placed.withColumns(
        {
            "opened": F.coalesce(F.max(F.when(F.col("closes") > 0, F.col("before") + F.element_at("hits", -1) + 1)).over(earlier), F.lit(0)),
            "done": F.coalesce(F.sum("closes").over(earlier), F.lit(0)),
        }
    )
    ends = F.transform("hits", lambda h: F.col("before") + h)
    starts = F.concat(F.array("opened"), F.transform("hits", lambda h: F.col("before") + h + 1))
    closed = placed.select("file", "done", F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size("hits")).alias("start"), ends.alias("end"), F.col("names").alias("name"))).alias("k", "d"))
    closed = closed.select("file", (F.col("done") + F.col("k")).alias("ordinal"), "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"), "d.name")
    left = F.element_at(starts, -1)
    tail = placed.where(F.col("last") & (left < F.col("before") + F.col("n")))
    tail = tail.select("file", (F.col("done") + F.col("closes")).alias("ordinal"), left.alias("start"), (F.col("before") + F.col("n") - left).alias("n_tokens"), F.lit(False).alias("closed"), F.lit(None).cast("long").alias("name"))
    return closed.union(tail)


@lru_cache(2)
def ordinary(path: str) -> BatchEncoder:
    """The library's encoder without added tokens: their strings in a text are ordinary text."""
    return BatchEncoder(library_encoder(path).encode_words, {})


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: doc_id, file, ordinal, start in the file, n_tokens."""
    path, vocab = shared_dir(spark, "flat_tokens"), vocabulary_path()
    write_flat(documents(spark, sf_dir), path, lambda: ordinary(vocab))
    rows = count_tokens(spark.read.parquet(path))
    return rows.select(F.col("name").alias("doc_id"), "file", "ordinal", "start", "n_tokens")
