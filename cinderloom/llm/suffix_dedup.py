"""Operator 3: removal of repeated byte strings by bucket-pointer refinement.

A text loses every byte that a LENGTH-byte string covers which also starts somewhere else in the corpus.  Sorting
all suffixes would move every byte many times, so the refinement works on anchors: among the q-grams of
each string the one with the least hash (the leftmost, if several) is its anchor, and equal strings have
equal anchors at equal offsets.

* Initial buckets: anchors by q-gram.  A string whose anchor is alone in its bucket occurs once.
* An anchor's context is the stretch of all strings that it stands for.  Anchors of a bucket with one context have
  the same strings: all of them repeat.
* The contexts of another bucket are refined together.  All their places go to buckets by q-gram; each round sorts them
  by the identifier of their own bucket and the identifier of the bucket at a later offset, which the round before has
  refined, and so doubles the bytes that a bucket stands for (q, 2q, 4q = LENGTH).  Places that are alone drop out.
* A bucket with too many contexts for one task is split by Spark first, by the same rule: its strings are halved by
  their anchor's offset, and each half is dealt to new buckets, whose identifiers are made of the old one and of the
  bytes at the farther offset that all strings of the half have.  New buckets are treated the same way again.

Defined results: null text counts as empty.  Matches don't cross documents.  Copies of a document repeat each other, so they
lose all their bytes if they have LENGTH or more.  Shorter texts lose nothing.  Repeated rows and null doc_ids
are rows like others.  Rows are told apart by a 64-bit hash of their text, buckets and contexts by 64 bits each.
A long text is searched in pieces, and cut as a whole.  Columns other than those asked for are left out; those asked for
may have any name that the result has not.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHARS, body, bounded_batches, chunks, documents, frequent, mix, prefix, ranges, spread_join, stage, stretch, unused, utf8

LENGTH, GRAM = 200, 50
#: Offsets that a string's anchor can have in it: 0 .. REACH - 1.
REACH = LENGTH - GRAM + 1
#: Contexts of a bucket that are refined in one task (350 bytes each at most); larger buckets are split by Spark.
SMALL = 512
CHUNK_BYTES, PIECE_BYTES, CUTS = 1 << 20, 1 << 22, 1 << 14
_PLACE_BITS = np.uint64(24)
_SEED = np.uint64(0xC2B2AE3D27D4EB4F)


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, base): some whole texts, or a piece of a very long one with the strings that start in it."""
    for i, j in chunks(offsets, CHUNK_BYTES):
        if offsets[j] - offsets[i] <= PIECE_BYTES:
            yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0
        else:  # one text
            text = raw[offsets[i] : offsets[j]]
            for base in range(0, len(text), PIECE_BYTES):
                part = text[base : base + PIECE_BYTES + LENGTH - 1]
                yield i, part, np.array([0, len(part)], np.int64), base


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, bucket, context hash, anchor, least and largest offset of each anchor of the texts."""
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 6
    sums = prefix(raw, CHARS)
    _, down = CHARS.upto(n + 1)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1] + _SEED)
    best = (gram >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while 2 * span <= REACH:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    best = np.minimum(best[: n - LENGTH + 1], best[REACH - span :][: n - LENGTH + 1])
    anchor = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), offsets[1:] - offsets[:-1])
    start = np.flatnonzero(row[: n - LENGTH + 1] == row[LENGTH - 1 :])
    if not len(start):
        return (np.zeros(0, np.int64),) * 6
    anchor = anchor[start]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[start[1:]] != row[start[:-1]])))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    at = anchor[new]
    context = mix(stretch(sums, first, last + LENGTH, CHARS) ^ mix((at - first).astype(np.uint64)))
    return row[first], gram[at], context, at - offsets[row[first]], at - last, at - first


def _table(names: list[str], *columns) -> pa.RecordBatch:
    out = []
    for c in columns:
        c = c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c
        out.append(c if isinstance(c, pa.Array) else pa.array(c))
    return pa.RecordBatch.from_arrays(out, names)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches, regrouped so that rows with one value in the first column stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]) if held or cut else batch
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _spread(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, least and largest offset from a packed place."""
    return place >> 16, (place >> 8) & 255, place & 255


def _joined(column) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size


def _slices(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The bytes of each stretch as a binary column."""
    at = np.append(0, np.cumsum(stop - start)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw[ranges(start, stop - start)])])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each item of a list column, and the items."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), pc.list_flatten(lists)


_CONTEXT = "node long, key long, place long, n long, low int, high int, bytes binary"
_SPANS = "key long, start long, end long"


def _numbered(key: np.ndarray) -> np.ndarray:
    """Sorts the keys and numbers their buckets from 1; 0 for keys that are alone."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), np.int64)
    if len(key):
        out[order] = np.append(1, np.cumsum(~same) + 1) * (np.append(False, same) | np.append(same, False))
    return out


def refined(raw: np.ndarray, left: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which places begin a LENGTH-byte string that begins at another place of its node too.

    ``left`` counts the bytes from each place to the end of its context, and ``node`` names the context's bucket.
    """
    bucket, sums = np.zeros(len(raw), np.int64), prefix(raw, CHARS)
    place = np.flatnonzero(left >= GRAM)
    bucket[place] = _numbered(mix(stretch(sums, place, place + GRAM, CHARS) ^ mix(node[place])))
    depth = GRAM
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        place = place[left[place] >= depth + step]
        place = place[(bucket[place] > 0) & (bucket[place + step] > 0)]
        number = _numbered(bucket[place] << 32 | bucket[place + step])
        bucket = np.zeros(len(raw), np.int64)
        bucket[place] = number
        depth += step
    return bucket > 0


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of repeated strings in buckets that fit a task, for contexts that occur once."""
    for whole in _whole_groups(batches):
        names = whole["node"].to_numpy()
        ends = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
        _, least, most = _spread(whole["place"].to_numpy())
        held = np.append(0, np.cumsum(most - least + LENGTH))[ends]
        for i, j in chunks(held, CHUNK_BYTES):  # whole nodes
            yield _refine_nodes(whole.slice(ends[i], ends[j] - ends[i]))


def _refine_nodes(group: pa.Table) -> pa.RecordBatch:
    node, place, n = (group[c].to_numpy() for c in ("node", "place", "n"))
    at, least, most = _spread(place)
    raw, begin = _joined(group["bytes"])
    size = most - least + LENGTH
    row = np.repeat(np.arange(len(node)), size)
    hit = refined(raw, (begin + size)[row] - np.arange(len(raw)), node.view(np.uint64)[row])
    hit &= n[row] == 1
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    r = row[first]  # a run lies in one context: a context's last bytes begin no string
    return _table(["key", "start", "end"], group["key"].to_numpy()[r], at[r] - most[r] + first - begin[r], at[r] - most[r] + last - begin[r] + LENGTH)


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context once for each half of its bucket's offsets, cut to the strings of that half, in its new bucket."""
    for batch in batches:
        node, place = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
        low, high = batch.column(4).to_numpy().astype(np.int64), batch.column(5).to_numpy().astype(np.int64)
        at, least, most = _spread(place)
        raw, begin = _joined(batch.column(6))
        sums, middle, anchor = prefix(raw, CHARS), (low + high) // 2, begin + most
        for a, b, new, end in ((low, middle, LENGTH - high, LENGTH - middle), (middle + 1, high, -middle - 1, -low)):
            r = np.flatnonzero((a <= b) & (a <= most) & (b >= least))
            if not len(r):
                continue
            inner, outer = np.maximum(a[r], least[r]), np.minimum(b[r], most[r])
            start, stop = anchor[r] - outer, anchor[r] - inner + LENGTH
            farther = stretch(sums, anchor[r] + new[r], anchor[r] + end[r], CHARS)
            child = mix(mix(node[r] ^ mix(a[r].astype(np.uint64) + _SEED)) ^ farther)
            content = mix(stretch(sums, start, stop, CHARS) ^ mix((inner << 8 | outer).astype(np.uint64)))
            part = batch.take(pa.array(r))
            yield _table(
                ["node", "key", "place", "n", "low", "high", "bytes", "content"],
                child, part.column(1), at[r] << 16 | inner << 8 | outer, part.column(3), a[r].astype(np.int32), b[r].astype(np.int32), _slices(raw, start, stop), content,
            )


def copies(docs: DataFrame) -> DataFrame:
    """(key, parts) of texts that hold many rows; see ``spread_join``."""
    counts = docs.groupBy(text_key().alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return frequent(stage(docs.sparkSession, counts, "repeats_copies"), "key", "n", docs.count())


def repeated_spans(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """(key, start, end) of repeated strings, joined where an anchor's overlap; key is ``text_key`` of the text."""
    spark = docs.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for i, raw, offsets, base in _pieces(*utf8(batch.column(1))):
                row, bucket, context, at, low, high = anchors(raw, offsets)
                yield _table(["bucket", "context", "key", "place"], bucket.view(np.int64), context.view(np.int64), key[i + row], (at + base) << 16 | low << 8 | high)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            fresh = np.append(key[:1] != last, key[1:] != key[:-1])  # copies of a text stand together and are cut once
            batch, last = batch.filter(pa.array(fresh)), key[-1]
            raw, offsets = utf8(batch.column(1))
            of, found = _flat(batch.column(2))
            key = key[fresh][of]
            node, place, n = (pc.struct_field(found, c).to_numpy() for c in ("bucket", "place", "n"))
            at, low, high = _spread(place)
            start, stop = offsets[of] + at - high, offsets[of] + at - low + LENGTH
            for i in range(0, len(of), CUTS):
                w = slice(i, i + CUTS)
                whole = [np.full(len(of[w]), x, np.int32) for x in (0, REACH - 1)]
                yield _table(["node", "key", "place", "n", "low", "high", "bytes"], node[w], key[w], place[w], n[w], *whole, _slices(raw, start[w], stop[w]))

    bounded_batches(spark)
    texts = docs.select(text_key().alias("key"), body().alias("text"))
    found = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(find, "bucket long, context long, key long, place long")
    often = found.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    # Sums are written before they are joined: then both sides of the join are shuffles, and Spark can split a large bucket.
    met = stage(spark, found.join(stage(spark, often, "repeats_often"), "bucket"), "repeats_met")
    contexts = stage(spark, met.groupBy("bucket", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")), "repeats_contexts")
    kinds = stage(spark, contexts.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "repeats_kinds")
    whole = met.join(contexts.where("n > 1").select("bucket", "context"), ["bucket", "context"]).select("key", "place").distinct()
    low, high = F.expr("(place >> 8) & 255"), F.expr("place & 255")
    whole = whole.select("key", (F.expr("place >> 16") - high).alias("start"), (F.expr("place >> 16") - low + LENGTH).alias("end"))
    mixed = contexts.join(kinds, "bucket").select(F.col("one.key").alias("key"), F.struct("bucket", F.col("one.place").alias("place"), "n", "k").alias("x"))
    mixed = mixed.groupBy("key").agg(F.collect_list("x").alias("found"))  # a text's own anchors
    mixed = stage(spark, mixed, "repeats_mixed")
    cuts = spread_join(texts, mixed, "key", copied, []).select("key", "text", "found").mapInArrow(cut, _CONTEXT).dropDuplicates(["node", "place", "key"])
    cuts = stage(spark, cuts.join(kinds.withColumnRenamed("bucket", "node"), "node"), "repeats_cuts")
    names = [c for c in cuts.columns if c != "k"]
    small, spans = [cuts.where(F.col("k") <= SMALL).select(*names)], [whole]
    large = cuts.where(F.col("k") > SMALL).select(*names)
    while not large.isEmpty():
        halves = stage(spark, large.mapInArrow(_halve, f"{_CONTEXT}, content long"), "repeats_halves")
        sizes = halves.groupBy("node").agg(F.count("*").alias("k"), F.sum("n").alias("all"), (F.min("content") == F.max("content")).alias("even"))
        halves = stage(spark, halves.join(stage(spark, sizes.where(F.col("all") > 1), "repeats_sizes"), "node"), "repeats_nodes")
        even = halves.where("even and n = 1")
        spans.append(even.select("key", (F.expr("place >> 16") - high).alias("start"), (F.expr("place >> 16") - low + LENGTH).alias("end")))
        small.append(halves.where(~F.col("even") & (F.col("k") <= SMALL)).select(*names))
        large = halves.where(~F.col("even") & (F.col("k") > SMALL)).select(*names)
    rows = small[0]
    for s in small[1:]:
        rows = rows.union(s)
    out = rows.repartition("node").sortWithinPartitions("node").mapInArrow(_refine, _SPANS)
    for s in spans:
        out = out.union(s.select("key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    return out


def text_key():
    return F.xxhash64(body())


def without_repeats(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, n_bytes, n_removed, n_spans, spans (array of start, end) and kept (bytes left) of each document."""
    spark = docs.sparkSession
    often = copies(docs)
    spans = stage(spark, repeated_spans(docs, often).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeats_spans")
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")])
    names, own = [f.name for f in schema], unused([*keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(len(keep)))
            for i, j in chunks(offsets, CHUNK_BYTES):
                text, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, found = _flat(batch.column(len(keep) + 1).slice(i, j - i))
                start, end = (at[row] + pc.struct_field(found, c).to_numpy() for c in ("start", "end"))
                order = np.lexsort((start, row))
                row, start, end = row[order], start[order], np.maximum.accumulate(end[order])
                new = np.append(True, (start[1:] > end[:-1]) | (row[1:] != row[:-1]))[: len(row)]
                first = np.flatnonzero(new)
                row, start, end = row[first], start[first], end[np.append(first[1:], len(end))[: len(first)] - 1]
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                keeps = np.cumsum(edge[:-1]) == 0
                left = np.append(0, np.cumsum(keeps))[at]
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(start - at[row]), pa.array(end - at[row])], ["start", "end"])
                kept = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(text[keeps])])
                sizes = map(pa.array, (np.diff(at), np.diff(at) - np.diff(left), np.diff(ends).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[: len(keep)], *sizes, pa.ListArray.from_arrays(pa.array(ends), runs), kept], names)

    bounded_batches(spark)
    key, text = own + "key", own + "text"
    rows = docs.select(*keep, text_key().alias(key), body().alias(text))
    spans, often = spans.withColumnRenamed("key", key).withColumnRenamed("spans", own + "spans"), often.withColumnRenamed("key", key)
    joined = spread_join(rows, spans, key, often, [*keep], "left")  # many copies of one text are dealt over many tasks
    return joined.select(*keep, text, own + "spans").mapInArrow(run, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(documents(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
