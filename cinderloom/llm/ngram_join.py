"""Operator 2: Jaccard join on word 5-grams by chosen paths.

Documents with equal 5-gram sets are one class first.  A class is a set, and a run of the join splits the
sets recursively: at each tree node one or two positions of a MinHash signature are chosen by the node's own
hash, and the sets that share the token sampled there go to one child.  Small nodes are compared by brute force
on the signatures.  In a large node every set is compared with one pivot, sets that nearly equal the pivot go no
further, and the others are split again; what is still large after the last level is passed on as a
whole.  Runs are repeated until a pair at the threshold is met with probability ``RECALL``.

That gives groups of candidates.  Within a group links are exact, on whole 5-gram sets.  A small group is compared in one
task.  In a large one every set becomes its difference from a centre, and its distance from there decides most pairs
(Jaccard distance is a metric): bins of sets that surely link are only counted, bins that surely don't are left alone,
and blocks of sets are compared for the rest, so that no task holds a large group and no pairs are written.  Each set gets
its exact number of links, and the links' components are the near-duplicate classes.

Defined results: a text of 1 to 4 words is one n-gram; a null text, as one without words, links to nothing and is a class by
itself.  Links of exactly the threshold count.  A long text is compared whole.  Repeated rows are copies.  Null doc_ids are rows like others, and a class's id is the smallest doc_id that is not
null in it.  Columns other than those asked for are left out, and so
are kept ones with the result's own names.  Rows that share a doc_id cost no more than rows with their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHARS, ITEMS, body, bounded_batches, chunks, discard, documents, lean, mix, prefix, ranges, shared_dir, stage, stretch, unused, utf8, words_of
from .components import components, labels

WORDS, THRESHOLD = 5, 0.8
#: Positions of a signature; levels of the recursion; sets that a node compares by brute force at most.
WIDTH, LEVELS, SMALL = 64, 3, 64
RECALL = 0.9995
#: Agreement of signatures (true similarity 0.8: 0.8 +- 0.05) from which two sets are candidates, from which sets in
#: a large node are candidates with its pivot, and from which a set counts as nearly equal to the pivot.  Sets
#: within 0.13 of the pivot go no further; whatever links to them is within 0.33 of it, so it is a candidate too.
NEAR, REACH, SAME = 0.6, 0.5, 0.95
#: Sets of a group that are compared in one task; larger groups are cut into blocks of about this many.
GROUP, BLOCK, STRIDE = 256, 192, 64
#: Two sets whose distances from a centre, in hundredths rounded down, add up to less than this are within 0.2 of each other.
CLOSE = 19
CHUNK_BYTES = 1 << 20
COLUMNS = 1 << 14
#: 64-bit words of the filter by which texts are left out before they are shuffled: 4 MB at most, whatever the input is.
MASKS = 1 << 18
#: Where a row of a file stands.
PLACE = "struct(_metadata.file_path as file, _metadata.row_index as row)"
LABEL = "__label"


def runs(threshold: float = THRESHOLD, levels: int = LEVELS, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met in the last level with probability ``recall``."""
    meet = 1.0
    for _ in range(levels):  # one position, and in a quarter of the nodes a second one
        meet = 0.75 * threshold * meet + 0.25 * (1 - (1 - threshold * meet) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word n-gram hashes of each text, ascending, and their offsets."""
    n = len(offsets) - 1
    start, end, row, _ = words_of(raw, offsets)
    grams = prefix(stretch(prefix(raw, CHARS), start, end, CHARS), ITEMS)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    many = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(np.int64))
    at, size = ranges(first, many), np.repeat(np.minimum(count, WORDS), many)
    hashes, of = stretch(grams, at, at + size, ITEMS), np.repeat(np.arange(n), many)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(n + 1))


_FACTORS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash signature (WIDTH 32-bit values) of each set; an empty set has zeros."""
    out = np.zeros((len(at) - 1, WIDTH), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        for i, factor in enumerate(_FACTORS):
            out[full, i] = np.minimum.reduceat(((hashes * factor) >> np.uint64(32)).astype(np.uint32), at[:-1][full])
    return out


def _child(path: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(path + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + value.astype(np.uint64))


def children(path: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The child nodes of each set at its node ``path``: (index of the set, child)."""
    u = mix(path ^ np.uint64(0x5851F42D4C957F2D))
    one = (u >> np.uint64(8)).astype(np.int64) % WIDTH
    two = (one + 1 + (u >> np.uint64(24)).astype(np.int64) % (WIDTH - 1)) % WIDTH
    line = np.arange(len(path))
    more = np.flatnonzero(u & np.uint64(3) == 0)
    nodes = [_child(path, one, vectors[line, one]), _child(path[more], two[more], vectors[more, two[more]])]
    return np.concatenate([line, more]), np.concatenate(nodes)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WIDTH)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _name() -> Column:
    """What a row's text is found by again: its doc_id (or none) and a hash of the text, so rows that share an id stay apart."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("mark"))


def sketched(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, name (of the row's text), set (hash of the 5-gram set; null without words) and vector (signature) of each document."""
    kept = list(dict.fromkeys(keep))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("name", T.StructType([T.StructField("id", T.LongType()), T.StructField("mark", T.LongType())])), T.StructField("set", T.LongType()), T.StructField("vector", T.BinaryType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(len(kept) + 1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                hashes, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                vectors, whole = signatures(hashes, at), prefix(hashes, ITEMS)
                key = stretch(whole, at[:-1], at[1:], ITEMS).view(np.int64)
                part = batch.slice(i, j - i).columns[: len(kept) + 1]
                yield pa.RecordBatch.from_arrays([*part, pa.array(key, mask=at[1:] == at[:-1]), pa.array([v.tobytes() for v in vectors], pa.binary())], names)

    bounded_batches(docs.sparkSession)
    return docs.select(*kept, _name().alias("name"), body().alias("__text")).mapInArrow(lean(run), schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Runs of equal values in the first ``keys`` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        step = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        at = [0, *(np.flatnonzero(step) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _once(group: pa.Table, *by: str) -> pa.Table:
    """A sorted group without rows that equal the one before in the columns ``by``: repeated rows of a text."""
    new = np.ones(group.num_rows, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in (group[b].to_numpy() for b in by)], axis=0)
    return group if new.all() else group.filter(pa.array(new))


def maybe_wanted(rows: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """``rows`` without most of those whose columns ``by`` are in no row of ``wanted``; none that is there is lost.

    A bit is set for each of ``wanted``, in ``MASKS`` words that are broadcast.  The more bits are set, the more other rows
    stay: an exact join has to follow.
    """
    own = unused([*rows.columns, *wanted.columns])
    word, bit, bits = own + "word", own + "bit", own + "bits"
    key = F.xxhash64(*by)
    placed = [key.bitwiseAND(F.lit(MASKS - 1)).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 58).cast("int")).alias(bit)]
    masks = wanted.select(*placed).groupBy(word).agg(F.bit_or(bit).alias(bits))
    met = rows.select("*", *placed).join(F.broadcast(masks), word)  # MASKS rows at most
    return met.where(F.col(bits).bitwiseAND(F.col(bit)) != 0).select(*rows.columns)


def candidates(spark: SparkSession, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) whose components hold all pairs at the threshold, met in ``runs()`` runs; sets: (set, vector).

    Also the staged tables that the edges are read from.
    """
    roots = mix(np.arange(1, runs() + 1, dtype=np.uint64))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, name = _vectors(batch.column(1)), batch.column(0).to_numpy()
            for r in roots:
                i, node = children(np.full(len(name), r), vectors)
                yield pa.RecordBatch.from_arrays([_longs(node), _longs(name[i])], ["node", "set"])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            name, v = group["set"].to_numpy(), _vectors(group["vector"])
            same = sum((v[:, None, k] == v[None, :, k]).astype(np.int16) for k in range(WIDTH))
            label = labels(len(name), np.argwhere(np.triu(same >= NEAR * WIDTH, 1)))
            if len(far := np.flatnonzero(label != np.arange(len(name)))):
                yield pa.RecordBatch.from_arrays([pa.array(name[far]), pa.array(name[label[far]])], ["a", "b"])

    def pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, name, top = (batch.column(k).to_numpy() for k in (0, 1, 2))
            v = _vectors(batch.column(3))
            same = (v == _vectors(batch.column(4))).sum(1)
            i, child = children(node.view(np.uint64), v)
            on = (same < SAME * WIDTH)[i]
            order = np.argsort(i[on], kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(i[on][order], np.arange(len(name) + 1)).astype(np.int32)), _longs(child[on][order]))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(top), pa.array(same >= REACH * WIDTH), lists], ["set", "top", "near", "next"])

    bounded_batches(spark)
    edges, smalls, staged = [], [], []
    rows = sets.mapInArrow(lean(begin), "node long, set long")
    for level in range(1, LEVELS + 1):
        rows = stage(spark, rows, "join_rows")
        # Sums are written before they are joined: then both sides of the join are shuffles, and Spark can split a large node.
        sizes = stage(spark, rows.groupBy("node").agg(F.count("*").alias("n"), F.min("set").alias("top")).where("n > 1"), "join_sizes")
        met = stage(spark, rows.join(sizes, "node"), "join_nodes")
        discard(rows, sizes)
        staged.append(met)
        if level == 1:  # Only sets that met another one are looked up later, with their vectors.  The same plan at every size.
            sets = stage(spark, sets.join(met.select("set").distinct().hint("merge"), "set", "left_semi"), "join_vectors")
            staged.append(sets)
        few, many = met.where(F.col("n") <= SMALL), met.where(F.col("n") > SMALL)
        smalls.append(few.select("node", "set", "n"))
        if level == LEVELS:
            edges.append(many.where("set != top").select(F.col("set").alias("a"), F.col("top").alias("b")))
            break
        if many.isEmpty():
            break
        tops = many.select("top").distinct().join(sets, F.col("top") == F.col("set")).select("top", F.col("vector").alias("top_vector"))
        tops = stage(spark, tops, "join_tops")
        judged = many.select("node", "set", "top").join(sets, "set").join(tops, "top").select("node", "set", "top", "vector", "top_vector")
        staged += [tops, judged := stage(spark, judged.mapInArrow(lean(pivot), "set long, top long, near boolean, next array<long>"), "join_pivots")]
        edges.append(judged.where("near and set != top").select(F.col("set").alias("a"), F.col("top").alias("b")))
        rows = judged.where("set != top").select(F.explode("next").alias("node"), "set")
    # Small nodes of all levels together.  Nodes with the same sets are compared once.
    few = reduce(DataFrame.union, smalls)
    once = few.groupBy("node", "n").agg(F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("all"), F.min("set").alias("low")).groupBy("all", "n", "low").agg(F.min("node").alias("node"))
    few = few.join(once.select("node"), "node", "left_semi").join(sets, "set").select("node", "set", "vector")
    met = few.repartition("node").sortWithinPartitions("node", "set").mapInArrow(lean(brute), "a long, b long")
    return reduce(DataFrame.union, edges, met), staged


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of 0/1 matrices, some columns at a time."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    shared = np.intersect1d(flat[0], flat[1])
    place = [np.searchsorted(shared, f) for f in flat]
    hit = [shared[np.minimum(p, len(shared) - 1)] == f if len(shared) else np.zeros(len(f), bool) for p, f in zip(place, flat, strict=True)]
    out = np.zeros((len(a), len(b)), np.int64)
    sides = [(p[h], r[h]) for p, r, h in zip(place, row, hit, strict=True)]
    sides = [(p[o], r[o]) for p, r in sides for o in [np.argsort(p, kind="stable")]]
    for low in range(0, len(shared), COLUMNS):
        mats = []
        for (p, r), n in zip(sides, (len(a), len(b)), strict=True):
            i, j = np.searchsorted(p, [low, low + COLUMNS])
            mat = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            mat[r[i:j], p[i:j] - low] = 1
            mats.append(mat)
        out += (mats[0] @ mats[1].T).astype(np.int64)
    return out


def _linked(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which pairs reach the threshold: common / (size + size - common) >= 4/5."""
    size = [np.array([len(s) for s in x], np.int64) for x in (a, b)]
    return 9 * _common(a, b) >= 4 * (size[0][:, None] + size[1][None, :])


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _owner_type(n: int) -> np.dtype:
    """The smallest unsigned type that numbers ``n`` sets: blocks are cut by hash, so their size has no fixed bound."""
    return np.min_scalar_type(max(n - 1, 0))


def exact_links(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, label, n_links) of the sets in ``wanted`` (set, name, root): links within each root's group, and their components.

    The result is staged; what it was made of is deleted.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows mostly come to one task
        for batch in batches:
            raw, offsets = utf8(batch.column(3))
            for i, j in chunks(offsets, CHUNK_BYTES):
                hashes, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key = stretch(prefix(hashes, ITEMS), at[:-1], at[1:], ITEMS).view(np.int64)
                part = batch.slice(i, j - i)
                right = []
                for k in np.flatnonzero((key == part.column(0).to_numpy()) & (at[1:] > at[:-1])).tolist():
                    if (name := int(key[k])) not in seen:
                        seen.add(name)
                        right.append(k)
                grams = pa.array([hashes[at[k] : at[k + 1]].tobytes() for k in right], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(right, pa.int64())) for c in (0, 1, 2)), grams], ["set", "root", "part", "grams"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            group = _once(group, "set")
            name, sets = group["set"].to_numpy(), _unpacked(group["grams"])
            link = _linked(sets, sets)
            np.fill_diagonal(link, False)
            label = labels(len(name), np.argwhere(np.triu(link)))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(name[label]), pa.array(link.sum(1))], ["set", "label", "n_links"])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set of a part as its difference from the group's centre, which comes first."""
        for group in _groups(batches, 2):
            group = _once(group, "turn", "set")
            name, (centre, *sets) = group["set"].to_numpy()[1:], _unpacked(group["grams"])
            size = np.array([len(x) for x in sets], np.int64)
            diff = [np.setxor1d(centre, x, assume_unique=True) for x in sets]
            apart = np.array([len(x) for x in diff], np.int64)
            gone = (apart + len(centre) - size) // 2
            whole = size + gone  # of the set and the centre
            columns = [pa.array([group["root"][0].as_py()] * len(sets)), pa.array(name), pa.array(size), pa.array(gone), pa.array(np.full(len(sets), len(centre))), pa.array(100 * apart // whole), pa.array([x.tobytes() for x in diff], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["root", "set", "size", "gone", "centre", "bin", "diff"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            name, size, gone = (group[c].to_numpy() for c in ("set", "size", "gone"))
            sets = _unpacked(group["diff"])
            every, place = np.unique(np.concatenate(sets), return_inverse=True)
            order = np.lexsort((np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place))  # column by column: packs well
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order].astype(_owner_type(len(sets)))
            head = np.array([len(name), len(every), len(owner), group["centre"][0].as_py()], np.int64)
            raw = b"".join(x.tobytes() for x in (head, name, size, gone, every, np.bincount(place, minlength=len(every)).astype(np.int64), owner))
            yield pa.RecordBatch.from_arrays([pa.array([group[c][0].as_py()], pa.int64()) for c in ("root", "block")] + [pa.array([zlib.compress(raw, 1)], pa.binary())], ["root", "block", "sets"])

    def opened(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        raw = zlib.decompress(raw)
        n, m, k, centre = np.frombuffer(raw, np.int64, 4).tolist()
        name, size, gone = np.frombuffer(raw, np.int64, 3 * n, 32).reshape(3, n)
        every, count = np.frombuffer(raw, np.uint64, m, 32 + 24 * n), np.frombuffer(raw, np.int64, m, 32 + 24 * n + 8 * m)
        owner = np.frombuffer(raw, _owner_type(n), k, 32 + 24 * n + 16 * m)
        flat = np.repeat(every, count)
        order = np.argsort(owner, kind="stable")
        return centre, name, size, gone, np.split(flat[order], np.cumsum(np.bincount(owner, minlength=n))[:-1])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block against others: the links of its sets, and which labels they connect (a set near the centre has its label)."""
        for group in _groups(batches, 3):
            root, block, joins = group["root"][0].as_py(), group["mine"][0].as_py(), []
            for batch in group.to_batches():
                for other, raw in zip(batch["other"].to_pylist(), batch["sets"].to_pylist(), strict=True):
                    if other < 0:  # the block itself comes first
                        centre, name, size, gone, diff = opened(raw)
                        total = np.zeros(len(name), np.int64)
                        continue
                    _, names, sizes, lost, diffs = opened(raw)
                    # What two sets have in common: the centre's grams that neither lacks, and those that both have beside it.
                    common = centre - gone[:, None] - lost[None, :] + _common(diff, diffs)
                    link = 9 * common >= 4 * (size[:, None] + sizes[None, :])
                    if other == block:
                        np.fill_diagonal(link, False)
                    total += link.sum(1)
                    close = [b >> 32 < CLOSE for b in (block, other)]
                    if not all(close):
                        i, j = np.nonzero(link)
                        ends = [np.full(len(x), root) if near else x for x, near in zip((name[i], names[j]), close, strict=True)]
                        joins.append(np.unique(np.stack(ends, 1), axis=0))
            edge = np.concatenate(joins) if joins else np.zeros((0, 2), np.int64)
            node, place = np.unique(edge, return_inverse=True)
            label = labels(len(node), place.reshape(-1, 2))
            far = label != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.nulls(len(name), pa.int64()), pa.array(total)], ["set", "label", "n_links"])
            yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]]), pa.nulls(int(far.sum()), pa.int64())], ["set", "label", "n_links"])

    bounded_batches(spark)
    sizes = wanted.groupBy("root").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / BLOCK)
    part = F.when(F.col("n") > GROUP, F.pmod(F.xxhash64("set"), parts)).otherwise(-1).cast("int")
    placed = stage(spark, wanted.join(sizes, "root").select("set", "name.id", "name.mark", "root", part.alias("part")), "join_groups")
    text = docs.select(_name().alias("name"), body().alias("text")).select("name.id", "name.mark", "text")
    text = maybe_wanted(text, placed, "id", "mark")
    # The same plan at every size: no broadcast where the groups happen to be few.
    sets = text.join(placed.hint("merge"), ["id", "mark"]).select("set", "root", "part", "text").mapInArrow(lean(sets_of), "set long, root long, part int, grams binary")
    staged = [placed, sets := stage(spark, sets, "join_sets")]  # a repeated row's set may stand here more than once
    result = "set long, label long, n_links long"
    few = sets.where("part < 0").select("root", "set", "grams").repartition("root").sortWithinPartitions("root", "set").mapInArrow(lean(whole), result)
    if placed.where("part >= 0").isEmpty():
        out = stage(spark, few, "join_result")
        discard(*staged)
        return out
    many = sets.where("part >= 0").select("root", "part", "set", "grams", F.lit(1).alias("turn"))
    parts = placed.where("part >= 0").select("root", "part").distinct()
    centres = many.where("set = root").select("root", "set", "grams").join(parts, "root").select("root", "part", "set", "grams", F.lit(0).alias("turn"))
    turns = centres.union(many.select(*centres.columns)).repartition("root", "part").sortWithinPartitions("root", "part", "turn", "set")
    diffs = stage(spark, turns.mapInArrow(lean(centred), "root long, set long, size long, gone long, centre long, bin long, diff binary"), "join_diffs")
    # Distances by a hundredth of 1.  As Jaccard distance is a metric, two sets link for sure if their distances from the
    # centre add up to 0.2 at most, and don't if they differ by more: only blocks of other pairs of bins are compared.
    bins = stage(spark, diffs.groupBy("root", "bin").agg(F.count("*").alias("n")), "join_bins")
    mine, other = bins.select("root", F.col("bin").alias("a"), F.col("n").alias("n_a")), bins.select("root", F.col("bin").alias("b"), F.col("n").alias("n_b"))
    pairs = mine.join(other, "root")  # of at most 101 bins
    sure = pairs.where(F.col("a") + F.col("b") < CLOSE).groupBy("root", F.col("a").alias("bin")).agg(F.sum("n_b").alias("sure"))
    doubtful = stage(spark, pairs.where((F.col("a") + F.col("b") >= CLOSE) & (F.abs(F.col("a") - F.col("b")) <= CLOSE + 1)).select("root", "a", "b", "n_a", "n_b"), "join_pairs")
    block = F.shiftleft("bin", 32) + F.pmod(F.xxhash64("set"), F.ceil(F.col("n_a") / BLOCK))
    cut = diffs.join(doubtful.select("root", F.col("a").alias("bin"), "n_a").distinct(), ["root", "bin"]).select("root", block.alias("block"), "set", "size", "gone", "centre", "diff")
    blocks = stage(spark, cut.repartition("root", "block").sortWithinPartitions("root", "block", "set").mapInArrow(lean(packed), "root long, block long, sets binary"), "join_blocks")
    # Each block meets the blocks of its doubtful bins, at most STRIDE of them in a task.
    names = blocks.select("root", F.col("block").alias("mine"), F.shiftright("block", 32).alias("a"))
    stride = F.shiftleft("b", 32) + F.floor(F.expr("other & 4294967295") / STRIDE)
    others = blocks.select("root", F.col("block").alias("other"), F.shiftright("block", 32).alias("b"), "sets")
    columns = ["root", "mine", "stride", "other", "sets"]
    targets = doubtful.select("root", "a", "b").join(names, ["root", "a"]).select("root", "b", "mine")
    met = others.join(targets, ["root", "b"]).withColumn("stride", stride).select(*columns)
    strides = others.drop("sets").join(targets, ["root", "b"]).select("root", "mine", stride.alias("stride")).distinct()
    own = blocks.select("root", F.col("block").alias("mine"), "sets").join(strides, ["root", "mine"]).withColumn("other", F.lit(-1).cast("long")).select(*columns)
    met = met.union(own).repartition("root", "mine", "stride").sortWithinPartitions("root", "mine", "stride", "other")
    found = stage(spark, met.mapInArrow(lean(across), result), "join_links")
    roots = components(spark, found.where("n_links is null").select(F.col("set").alias("a"), F.col("label").alias("b")))
    counts = found.where("n_links is not null").groupBy("set").agg(F.sum("n_links").alias("counted"))
    every = diffs.select("set", F.when(F.col("bin") < CLOSE, F.col("root")).otherwise(F.col("set")).alias("label"), "root", "bin").join(sure, ["root", "bin"], "left").join(counts, "set", "left")
    itself = F.when(2 * F.col("bin") < CLOSE, 1).otherwise(0)
    every = every.select("set", "label", (F.coalesce("sure", F.lit(0)) - itself + F.coalesce("counted", F.lit(0))).alias("n_links"))
    every = every.join(roots.withColumnRenamed("root", "lowest"), F.col("label") == F.col("node"), "left").select("set", F.coalesce("lowest", "label").alias("label"), "n_links")
    out = stage(spark, few.union(every), "join_result")
    discard(*staged, diffs, bins, doubtful, blocks, found, roots)
    return out


#: Columns that a result has of its own: kept columns of these names are left out.
OWN = ("doc_id", "class_id", "rep_id", "n_copies", "n_links", LABEL)


def near_classes(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, doc_id, class_id, rep_id, n_copies, n_links of each document.

    rep_id is the smallest doc_id with the same 5-gram set and n_copies their number; n_links counts the other sets
    at the threshold; class_id is the smallest doc_id among all that links connect.
    """
    return _labelled(docs, *keep).drop(LABEL)


def _labelled(docs: DataFrame, *keep: str) -> DataFrame:
    """The rows of ``near_classes`` with the class itself in ``LABEL``: its smallest set hash, null without words."""
    spark = docs.sparkSession
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in OWN]
    names = ["doc_id", *(f"__kept{k}" for k in range(len(kept)))]  # under names that nothing here has
    renamed = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names[1:], strict=True)))
    rows = stage(spark, sketched(renamed, *names), "join_sketches")
    classes = rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep_id"), F.min("name").alias("name"), F.count("*").alias("n_copies"), F.min("vector").alias("vector"))
    classes = stage(spark, classes, "join_classes")
    edges, staged = candidates(spark, classes.select("set", "vector"))
    groups = components(spark, edges)
    discard(*staged)
    wanted = classes.join(groups, F.col("set") == F.col("node")).select("set", "name", "root")
    links = exact_links(spark, docs, wanted)
    discard(groups)
    known = classes.join(links, "set", "left").select("set", "rep_id", "n_copies", F.coalesce("label", "set").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    lowest = known.groupBy("label").agg(F.min("rep_id").alias("class_id"))
    known = known.join(lowest, "label").select("set", "rep_id", "n_copies", "n_links", "class_id", F.col("label").alias(LABEL))
    linked = rows.where("set is not null").select(*names, "set").join(known, "set").select(*names, "class_id", "rep_id", "n_copies", "n_links", LABEL)
    alone = rows.where("set is null").select(*names, F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias(LABEL))
    return linked.union(alone).withColumnsRenamed(dict(zip(names[1:], kept, strict=True)))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate class, with all its columns: the smallest doc_id (null last, then file order).

    Classes are told apart by their sets, not by ids, which may be null or stand on several texts.  Rows without words stay.
    """
    at = unused(docs.columns) + "at"
    try:  # rows of files have a place already
        landed = docs.withColumn(at, F.expr(PLACE))
    except AnalysisException:
        path = shared_dir(docs.sparkSession, "join_landing")
        docs.write.parquet(path)
        landed = docs.sparkSession.read.parquet(path).withColumn(at, F.expr(PLACE))
    rows = _labelled(landed, at)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", at)
    grouped = rows.where(F.col(LABEL).isNotNull()).groupBy(LABEL).agg(F.min_by(at, order).alias(at)).select(at)
    stay = grouped.union(rows.where(F.col(LABEL).isNull()).select(at))
    return landed.join(stay, at, "left_semi").select(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))


#: The same rows where doc_id is unique and not null: all pairs with a common 5-gram are counted, and links are followed.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS size FROM d),
t AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, i, size, concat_ws(' ', word, lead(word, 1) OVER v, lead(word, 2) OVER v, lead(word, 3) OVER v, lead(word, 4) OVER v) AS gram
    FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)) WHERE i = 1 OR i + 4 <= size),
s AS (SELECT d.doc_id, count(gram) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS grams FROM d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT min(doc_id) AS rep_id, count(*) AS n_copies, n, grams FROM s WHERE n > 0 GROUP BY grams, n),
g AS (SELECT rep_id, n, gram FROM k JOIN t ON t.doc_id = k.rep_id),
p AS (
  SELECT a.rep_id AS a, b.rep_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.rep_id <> b.rep_id
  GROUP BY a.rep_id, b.rep_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
reach AS (SELECT rep_id AS a, rep_id AS b FROM k UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a AS rep_id, min(b) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS rep_id, count(*) AS n_links FROM p GROUP BY a)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id, coalesce(k.rep_id, s.doc_id) AS rep_id, coalesce(k.n_copies, 1) AS n_copies, coalesce(n.n_links, 0) AS n_links
FROM s LEFT JOIN k USING (grams) LEFT JOIN c ON c.rep_id = k.rep_id LEFT JOIN n ON n.rep_id = k.rep_id
"""
