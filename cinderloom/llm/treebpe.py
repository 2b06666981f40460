"""Operator 13: byte-level BPE by monoid tree reduction.

The element of a stretch of bytes is its ids.  A stretch is encoded by halves, recursively, down to ``BASE`` bytes, and two
neighbours are joined by encoding a window of ids around their boundary again, which grows on a side until the tokens outside
provably stay.  The proof is a property of any BPE that merges the pair of least rank first, from the left: ids are the
encoding of their bytes if each two neighbours are the encoding of theirs.  (Take the first merge across an end of two of
these tokens.  Until then all merges were the ones that the two tokens see alone, so it would be made in their own encoding too.)
So a window that fits its neighbours outside ends the join, and a boundary whose two tokens fit needs no window.

Where a word of the split pattern ends, tokens never meet, and a join there only appends.  A task encodes texts of up to
``BLOCK`` bytes that way.  A longer text is cut into blocks, at ends of words where there are any and else inside a word, which
are dealt over tasks and joined up a tree in rounds of a shuffle each; a block that ends inside a word knows which of its ids belong to it.
Decoding looks the bytes of ids up in blocks and appends neighbours up the same tree.

Defined results: null or empty text has no ids and decodes to no bytes.  No special tokens: their strings are text.  Rows
with equal or null doc_ids are rows like others.  Kept columns named ``ids`` or ``decoded`` are replaced.  Words and texts of any
length are encoded whole.  An empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import body, bounded_batches, chunks, discard, documents, ranges, stage, utf8
from .pretoken import BatchEncoder, Classes, Vocabulary, cut

#: Bytes that are merged without halving; ids on either side of a boundary that the first window takes.
BASE, WINDOW = 16, 4
#: Bytes of a text that one task encodes; longer texts are dealt over tasks.  Ids that are decoded at a time.
BLOCK, BLOCK_IDS = 1 << 16, 1 << 16
CHUNK_BYTES = 1 << 20
#: Answers about pairs of tokens that a worker remembers.
PAIRS = 1 << 20


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PatternClasses(Classes):
    """Classes of code points as the tiktoken library reads its split pattern."""

    def __init__(self, pattern: str):
        super().__init__()
        self.pattern = pattern

    def _joins(self, points: list[int]) -> list[tuple[bool, bool]]:
        import tiktoken

        pairs = [x + chr(p) for p in points for x in "a1"]
        own = {bytes([b]): b for b in range(256)} | {x.encode(): 256 + i for i, x in enumerate(pairs)}
        library = tiktoken.Encoding("pairs", pat_str=self.pattern, mergeable_ranks=own, special_tokens={})
        whole = [library.encode_ordinary(x) == [256 + i] for i, x in enumerate(pairs)]
        return list(zip(whole[::2], whole[1::2], strict=True))


class Ranks(Vocabulary):
    """A file of ranks: an id is the rank of its bytes, and any two neighbours whose bytes together have a rank may merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added: dict[str, int] = {}
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for b, i in self.ids.items():
            self.bytes[i] = b
        self.single = [self.ids[bytes([b])] for b in range(256)]
        cuts = ((b[:k], b[k:], i) for b, i in self.ids.items() for k in range(1, len(b)))
        self.merges = {(self.ids[x], self.ids[y]): (i, i) for x, y, i in cuts if x in self.ids and y in self.ids}
        self.known: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        if (got := self.known.get((a, b))) is None:
            if len(self.known) > PAIRS:
                self.known.clear()
            got = self.known[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return got

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes together, of their own encodings."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        before = after = WINDOW
        while True:
            i, j = max(0, len(left) - before), min(after, len(right))
            window = self.merge(b"".join([self.bytes[t] for t in left[i:]] + [self.bytes[t] for t in right[:j]]))
            stays = [i == 0 or self.fits(left[i - 1], window[0]), j == len(right) or self.fits(window[-1], right[j])]
            if all(stays):
                return left[:i] + window + right[j:]
            before, after = before * (1 if stays[0] else 2), after * (1 if stays[1] else 2)

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """The encoding of neighbouring stretches together, of their own encodings."""
        while len(leaves) > 1:
            leaves = [self.joined(a, b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)] + leaves[len(leaves) - len(leaves) % 2 :]
        return leaves[0]

    def encoded(self, words: list[bytes], whole: bool = True) -> list[list[int]]:
        """The ids of each word; of ``whole`` words, one that has a rank is its own token.  All words' leaves are merged at once."""
        out = [[self.ids[w]] if whole and w in self.ids else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        leaves = [halves(words[i]) for i in rest]
        flat, count = self.merge_all([x for xs in leaves for x in xs])
        flat, ends, at = flat.tolist(), np.append(0, np.cumsum(count)).tolist(), 0
        for i, xs in zip(rest, leaves, strict=True):
            out[i] = self.tree([flat[a:b] for a, b in zip(ends[at : at + len(xs)], ends[at + 1 : at + len(xs) + 1], strict=True)])
            at += len(xs)
        return out


def halves(raw: bytes) -> list[bytes]:
    """The leaves of a stretch: halves of halves, a power of two of them, of ``BASE`` bytes at most."""
    n = 1
    while len(raw) > BASE * n:
        n *= 2
    at = [len(raw) * k // n for k in range(n + 1)]
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class Coder:
    """What a worker needs to encode and decode with one file of ranks."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.kinds = Ranks(path), PatternClasses(pattern)

        def words(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = self.ranks.encoded([w.encode() for w in new])
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.array([i for x in ids for i in x], np.uint32), count

        self.batches = BatchEncoder(words, {}, kinds=self.kinds)
        self.raw = np.frombuffer(b"".join(self.ranks.bytes), np.uint8)
        self.ends = np.append(0, np.cumsum([len(b) for b in self.ranks.bytes]))

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The bytes of the ids between each two offsets."""
        ids = ids[at[0] : at[-1]]
        size = self.ends[ids + 1] - self.ends[ids]
        ends = np.append(0, np.cumsum(size))[at - at[0]]
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(self.raw[ranges(self.ends[ids], size)])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, buffers).cast(pa.binary())

    def blocks(self, raw: bytes, size: int) -> Iterator[tuple[bool, bool, bytes]]:
        """Blocks of about ``size`` bytes of a text, and whether each one's left and right end are inside a word.

        A window shows where words start but for its last characters, on which a contraction or white space may still hang.
        """
        at, inside = 0, False
        while at < len(raw):
            end = min(at + size, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            if end == len(raw):
                yield inside, False, raw[at:]
                return
            points = np.frombuffer(raw[at:end].decode().encode("utf-32-le"), np.uint32)
            start = cut(points, np.array([0, len(points)]), self.kinds)
            good = start[(start > 0) & (start <= len(points) - 3)]
            # Inside a word, three of its characters are left for the next block, so that its head can't be read otherwise.
            here = int(good[-1]) if len(good) else (int(start[-1]) or len(points)) - 3
            step = len(points[:here].tobytes().decode("utf-32-le").encode())
            yield inside, not len(good), raw[at : at + step]
            at, inside = at + step, not len(good)

    def leaf(self, raw: bytes, left: bool, right: bool) -> tuple[list[int], int, int]:
        """Ids of a block, and how many of them belong to the words that its left and right end cut."""
        text = raw.decode()
        if not left and not right:
            return self.batches.encode([text])[0].tolist(), 0, 0
        start = cut(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)]), self.kinds)
        first = len(text) if right or len(start) < 2 else int(start[1])
        (head,) = self.ranks.encoded([text[:first].encode()], whole=False)
        rest = self.batches.encode([text[first:]])[0].tolist() if first < len(text) else []
        return head + rest, len(head) if left else 0, len(head) if right else 0

    def joined(self, a: dict, b: dict) -> dict:
        """The node of two neighbouring nodes (left, right, head, tail, ids)."""
        if not a["right"]:
            return {"left": a["left"], "right": b["right"], "head": a["head"], "tail": b["tail"], "ids": a["ids"] + b["ids"]}
        n = len(a["ids"]) - a["tail"]
        word = self.ranks.joined(a["ids"][n:], b["ids"][: b["head"]])
        ids = a["ids"][:n] + word + b["ids"][b["head"] :]
        through = [a["left"] and not n, b["right"] and b["head"] == len(b["ids"])]  # the word goes on beyond this end
        return {"left": a["left"], "right": b["right"], "head": len(word) if through[0] else a["head"], "tail": len(word) if through[1] else b["tail"], "ids": ids}


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def reduced(nodes: DataFrame, join: Callable[[dict, dict], dict], name: str) -> DataFrame:
    """One node for each ``row`` of (row, node, rest, values...): neighbours 2k and 2k + 1 are joined level by level.

    A level is one shuffle by (row, pair) and one staged table; no task gets more than two nodes of a row at once.
    """
    spark = nodes.sparkSession
    nodes = stage(spark, nodes, name)
    schema, fields = nodes.schema, nodes.columns[3:]
    kinds = to_arrow_schema(schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, node, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, *others = sorted(parts, key=lambda p: p["node"])
                value = {f: first[f] for f in fields}
                for other in others:
                    value = join(value, other)
                yield pa.RecordBatch.from_pylist([{"row": row, "node": node, "rest": first["rest"], **value}], kinds)

    most = nodes.agg(F.max("node")).first()[0] or 0
    while most:
        two = nodes.groupBy("row", F.shiftright("node", 1).alias("up")).agg(F.collect_list(F.struct("node", "rest", *fields)).alias("parts"))
        old, nodes = nodes, stage(spark, two.mapInArrow(pairs, schema), name)
        discard(old)
        most >>= 1
    return nodes


def _rest(columns: list[str]) -> Column:
    return F.struct(*([F.col(f"`{c}`") for c in columns] or [F.lit(None).cast("int").alias("none")]))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(values[at[0] : at[-1]].astype(np.int32)))


def _packed(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers."""
    raw = np.ascontiguousarray(ids[at[0] : at[-1]].astype("<u4"))
    buffers = [None, pa.py_buffer(4 * (at - at[0])), pa.py_buffer(raw)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, buffers).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, *keep: str, packed: bool = False, check: bool = False, block: int = BLOCK) -> DataFrame:
    """``keep`` and ``ids`` of each whole ``text``: an array of int, or with ``packed`` its little-endian 32-bit bytes.

    ``check`` adds ``decoded``: the bytes that the ids stand for.  Only texts of more than ``block`` bytes are shuffled.
    """
    spark, kept = docs.sparkSession, [c for c in dict.fromkeys(keep) if c.lower() not in ("ids", "decoded")]
    bounded_batches(spark)
    own = [docs.schema[c] for c in kept]
    more = [T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)), *[T.StructField("decoded", T.BinaryType())] * check]
    schema = T.StructType([*own, *more])
    names, form = [f.name for f in schema], _packed if packed else _lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            raw, offsets = utf8(batch.column(len(kept)))
            for i, j in chunks(offsets, CHUNK_BYTES):
                ids, at = c.batches.encode_utf8(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*part, form(ids, at), *[c.decoded(ids, at)] * check], names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                for node, (left, right, raw) in enumerate(c.blocks(batch.column(2)[i].as_py().encode(), block)):
                    rest = batch.column(1).take(pa.array([i if node == 0 else None], pa.int32()))  # other nodes carry none
                    columns = [batch.column(0).slice(i, 1), pa.array([node], pa.int32()), rest, pa.array([left]), pa.array([right]), pa.array([raw], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "node", "rest", "left", "right", "raw"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids, head, tail = c.leaf(one.column(5)[0].as_py(), one.column(3)[0].as_py(), one.column(4)[0].as_py())
                yield pa.RecordBatch.from_arrays([*one.columns[:5], pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["row", "node", "rest", "left", "right", "head", "tail", "ids"])

    def join(a: dict, b: dict) -> dict:
        return coder(path, pattern).joined(a, b)

    size = F.octet_length(body())
    short = docs.where(size <= block).select(*(F.col(f"`{c}`") for c in kept), body().alias("__text")).mapInArrow(run, schema)
    long = docs.where(size > block).select(F.monotonically_increasing_id().alias("row"), _rest(kept).alias("rest"), body().alias("__text"))
    rest = T.StructType([T.StructField("row", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("rest", long.schema["rest"].dataType), T.StructField("left", T.BooleanType()), T.StructField("right", T.BooleanType())])
    cut_up = long.mapInArrow(blocks, T.StructType([*rest, T.StructField("raw", T.BinaryType())]))
    values = [T.StructField("head", T.LongType()), T.StructField("tail", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    nodes = cut_up.repartition("row", "node").mapInArrow(leaves, T.StructType([*rest, *values]))
    whole = reduced(nodes, join, "tree_ids").select(*(F.col(f"rest.`{c}`").alias(c) for c in kept), "ids")
    if check:
        whole = decode(whole, path, pattern, *kept, "ids")
    if packed:
        whole = whole.withColumn("ids", packed_ids("ids"))
    return short.union(whole.select(*(F.col(f"`{c}`") for c in names)))


def packed_ids(ids: str) -> Column:
    """An array of ids as little-endian 32-bit bytes."""
    turned = F.transform(ids, lambda x: F.lpad(F.hex(F.shiftleft(x.bitwiseAND(255).cast("long"), 24) + F.shiftleft(F.shiftright(x, 8).bitwiseAND(255), 16) + F.shiftleft(F.shiftright(x, 16).bitwiseAND(255), 8) + F.shiftrightunsigned(x, 24)), 8, "0"))
    return F.unhex(F.array_join(turned, ""))


def decode(encoded: DataFrame, path: str, pattern: str, *keep: str, block: int = BLOCK_IDS) -> DataFrame:
    """``keep`` and ``decoded``, the bytes that ``ids`` stand for; null counts as none.

    More than ``block`` ids are dealt over tasks in blocks, whose bytes are appended up a tree.
    """
    kept = [c for c in dict.fromkeys(keep) if c.lower() != "decoded"]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            lists = batch.column(len(kept))
            at = lists.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], c.decoded(lists.values.to_numpy(), at)], [f.name for f in schema])

    ids, n = F.coalesce("ids", F.array().cast("array<int>")), F.coalesce(F.size("ids"), F.lit(0))
    short = encoded.where(n <= block).select(*(F.col(f"`{c}`") for c in kept), ids.alias("__ids")).mapInArrow(run, schema)
    long = encoded.where(n > block).select(F.monotonically_increasing_id().alias("row"), _rest(kept).alias("rest"), ids.alias("ids"))
    parts = long.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / block).cast("int")), lambda k: F.slice("ids", k * block + 1, F.lit(block)))).alias("node", "__ids"), "rest")
    parts = parts.select("row", "node", F.when(F.col("node") == 0, F.col("rest")).alias("rest"), "__ids").repartition("row", "node")
    kept, own = ["row", "node", "rest"], schema
    schema = T.StructType([*(parts.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])
    whole = reduced(parts.mapInArrow(run, schema), lambda a, b: {"decoded": a["decoded"] + b["decoded"]}, "tree_bytes")
    return short.union(whole.select(*(F.col(f"rest.`{f.name}`").alias(f.name) for f in own if f.name != "decoded"), "decoded"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(documents(spark, sf_dir), ranks_path(), split_pattern(), "doc_id", packed=True, check=True)
    return rows.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
