"""Operator 1: byte-level BPE encoding and decoding.

Corpus words are counted by Spark; the frequent ones are compiled, with their ids as outputs, into a minimal
acyclic transducer (equal suffixes are shared, outputs are numbers added along the path).  Each Python worker
maps its bytes into memory and looks whole arrays of words up; words it lacks are merged exactly.

Defined results: null or empty text has no ids and decodes to the empty text.  The text of an added token
(such as an end mark) becomes that token's id, as in the tokenizers library.  Repeated rows and null doc_ids
are kept row by row; other columns pass through, but for those named ids and decoded, which are replaced.  A long text
is encoded in one piece; a word of any length is merged whole.  An empty table gives an empty table.

Memory: a task that counts holds short words only (``word_counts``).  One that encodes takes about 1 MB of text at a time, or one
text, and some 60 times that; it remembers 300,000 words of 64 MB in all, and keeps no very long ones.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, bounded_batches, chunks, discard, documents, lean, ranges, stage, utf8
from .pretoken import BatchEncoder, Vocabulary, cut

#: Words in the lexicon: bounds what the driver gathers and sends (some 2 MB), whatever the corpus is.
LEXICON_WORDS = 20_000
#: Longer words stay out of the lexicon and are merged where they occur.
LONGEST = 64
CHUNK_BYTES = 1 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --- the lexicon ---------------------------------------------------------------------------------------


class Lexicon:
    """A minimal acyclic transducer from words to numbers 0..n-1, and the ids of each number."""

    FIELDS = (("arc", np.int64), ("target", np.int32), ("add", np.int32), ("final", np.int32), ("first", np.int64), ("flat", np.int32))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: list[bytes], ids: list[list[int]]) -> Lexicon:
        """``words`` ascending and distinct.  States are merged from the end as soon as a branch is complete."""
        finals, arcs, known = [False], [{}], {}
        path, last = [0], b""
        for word in [*words, b""]:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            while len(path) > same + 1:
                state = path.pop()
                shape = (finals[state], tuple(arcs[state].items()))
                arcs[path[-1]][last[len(path) - 1]] = known.setdefault(shape, state)
            for b in word[same:]:
                finals.append(False)
                arcs.append({})
                arcs[path[-1]][b] = len(arcs) - 1
                path.append(len(arcs) - 1)
            if word:
                finals[path[-1]] = True
            last = word
        below: dict[int, int] = {}

        def count(state: int) -> int:
            if state not in below:
                below[state] = finals[state] + sum(count(t) for t in arcs[state].values())
            return below[state]

        arc, target, add, order, seen = [], [], [], [0], {0: 0}
        for state in order:  # breadth first: states are numbered as they are met, so arcs ascend by (state, byte)
            passed = int(finals[state])
            for b, t in sorted(arcs[state].items()):
                if t not in seen:
                    seen[t] = len(order)
                    order.append(t)
                arc.append((seen[state] << 8) | b)
                target.append(seen[t])
                add.append(passed)
                passed += count(t)
        first = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=first[1:])
        return cls(arc=np.array(arc, np.int64), target=np.array(target, np.int32), add=np.array(add, np.int32), final=np.array([finals[s] for s in order], np.int32), first=first, flat=np.array([i for x in ids for i in x], np.int32))

    def dump(self) -> bytes:
        parts = [np.array([len(getattr(self, f)) for f, _ in self.FIELDS], np.int64).tobytes()]
        for f, kind in self.FIELDS:
            raw = getattr(self, f).astype(kind).tobytes()
            parts.append(raw + bytes(-len(raw) % 8))
        return b"".join(parts)

    @classmethod
    def mapped(cls, raw: bytes) -> Lexicon:
        """Put the bytes in a nameless file of this worker and map it: pages are shared with the system's cache."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
        sizes, at, arrays = np.asarray(whole[: 8 * len(cls.FIELDS)]).view(np.int64), 8 * len(cls.FIELDS), {}
        for (name, kind), n in zip(cls.FIELDS, sizes.tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            arrays[name] = whole[at : at + size].view(kind)
            at += size + -size % 8
        return cls(**arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1; all words step through the states together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, n)
        raw, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        if not len(self.arc):
            return out
        live, state, number, step = np.flatnonzero(size > 0), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(live):
            key = (state[live] << 8) | raw[start[live] + step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[at] == key
            live, at = live[hit], at[hit]
            state[live] = self.target[at]
            number[live] += self.add[at]
            step += 1
            ends = size[live] == step
            good = live[ends & (self.final[state[live]] == 1)]
            out[good] = number[good]
            live = live[~ends]
        return out


def short_words(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The tokenizer's words of at most ``LONGEST`` bytes in texts that stand one after the other in UTF-8."""
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    start = cut(points, np.searchsorted(begins, offsets))
    at = np.append(begins[start], len(raw)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw)))
    return words.filter(pa.array(np.diff(at) <= LONGEST))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents: the tokenizer's words of at most ``LONGEST`` bytes, added up in each task before the shuffle.

    A task holds 400,000 of them at most, so some 50 MB whatever the texts are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for i, j in chunks(offsets, CHUNK_BYTES):
                words = short_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).value_counts()
                for word, n in zip(words.field("values").to_pylist(), words.field("counts").to_pylist(), strict=True):
                    found[word] += n
                if len(found) > 400_000:
                    yield out()
                    found.clear()
        yield out()

    bounded_batches(docs.sparkSession)
    return docs.select(body().alias("text")).mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, size: int) -> list[tuple[str, int]]:
    """The most frequent words, ``size`` at most: whole classes of about equal counts, as many as fit.

    Only the sizes of the classes (at most a thousand) and the chosen words, of ``LONGEST`` bytes each at most, come to the driver.
    """
    counts = stage(docs.sparkSession, word_counts(docs).withColumn("class", F.floor(F.log2("n") * 16).cast("int")), "bpe_counts")
    room, least = size, None
    for row in sorted(counts.groupBy("class").count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["class"]
    chosen = [] if least is None else [(r.word, r.n) for r in counts.where(F.col("class") >= least).select("word", "n").collect()]
    discard(counts)
    return chosen


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> Lexicon:
    """The frequent words of the corpus with their ids."""
    words = sorted(w.encode() for w, _ in frequent_words(docs, size))
    vocab = vocabulary(path)
    return Lexicon.compile(words, [vocab.merge(w) for w in words])


# --- encoding and decoding -----------------------------------------------------------------------------

_ENCODERS: dict[str, BatchEncoder] = {}


def _encoder(path: str, name: str, raw: bytes) -> BatchEncoder:
    """One encoder a worker process and lexicon."""
    if name not in _ENCODERS:
        vocab, lexicon = vocabulary(path), Lexicon.mapped(raw)

        def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            spelled = [w.encode() for w in words]
            number = lexicon.find(spelled)
            rest = np.flatnonzero(number < 0)
            flat, many = vocab.merge_all([spelled[i] for i in rest.tolist()])
            known = np.maximum(number, 0)
            start = lexicon.first[known] if len(lexicon.first) > 1 else np.zeros(len(words), np.int64)
            count = lexicon.first[known + 1] - start if len(lexicon.first) > 1 else np.zeros(len(words), np.int64)
            start[rest] = len(lexicon.flat) + np.cumsum(many) - many
            count[rest] = many
            return np.concatenate([lexicon.flat, flat.astype(np.int32)])[ranges(start, count)].astype(np.uint32), count

        _ENCODERS.clear()
        _ENCODERS[name] = BatchEncoder(encode_words, vocab.added, remember=300_000)
    return _ENCODERS[name]


def encode(docs: DataFrame, lexicon: Lexicon, path: str, check: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int), the tokenizer's ids of the whole ``text``; ``check`` adds ``decoded``, made from the ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    raw, name = spark.sparkContext.broadcast(lexicon.dump()), uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    more = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *[T.StructField("decoded", T.StringType())] * check]
    schema = T.StructType([*(docs.schema[c] for c in kept), *more])
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, name, raw.value)
        for batch in batches:
            raw_text, offsets = utf8(batch.column(place))
            for i, j in chunks(offsets, CHUNK_BYTES):
                part = batch.slice(i, j - i)
                ids, at = coder.encode_utf8(raw_text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *[texts(ids, at, path)] * check], [f.name for f in schema])

    return docs.select(*kept).mapInArrow(lean(run), schema)


@lru_cache(2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, one after the other, and their offsets."""
    table = vocabulary(path).bytes
    return np.frombuffer(b"".join(table), np.uint8), np.append(0, np.cumsum([len(b) for b in table]))


def texts(ids: np.ndarray, at: np.ndarray, path: str) -> pa.Array:
    """The texts that the ids between each two offsets stand for; bytes that are not UTF-8 become U+FFFD, text by text."""
    raw, offsets = _pieces(path)
    ids = ids[at[0] : at[-1]]
    size = offsets[ids + 1] - offsets[ids]
    out = raw[ranges(offsets[ids], size)]
    ends = np.append(0, np.cumsum(size))[at - at[0]]
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends), pa.py_buffer(out)])
    try:
        return whole.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the text that ``ids`` stand for, special tokens included."""
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("decoded", T.StringType())])
    place = kept.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column(place), [])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts(lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64), path)], [*kept, "decoded"])

    bounded_batches(encoded.sparkSession)
    return encoded.select(*kept).mapInArrow(lean(run), schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), vocabulary_path()
    rows = encode(docs.select("doc_id", "text"), build_lexicon(docs, path), path, check=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
