"""Operator 9: a quality classifier by ordinal cumulative-link regression.

Grades ascend; one weight per hashed text feature is shared by all grades, and ordered thresholds cut the
score's scale: P(grade > k) = sigmoid(score - threshold_k).  The fit uses a bounded sample of rated rows; every
document is then scored in one pass over its whole text.

Grades made from ``labels``: 0 toxic, 1 not toxic but of low quality, 2 neither.

Defined results: unrated documents are scored like the others.  Null or empty text has the shape features of
an empty text only.  Ratings with nulls are left out, and of several ratings of a document the lowest counts.
Of several texts with one id the fit uses the least.  Without any rating all weights are 0 and each grade is equally
likely.  Repeated rows are scored one by one.  A long text is scored whole.  Columns other than doc_id and text are not
used, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHARS, body, bounded_batches, chunks, documents, prefix, ranges, stage, stretch, utf8

GRADES = 3
#: Hashed features, and rated rows that a fit uses at most (chosen by a hash of the id, whatever the order).
BITS, SAMPLE = 20, 20_000
#: Bytes of text of these rows at most: the first ones by that hash that fit.
SAMPLE_BYTES = 256 << 20
#: The first so many bytes of longer words are features too.
STEMS = (5, 7)
EPOCHS, RATE, DECAY, SEED = 12, 0.15, 3e-4, 7
#: A document is kept if the top grade is at least this likely.
KEEP = 0.5
CHUNK_BYTES = 1 << 20


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text (flat, and offsets): lower-case words, sign runs, shape of the text."""
    n = len(offsets) - 1
    kind = np.full(256, 2, np.uint8)  # 0 white space, 1 word, 2 sign
    kind[[32, *range(9, 14)]] = 0
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    upper = np.zeros(256, np.uint8)
    upper[65:91] = 32
    k = kind[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = k[1:] != k[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    ink = k[start] > 0
    start, end = start[ink], end[ink]
    row = np.searchsorted(offsets, start, "right") - 1
    sums = prefix(raw + upper[raw], CHARS)
    words = np.bincount(row, minlength=n)
    parts = [(row, stretch(sums, start, end, CHARS))]
    for size in STEMS:
        long = end - start > size
        parts.append((row[long], ~stretch(sums, start[long], start[long] + size, CHARS)))
    key = np.unique(np.concatenate([(r.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for r, h in parts]))
    of = (key >> np.uint64(BITS)).astype(np.int64)
    distinct = np.bincount(of, minlength=n)
    per = lambda flags: np.add.reduceat(np.append(flags, 0), offsets[:-1], dtype=np.int64) * (offsets[1:] > offsets[:-1]) if n else np.zeros(0, np.int64)
    size = np.maximum(offsets[1:] - offsets[:-1], 1)
    shape = [
        np.minimum(20 * per(upper[raw] > 0) // size, 19),
        np.minimum(40 * per(k == 2) // size, 39),
        np.minimum(20 * distinct // np.maximum(words, 1), 20),
        np.minimum(np.log2(np.maximum(words, 1)).astype(np.int64), 30),
        np.minimum(size // np.maximum(words, 1), 30),
    ]
    # Shapes get the places below len(shape) * 64; few words hash there.
    shapes = np.stack([64 * i + s for i, s in enumerate(shape)], 1) if n else np.zeros((0, len(shape)), np.int64)
    width = shapes.shape[1]
    at = np.zeros(n + 1, np.int64)
    np.cumsum(distinct + width, out=at[1:])
    flat = np.zeros(int(at[-1]), np.int32)
    flat[ranges(at[:-1], distinct)] = (key & np.uint64((1 << BITS) - 1)).astype(np.int32)
    flat[(at[1:, None] - width + np.arange(width)).ravel()] = shapes.ravel()
    return flat, at


class Ordinal:
    """Cumulative-link regression over sparse 0/1 features."""

    def __init__(self, grades: int = GRADES, size: int = 1 << BITS):
        self.weights, self.cuts = np.zeros(size, np.float32), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))

    def score(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        return np.add.reduceat(self.weights[flat], at[:-1], dtype=np.float64)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -30, 30)))

    def fit(self, flat: np.ndarray, at: np.ndarray, grade: np.ndarray, epochs: int = EPOCHS, batch: int = 64) -> Ordinal:
        """AdaGrad on the negative log likelihood; thresholds are kept in order."""
        rng, n = np.random.default_rng(SEED), len(grade)
        past, past_cuts = np.full(len(self.weights), 1e-2, np.float32), np.full(len(self.cuts), 1e-2)
        for _ in range(epochs):
            order = rng.permutation(n)
            for rows in np.array_split(order, max(1, n // batch)) if n else []:
                size = at[rows + 1] - at[rows]
                feats = flat[ranges(at[rows], size)]
                score = np.add.reduceat(self.weights[feats], np.cumsum(size) - size, dtype=np.float64)
                p = np.pad(self.tails(score), ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0)))
                slope = p * (1 - p)  # of each tail by the score
                g = grade[rows]
                line = np.arange(len(rows))
                chance = np.maximum(p[line, g] - p[line, g + 1], 1e-9)
                by_score = -(slope[line, g] - slope[line, g + 1]) / chance
                by_cut = np.zeros((len(rows), len(self.cuts) + 2))
                by_cut[line, g] += slope[line, g] / chance
                by_cut[line, g + 1] -= slope[line, g + 1] / chance
                which, inverse = np.unique(feats, return_inverse=True)
                grad = np.bincount(inverse, np.repeat(by_score, size)) / len(rows) + DECAY * self.weights[which]
                past[which] += grad**2
                self.weights[which] -= (RATE * grad / np.sqrt(past[which])).astype(np.float32)
                cut = by_cut[:, 1:-1].mean(0)
                past_cuts += cut**2
                self.cuts = np.maximum.accumulate(self.cuts - RATE * cut / np.sqrt(past_cuts))
        return self


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, grade) of the rated documents that the fit uses, one row for each id."""
    spark = docs.sparkSession
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    ratings = labels.where("doc_id is not null and toxic is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # at most ``sample`` rows are sent
    rows = stage(spark, rows, "rated")
    # Ids and sizes of at most ``sample`` rows are put in order.
    held = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = rows.select("doc_id", held.alias("held")).where(F.col("held") <= sample_bytes).select("doc_id")
    return rows.join(F.broadcast(fits), "doc_id").select("doc_id", "text", "grade")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Features are made on the executors; the bounded sample of them is fitted on the driver, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                flat, at = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["doc_id", "grade", "features"])

    bounded_batches(docs.sparkSession)
    rows = rated(docs, labels, sample).mapInArrow(run, "doc_id long, grade int, features array<int>").toArrow().combine_chunks().sort_by("doc_id")
    model = Ordinal()
    if rows.num_rows:
        lists = rows["features"].combine_chunks()
        flat = lists.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        model.fit(flat, at, rows["grade"].to_numpy().astype(np.int64))
    return model


def scored(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, score, expected_grade, p_top (probability of the top grade) and kept of each document."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ordinal(size=1)
        model.weights, model.cuts = sent.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                score = model.score(*features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                tails = model.tails(score)
                columns = [batch.column(0).slice(i, j - i), *map(pa.array, (score, tails.sum(1), tails[:, -1], tails[:, -1] >= KEEP))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "expected_grade", "p_top", "kept"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, expected_grade double, p_top double, kept boolean")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
