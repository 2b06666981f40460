"""Operator 11: importance resampling towards a target distribution, on hashed word n-grams.

Arrow kernels make the features of a batch: ascii_lower, split_pattern_regex and list_flatten give its words,
dictionary_encode numbers them, and shifted numbers form pairs and triples, which are numbered again, so that only
distinct n-grams are hashed.  The CRC-32 of an n-gram is made of its words' CRCs: the checksum of what stands before a word is
moved on by the word's length with four table lookups.  One pass over the corpus and one over the target add up
buckets in each task; a second pass over the corpus takes the gains of all features and adds them up by document.

A bucket's gain compares smoothed shares: floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))).  Scores add a
Gumbel number that the seeded digest of the id gives, so the highest scores are a weighted sample without replacement.

Defined results: null or empty text has no words, no features and weight 0.  A null doc_id is hashed as the empty string; it
comes last among equal scores, and rows that tie in score and id are drawn in file order.  Runs of non-ASCII characters are words.
Texts of any length are taken whole; one takes some
100 times its size.  An empty corpus gives an empty result, an empty target smoothed shares only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import body, bounded_batches, chunks, documents, shared_dir, unused, utf8

#: Buckets of hashed features, words of the longest one, and the seed.
BUCKETS, NGRAM, SEED = 10_000, 3, 42
#: Documents with fewer words aren't drawn; percent of the others that are.
MIN_WORDS, PERCENT = 20, 5
#: What stands between words (A-Z are lower-cased before).
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK_BYTES = 1 << 20
#: Bytes of a word for which the tables of CRC_MOVES reach; longer moves are composed of shorter ones.
MOVES = 64


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """How zero bytes change a CRC-32 register: for each of its four bytes' values, ``MOVES`` single steps and the steps of 2**k bytes."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    one = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    small = [one]
    for _ in range(MOVES):
        one = step[one & np.uint32(255)] ^ (one >> np.uint32(8))
        small.append(one)
    double = [small[1]]
    for _ in range(31):
        double.append(_move(double[-1], double[-1]))
    return np.stack(small), np.stack(double)


def _move(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & np.uint32(255)] ^ table[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ table[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


CRC_MOVES, CRC_DOUBLES = _crc_tables()


def crc_joined(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after the other, of their own ones and the length of the second."""
    flat = CRC_MOVES.reshape(-1)
    base = np.minimum(size, MOVES).astype(np.int64) * 1024
    out = flat[base + (head & np.uint32(255))]
    for k in range(1, 4):
        out = out ^ flat[base + 256 * k + ((head >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
    far = np.flatnonzero(size > MOVES)
    if len(far):
        moved, left = head[far], size[far].astype(np.int64)
        for k in range(int(left.max()).bit_length()):
            on = (left >> k) & 1 == 1
            moved[on] = _move(moved[on], CRC_DOUBLES[k])
        out[far] = moved
    return out ^ tail


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and the number of each value among them."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of all features of each text, rows ascending for each length, and the words of each text."""
    lists = pc.split_pattern_regex(pc.ascii_lower(text), BREAK)
    row = pc.list_parent_indices(lists).to_numpy()
    words = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(words), 0)  # a text that begins or ends with a break has empty ends
    row, words = row[full.to_numpy(zero_copy_only=False)], words.filter(full).dictionary_encode()
    count = np.bincount(row, minlength=len(text))
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    spelled, word = [w.encode() for w in words.dictionary.to_pylist()], words.indices.to_numpy().astype(np.int64)
    crc = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled))
    after = np.fromiter((zlib.crc32(b" " + w) for w in spelled), np.uint32, len(spelled))
    size = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
    rows, buckets, kind, number = [row], [(crc % BUCKETS)[word].astype(np.int64)], crc, word
    for n in range(1, NGRAM):
        same = row[n:] == row[:-n]
        pair, code = _numbered((number[: len(word) - n] * len(spelled) + word[n:])[same])
        kind = crc_joined(kind[pair // len(spelled)], after[pair % len(spelled)], size[pair % len(spelled)])
        rows.append(row[n:][same])
        buckets.append((kind % BUCKETS)[code].astype(np.int64))
        number = np.zeros(len(word) - n, np.int64)  # where a text ends, no longer n-gram begins
        number[same] = code
    return np.concatenate(rows), np.concatenate(buckets), count


def _parts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    _, offsets = utf8(column)
    for i, j in chunks(offsets, CHUNK_BYTES):
        yield i, column.slice(i, j - i)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n) of all features of ``text``; each task sends at most ``BUCKETS`` sums to the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, part in _parts(batch.column(0)):
                total += np.bincount(features(part)[1], minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    bounded_batches(docs.sparkSession)
    return docs.select(body().alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all buckets, of the ``bucket_counts`` of the corpus and of the target."""
    spark = corpus.sparkSession
    both = corpus.select("bucket", F.col("n").alias("here"), F.lit(0).alias("there")).union(target.select("bucket", F.lit(0), "n"))
    every = both.union(spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0), F.lit(0)))
    rows = every.groupBy("bucket").agg(F.sum("here").cast("double").alias("here"), F.sum("there").cast("double").alias("there"))
    whole = Window.partitionBy()  # of BUCKETS rows
    ratio = (F.col("there") + 1) * (F.sum("here").over(whole) + BUCKETS) / ((F.col("here") + 1) * (F.sum("there").over(whole) + BUCKETS))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


#: Columns that a result has of its own; kept columns of these names are left out.
OWN = ("n_words", "n_features", "weight")


def weighed(docs: DataFrame, gain: DataFrame, *keep: str) -> DataFrame:
    """``keep``, n_words, n_features and weight of each document; ``gain`` has ``BUCKETS`` rows, which all tasks get."""
    table = np.zeros(BUCKETS, np.int64)
    for bucket, value in gain.collect():
        table[bucket] = value
    names = [c for c in dict.fromkeys(keep) if c.lower() not in OWN]
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in _parts(batch.column(len(names))):
                row, bucket, words = features(part)
                order = np.argsort(row, kind="stable")
                n = np.bincount(row, minlength=len(part))
                sums = np.append(np.add.reduceat(table.take(bucket[order]), np.cumsum(n[n > 0]) - n[n > 0]), 0) if len(row) else np.zeros(1, np.int64)
                weight = np.zeros(len(part), np.int64)
                weight[n > 0] = sums[: int((n > 0).sum())]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, len(part)) for c in batch.columns[: len(names)]), *map(pa.array, (words, n, weight))], [*names, "n_words", "n_features", "weight"])

    bounded_batches(docs.sparkSession)
    schema = ", ".join([x for x in (own,) if x] + ["n_words long, n_features long, weight long"])
    return docs.select(*(F.col(f"`{c}`") for c in names), body().alias("__text")).mapInArrow(run, schema)


def score(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """Weight plus 1000 times a Gumbel number of the id, rounded down."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` to rows (doc_id, n_words, score, ...): 1, 2, 3... for the highest scores, null for rows that aren't drawn.

    Rows are dealt by ranges of their order and numbered within each; one task adds up the sizes of the ranges only.
    """
    spark, columns = scored.sparkSession, [F.col(f"`{c}`") for c in scored.columns]
    own = unused(scored.columns)
    at, place, row, n, before, most = (own + x for x in ("at", "range", "row", "n", "before", "most"))
    path = shared_dir(spark, "importance_scores")
    scored.write.parquet(path)
    rows = spark.read.parquet(path)
    enough = F.col("n_words") >= min_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc(at)]
    placed = rows.where(enough).withColumn(at, F.struct("_metadata.file_name", "_metadata.row_index"))
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    # Within a task of sorted rows this id counts up from 2**33 times the task's number.
    ranged = ranged.select(*columns, F.shiftright(F.monotonically_increasing_id(), 33).alias(place), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(row))
    path = shared_dir(spark, "importance_order")
    ranged.write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy(place).agg(F.count("*").alias(n))
    earlier = F.sum(n).over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(place, F.coalesce(earlier, F.lit(0)).alias(before), F.floor(F.sum(n).over(Window.partitionBy()) * percent / 100).alias(most))
    rank = F.col(before) + F.col(row) + 1
    ranged = ranged.join(F.broadcast(starts), place)  # as many rows as a shuffle has partitions
    ranged = ranged.select(*columns, F.when(rank <= F.col(most), rank).alias("rank"))
    return ranged.union(rows.where(~enough).select(*columns, F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document of ``docs``."""
    rows = weighed(docs, gains(bucket_counts(docs), bucket_counts(target)), "doc_id")
    return drawn(rows.select("doc_id", "n_words", "n_features", "weight", score(F.col("doc_id"), F.col("weight")).alias("score")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: The same rows where doc_id is unique and not null.  CRC-32 goes over the bytes of each distinct feature with a table of 256 steps.
OP11_SQL = r"""
WITH steps AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b)),
texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT kind, id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM words),
counted AS (SELECT kind, id, gram, count(*) AS n FROM grams GROUP BY kind, id, gram),
hashed AS (
  SELECT gram, xor(4294967295, list_reduce(
    list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM counted)), steps),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM counted JOIN hashed USING (gram) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM sums) + 10000)))) AS BIGINT) AS g FROM sums),
docs AS (
  SELECT w.id AS doc_id, len(w) AS n_words, coalesce(f.n, 0) AS n_features, coalesce(f.weight, 0) AS weight,
    coalesce(f.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || w.id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words w LEFT JOIN (SELECT id, sum(n) AS n, sum(n * g) AS weight FROM counted JOIN hashed USING (gram) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id) f USING (id)
  WHERE kind = 0),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM docs WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM docs LEFT JOIN ranks USING (doc_id)
"""
