"""Operator 12: compression of vectors to codes of their parts (product quantisation) with member-resident Lloyd rounds.

Components become integers, floor(4096 * x), so that all sums and distances are exact.  Vectors are cut into equal parts, and each
part position has a codebook, which starts as that part of the first vectors by id.  The parts are the members of
owners, which are partitions by (position, entry, salt): an entry with very many members has several.  In a round each owner adds
its resident members up by entry, and only these sums, a few for each task, meet and move the entries.  The owners then
judge their members by the new codebook where they lie: a member that keeps its entry stays in its place, and only those that change
it go through the next shuffle to their new owner.  When none does, later rounds would change nothing.

Codes and errors are then read off the final codebook, one vector at a time.

Defined results: vectors that are null or have null, infinite or NaN components are left out, and so are those of another length than the
first vector by id whose length is a multiple of the number of parts; components beyond +-4096 count as that.
Rows with one vec_id are vectors of their own, the lesser vector first; a null vec_id comes last.  With fewer vectors than entries a codebook is
shorter.  Null labels are one label.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, frequent, spread_join, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest size of an integer component: then no squared distance of vectors of up to 4,096 components leaves 63 bits.
LARGEST = 1 << 24
#: Members that an owner has on average if all parts of a position choose one entry.
OWNER_ROWS = 1 << 20
#: Differences that are held at a time.
CELLS = 1 << 21


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The other columns, and ``v``: integer components of the vectors that have only finite ones."""
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is greater
    whole = F.transform(column, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    kept = [c for c in vectors.columns if c not in (column, "v")]
    return vectors.where(F.col(column).isNotNull() & finite).select(*kept, whole.alias("v"))


def start(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The first codebooks [parts, entries, length] of (vec_id, v); the driver gets ``entries`` vectors."""
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    fit = vectors.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    if not (first := fit.orderBy(*order).select("v").head(1)):
        return np.zeros((parts, 0, 0), np.int64)
    size = len(first[0].v)
    rows = fit.where(F.size("v") == size).orderBy(*order).select("v").head(entries)
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, size // parts).transpose(1, 0, 2)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of the nearest entries of ``book`` [entries, length] for each row of ``part``, and its squared distance."""
    entry, far = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    step = max(1, CELLS // book.size)
    for i in range(0, len(part), step):
        d = ((part[i : i + step, None, :] - book) ** 2).sum(-1)
        entry[i : i + step] = d.argmin(1)
        far[i : i + step] = d.min(1)
    return entry, far


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _vectors(rows: np.ndarray) -> pa.Array:
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel().astype(np.int32)))


MEMBER = "position int, entry int, salt int, p array<int>"


def placed(vectors: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """The members (position, entry, salt, p): all parts of (row, v), each with the nearest entry, at its owner."""
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, salt = _matrix(batch.column(1), parts * size), batch.column(0)
            for k in range(parts):
                part = v[:, k * size : (k + 1) * size]
                columns = [np.full(len(v), k, np.int32), nearest(part, books[k])[0].astype(np.int32), salt, _vectors(part)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["position", "entry", "salt", "p"])

    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    return vectors.select(salt.alias("salt"), "v").mapInArrow(run, MEMBER).repartition("position", "entry", "salt")


def moved_entries(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after an update: an entry becomes the mean of its members, rounded down; one without any stays.

    Owners add up what lies with them; a task sends at most one sum for each component of the codebooks.
    """
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, size + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = batch.column(0).to_numpy().astype(np.int64) * entries + batch.column(1).to_numpy()
                order = np.argsort(at, kind="stable")
                rows = np.concatenate([_matrix(batch.column(2), size), np.ones((len(at), 1), np.int64)], 1)[order]
                first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
                total[at[order][first]] += np.add.reduceat(rows, first, axis=0)
        met = np.flatnonzero(total[:, -1])
        cell = (met[:, None] * (size + 1) + np.arange(size + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[met].ravel())], ["cell", "s"])

    rows = members.select("position", "entry", "p").mapInArrow(run, "cell long, s long").groupBy("cell").agg(F.sum("s").alias("s"))
    sums = np.zeros((parts * entries, size + 1), dtype=object)
    for cell, s in rows.collect():  # one row for each component of the codebooks
        sums[divmod(cell, size + 1)] = s
    new = books.copy().reshape(parts * entries, size)
    for k, row in enumerate(sums):
        if row[-1]:
            new[k] = [s // row[-1] for s in row[:-1]]
    return new.reshape(books.shape)


def judged(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members and ``next``, their nearest entry by new codebooks; rows stay where they are."""
    size = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, p = batch.column(0).to_numpy(), _matrix(batch.column(3), size)
            new = np.zeros(len(p), np.int32)
            for k in np.unique(position).tolist():
                on = position == k
                new[on] = nearest(p[on], books[k])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new)], [*batch.schema.names, "next"])

    return members.mapInArrow(run, f"{MEMBER}, next int")


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [parts, entries, length] of (vec_id, row, v) after ``rounds`` of assignment and update; ``row`` spreads members over salts."""
    spark = vectors.sparkSession
    books = start(vectors, parts, entries)
    if not books.size:
        return books
    fitting = vectors.where(F.size("v") == parts * books.shape[2])
    salts = 1 + fitting.count() // OWNER_ROWS
    bounded_batches(spark)
    held = [stage(spark, placed(fitting, books, salts), "code_members")]
    members = held[0]
    for left in range(rounds - 1, -1, -1):
        books = moved_entries(members, books)
        if not left:
            break
        seen = stage(spark, judged(members, books), "code_judged")
        away = seen.where("entry != next").select("position", F.col("next").alias("entry"), "salt", "p")
        come = stage(spark, away.repartition("position", "entry", "salt"), "code_moved")
        discard(*held)
        held = [seen, come]
        members = seen.where("entry = next").select("position", "entry", "salt", "p").union(come)
        if come.isEmpty():
            break
    discard(*held)
    return books


def coded(vectors: DataFrame, books: np.ndarray, *keep: str) -> DataFrame:
    """``keep``, code (array of entries) and error (sum of the parts' squared distances) of each vector that the codebooks fit."""
    parts, _, size = books.shape
    kept = list(dict.fromkeys(keep))
    schema = T.StructType([*(vectors.schema[c] for c in kept), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(len(kept)), parts * size)
            best = [nearest(v[:, k * size : (k + 1) * size], books[k]) for k in range(parts)]
            code = _vectors(np.stack([b[0] for b in best], 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], code, pa.array(sum(b[1] for b in best))], [f.name for f in schema])

    bounded_batches(vectors.sparkSession)
    fitting = vectors.where(F.lit(books.size > 0) & (F.size("v") == parts * size))
    return fitting.select(*kept, F.col("v").alias("__v")).mapInArrow(run, schema)


def group_sums(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over rows with an equal ``key`` (null is a key); rows of a frequent key are dealt over many tasks."""
    spark = rows.sparkSession
    spelled = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = stage(spark, rows.withColumn("__key", spelled), "code_rows")
    sums = stage(spark, rows.groupBy("__key").agg(F.sum(value).alias(name), F.count("*").alias("__n")), "code_sums")
    total = sums.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return spread_join(rows, sums.drop("__n"), "__key", frequent(sums, "__key", "__n", total), [value]).drop("__key")


def spelled(books: np.ndarray) -> str:
    """All components in decimal, by part, entry and place, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def hexadecimal(code: Column) -> Column:
    return F.array_join(F.transform(code, lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    vectors = stage(spark, scaled(table).withColumn("row", F.monotonically_increasing_id()), "code_vectors")
    books = fit(vectors)
    rows = group_sums(coded(vectors, books, "vec_id", "label"), "label", "error", "label_error")
    mark = hashlib.sha256(spelled(books).encode()).hexdigest()
    return rows.select("vec_id", hexadecimal(F.col("code")).alias("code"), "error", "label_error", F.lit(mark).alias("codebooks_sha256"))


def _round(n: int) -> str:
    return f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, pos, min(entry) AS entry, any_value(d) AS d FROM (
    SELECT *, min(d) OVER (PARTITION BY vec_id, pos) AS least FROM (
      SELECT x.vec_id, x.pos, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{n} c ON c.pos = x.pos AND c.i = x.i GROUP BY x.vec_id, x.pos, c.entry))
  WHERE d = least GROUP BY vec_id, pos)"""


def _update(n: int) -> str:
    return f"""
c{n} AS MATERIALIZED (
  SELECT c.pos, c.entry, c.i, coalesce(m.v, c.v) AS v FROM c{n - 1} c LEFT JOIN (
    SELECT a.pos, a.entry, x.i, CAST((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
    FROM a{n - 1} a JOIN x ON x.vec_id = a.vec_id AND x.pos = a.pos GROUP BY a.pos, a.entry, x.i) m ON m.pos = c.pos AND m.entry = c.entry AND m.i = c.i)"""


#: The same rows where vec_id is unique and not null, vectors have one length and components are within +-4096.
OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, (j - 1) // (n // {PARTS}) AS pos, (j - 1) % (n // {PARTS}) AS i, v FROM (SELECT vec_id, len(v) AS n, unnest(v) AS v, generate_subscripts(v, 1) AS j FROM kept)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT pos, entry, i, v FROM x JOIN firsts USING (vec_id)),
{",".join(_round(n) + "," + _update(n + 1) for n in range(ROUNDS))},{_round(ROUNDS)},
marks AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM c{ROUNDS}),
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), marks
"""
