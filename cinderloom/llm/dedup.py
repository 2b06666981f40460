"""Operator 10: exact deduplication as a stateful stream.

Documents arrive as a stream of files.  The stream's keyed state (on disk, in RocksDB, with no expiry) retains for
each digest the stable identifier and the content locator of the document that stays, and how many were seen.
Hits are then checked against the bytes at that locator; where bytes differ, the digest's documents are
grouped by their whole text.

Defined results: null counts as the empty text, and all empty texts are equal.  Of equal texts, the row with
the most code points in its original text stays, then the smallest doc_id (null last), then the first row in
file order, so of repeated rows exactly one stays.  An empty table gives an empty result.  A long text is digested and
compared whole.  Columns of the input other than doc_id and text are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, body, discard, shared_dir, stage, unused

#: State on disk, its memory bounded for each executor; files are not allocated ahead, as there may be many small stores.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(body(text), SPACE + "+", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


@contextmanager
def _settings(spark: SparkSession, **new: str):
    """Session settings for the time that a stream runs."""
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _locator() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _arrivals(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """A row for each document with its digest, normalised text, locator and rank among equals (the least stays)."""
    text = body("text")
    found = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        normalised(F.col("text")).alias("norm"),
        F.length(text).cast("long").alias("points"),
        _locator().alias("at"),
    )
    return found.withColumns({"digest": digest(F.col("norm")), "rank": F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")})


def _pattern(path: str) -> str:
    """A pattern that only ``path`` matches: as a pattern, it may be one file.  Spark's file streams can't take other signs of patterns."""
    path = path.rstrip("/")
    if signs := set(path) & set("*?[]{}\\"):
        raise ValueError(f"a path with {' '.join(sorted(signs))} would be taken for a pattern: {path}")
    return f"{path[:-1]}[{path[-1]}]"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stream_state(spark: SparkSession, path: str, schema, digest: Callable[[Column], Column] = sha256, state_dir: str | None = None) -> DataFrame:
    """Run the stream over the files at ``path`` up to now: digest, keep_id, keep_at, group_size.

    Its checkpoint lies in the shared folder, so a lost executor's state is read again from there.  With a
    ``state_dir`` the state stays there, and the next run with it takes only the files that arrived since.
    """
    pattern, base = _pattern(path), state_dir or shared_dir(spark, "dedup_state")
    out, checkpoint = f"{base}/changes", f"{base}/checkpoint"
    arriving = _arrivals(spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(pattern), digest)
    state = arriving.groupBy("digest").agg(F.min("rank").alias("best"), F.count("*").alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _settings(spark, **STATE_STORE):
        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    kind = "digest string, best struct<fewer: long, unnamed: boolean, doc_id: long, at: struct<file: string, row: long>>, n long, batch long"
    # A query that has seen no file has written none.
    changes = spark.read.schema(kind).parquet(out) if _exists(spark, out) else spark.createDataFrame([], kind)
    last = changes.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("s"))
    last = stage(spark, last.select("digest", F.col("s.best.doc_id").alias("keep_id"), F.col("s.best.at").alias("keep_at"), F.col("s.n").alias("group_size")), "dedup_last")
    if state_dir is None:
        _remove(spark, base)
    return last


def dedup_files(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest and locator of every row of the Parquet files at ``path`` (doc_id, text)."""
    source = spark.read.parquet(path)
    state = stream_state(spark, path, source.schema, digest)
    seen = _arrivals(source, digest).join(state, "digest")
    kept = F.col("at") == F.col("keep_at")
    # Only hits carry their bytes on.
    seen = stage(spark, seen.select("doc_id", "points", "digest", "keep_id", "group_size", "at", kept.alias("kept"), F.when(F.col("group_size") > 1, F.col("norm")).alias("norm")), "dedup_seen")
    discard(state)
    hits = seen.where("group_size > 1")
    stays = hits.where("kept").select("digest", F.col("norm").alias("keep_norm"))
    wrong = hits.where("not kept").join(stays, "digest").where("norm != keep_norm").select("digest")
    wrong = stage(spark, wrong, "dedup_wrong")
    result = ["doc_id", "keep_id", "group_size", "kept", "digest", "at"]
    if wrong.isEmpty():
        return seen.select(*result)
    order = [F.desc("points"), F.asc_nulls_last("doc_id"), F.asc("at")]
    again = seen.join(wrong, "digest", "left_semi")
    whole = Window.partitionBy("digest", "norm")
    again = again.withColumns({"keep_id": F.first("doc_id").over(whole.orderBy(*order)), "kept": F.row_number().over(whole.orderBy(*order)) == 1, "group_size": F.count("*").over(whole)})
    return seen.join(wrong, "digest", "left_anti").select(*result).union(again.select(*result))


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay; they are landed in the shared folder first."""
    path = shared_dir(spark, "dedup_landing")
    docs.write.parquet(path)
    stay = dedup_files(spark, path).where("kept").select("at")
    at = unused(docs.columns) + "at"
    landed = spark.read.parquet(path).withColumn(at, _locator())
    return landed.join(stay.withColumnRenamed("at", at), at, "left_semi").select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_files(spark, f"{sf_dir}/documents.parquet")
    return rows.drop("at").withColumnRenamed("digest", "text_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept,
  sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
