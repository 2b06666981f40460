"""Operator 8: mixing sources to target weights by capped water-filling.

Targets share the wanted size by weight; a source whose target is above its most allowed epochs is clamped there,
and the excess goes to the others by weight, again and again until none is above.  Each source is then taken
in whole repetitions, and the rest as a seeded sample: documents stand in the order of a seeded digest of their
id, and the sample is the head of that order; the document at its end gives the words that are still missing.
The order is cut into buckets of digest prefixes; the bucket in which a source's sample ends is cut by longer prefixes
until it is small, so that only few rows of a source are ever sorted.

Defined results: null text has size 0.  Null is a source of its own, the last one.  Documents with equal ids
stand in the order of their texts' digests, those without ids in a seeded order of these; rows with one id and one
text in the order of their other kept columns' digests, so only rows that are equal in all are as good as each other.  Sources without words have target 0.  A long text counts whole.  Columns named like the
result's own are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, body, documents, stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hexadecimal digits by which a bucket's prefix is longer than the last one: 256 buckets of each; rows of a bucket that
#: is sorted; digits of a document's place in the order (its mark, its text's digest, its kept columns' and its row's digest).
BUCKET_DIGITS, BUCKET_ROWS, DIGITS = 2, 10_000, 128
#: Sources up to which their rows are broadcast (some 100 bytes each); above, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Names that the result has of its own; columns of the input with such names are left out.
OWN = {"size", "mark", "source_size", "weight", "target", "taken", "epochs", "missing", "end_bucket", "before", "head", "left", "bucket", "words", "n"}


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, source and size (words) of each document, and its seeded digest."""
    size = F.regexp_count(body(), F.lit(WORD)).cast("long")
    text = F.md5(body().cast("binary"))
    mark = F.concat(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), text)).cast("binary")), text)
    names = dict.fromkeys([*(c for c in keep if c not in OWN), "source"])
    # Rows with one id and one text stand in the order of what else is kept of them, so reruns take the same.
    others = [F.col(c) for c in names if c not in ("doc_id", "text")]
    mark = F.concat(mark, F.md5(F.to_json(F.struct(*others)).cast("binary")))
    return docs.select(*names, size.alias("size"), mark.alias("mark"))


def targets(sized: DataFrame, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight, target): one row for each source.

    Sources are ranked within ranges of their names, and one task adds up the sizes of the ranges only.  Clamping runs in
    rounds of one sum each, at most one round for each source.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = stage(spark, sums.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()), "mix_ranges")
    earlier = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = sums.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    rank = F.col("earlier") + F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    sources = sums.join(F.broadcast(ranges), "range")  # as many rows as a shuffle has partitions
    sources = stage(spark, sources.select("source", "source_size", weight.cast("double").alias("weight")), "mix_sources")
    wanted = share * float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    full: Column = F.lit(False)
    target = F.lit(0.0)
    while True:
        spent, rest = sources.agg(
            F.coalesce(F.sum(F.when(full, MAX_EPOCHS * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        target = F.when(full, (MAX_EPOCHS * F.col("source_size")).cast("double")).otherwise(F.lit(wanted - float(spent)) * F.col("weight") / F.lit(float(rest) or 1.0))
        over = ~full & (target > MAX_EPOCHS * F.col("source_size"))
        if not sources.where(over).count():
            return sources.withColumn("target", target)
        level = (wanted - float(spent)) / float(rest)
        # A clamped source stays clamped: the level only rises.
        full = F.lit(level) * F.col("weight") > MAX_EPOCHS * F.col("source_size")


def mix(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, source, size, source_size, target and taken of each document."""
    spark, keep = docs.sparkSession, [c for c in dict.fromkeys(keep) if c not in OWN]
    sized = stage(spark, sizes(docs, *keep), "mix_sizes")
    row = F.md5(F.concat_ws(":", "_metadata.file_name", F.col("_metadata.row_index").cast("string")).cast("binary"))
    sized = sized.withColumn("mark", F.concat("mark", row))
    sources = targets(sized)
    whole = F.floor(F.col("target") / F.col("source_size"))
    goal = sources.withColumns(
        {
            "epochs": F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0)).cast("long"),
            "missing": F.when(F.col("source_size") > 0, F.round("target").cast("long") - whole.cast("long") * F.col("source_size")).otherwise(F.lit(0)),
        }
    )
    goal = stage(spark, goal, "mix_goals")
    few = goal.count() <= BROADCAST_SOURCES

    def sent(rows: DataFrame) -> DataFrame:
        """``rows``, of which each source has one."""
        return F.broadcast(rows) if few else rows

    # The bucket in which a source's sample ends.
    ends, digits = goal.where("missing > 0").select("source", "missing", F.lit("").alias("end_bucket"), F.lit(0).cast("long").alias("before")), 0
    while digits < DIGITS:
        digits += BUCKET_DIGITS
        last = sent(ends)
        inside = sized.join(last, sized["source"].eqNullSafe(last["source"])).drop(last["source"]).where(F.startswith("mark", "end_bucket"))
        buckets = inside.groupBy("source", "missing", "before", F.substring("mark", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        found = stage(spark, buckets.where("before <= missing and missing < before + words"), "mix_ends")
        ends = found.select("source", "missing", F.col("bucket").alias("end_bucket"), "before")
        if found.where(F.col("n") > BUCKET_ROWS).isEmpty():
            break
    sources = goal.join(ends, goal["source"].eqNullSafe(ends["source"]), "left").select(goal["source"], "source_size", "target", "epochs", goal["missing"], "end_bucket", "before")
    small = sent(stage(spark, sources, "mix_sources"))
    bucket = F.substring("mark", 1, digits)
    rows = sized.join(small, sized["source"].eqNullSafe(small["source"])).drop(small["source"])
    rows = rows.withColumn("head", F.when(F.col("end_bucket").isNull(), F.col("missing") > 0).otherwise(bucket < F.col("end_bucket")))
    names = [*keep, *(["source"] if "source" not in keep else []), "size", "source_size", "target"]
    at_end = F.col("end_bucket").isNotNull() & (bucket == F.col("end_bucket"))
    straight = rows.where(~at_end).select(*names, (F.col("epochs") * F.col("size") + F.when(F.col("head"), F.col("size")).otherwise(F.lit(0))).alias("taken"))
    inside = Window.partitionBy("source").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("missing") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = rows.where(at_end).withColumn("left", left)
    last = last.select(*names, (F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.col("left"), F.lit(0)))).alias("taken"))
    return straight.union(last)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(documents(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken")


OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) || md5(coalesce(text, '')) AS mark
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source),
t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS wanted FROM s),
r AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS level, false AS done
  UNION ALL
  SELECT step + 1, new, new = level FROM (
    SELECT step, level, done,
      (SELECT (max(wanted) - coalesce(sum(CASE WHEN level * weight > 3 * source_size THEN 3 * source_size END), 0))
              / coalesce(sum(CASE WHEN NOT level * weight > 3 * source_size THEN weight END), 1) FROM s, t) AS new
    FROM r) WHERE NOT done AND step < 1000),
l AS (SELECT level FROM r ORDER BY step DESC LIMIT 1),
k AS (
  SELECT wanted - coalesce((SELECT sum(3 * source_size) FROM s, l WHERE level * weight > 3 * source_size), 0) AS left_over,
         (SELECT sum(weight) FROM s, l WHERE NOT level * weight > 3 * source_size) AS left_weight FROM t),
g AS (
  SELECT source, source_size,
         CASE WHEN level * weight > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE left_over * weight / left_weight END AS target
  FROM s, l, k),
q AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN CAST(floor(target / g.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
  CAST(epochs * size + CASE WHEN source_size > 0 THEN least(size, greatest(CAST(round(target) AS BIGINT) - epochs * source_size - before, 0)) ELSE 0 END AS BIGINT) AS taken
FROM q
"""
