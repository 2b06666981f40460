"""State that runs hand on: feedback counters and the list of bad markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK = "snp_id long, seen long, nocall_raw long, nocall_p long, bad boolean"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """A missing file is empty; fields that can't be read are 0 or false; ids that are no 32-bit numbers and
    marker 0 are left out; of equal ids the last counts."""
    if not exists(spark, path):
        return spark.createDataFrame([], FEEDBACK)
    text = ", ".join(f"{c.split()[0]} string" for c in FEEDBACK.split(", "))
    rows = spark.read.schema(text).csv(path, header=True, mode="DROPMALFORMED").withColumn("line", F.monotonically_increasing_id())
    number = lambda c: F.coalesce(F.try_to_number(F.trim(c), F.lit("9" * 18)).cast("long"), F.lit(0))
    rows = rows.select(*(number(F.col(c)).alias(c) for c in ("snp_id", "seen", "nocall_raw", "nocall_p")), (F.trim("bad") == "true").alias("bad"), "line")
    last = rows.where("snp_id between 1 and 4294967295").groupBy("snp_id").agg(F.max_by(F.struct("seen", "nocall_raw", "nocall_p", "bad"), "line").alias("s"))
    return last.select("snp_id", "s.seen", "s.nocall_raw", "s.nocall_p", F.coalesce("s.bad", F.lit(False)).alias("bad"))


def read_bad(spark: SparkSession, path: str) -> DataFrame:
    """(snp_id): one number a line; blank lines, # lines and lines that are no 32-bit number are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], "snp_id long")
    line = F.trim("value")
    number = F.when(line.rlike("^[0-9]{1,10}$"), line.cast("long"))
    return spark.read.text(path).select(number.alias("snp_id")).where("snp_id <= 4294967295").distinct()


def write_feedback(feedback: DataFrame, path: str) -> None:
    """One CSV part, ascending by number: a row per marker ever seen."""
    feedback.select(*(c.split()[0] for c in FEEDBACK.split(", "))).coalesce(1).sortWithinPartitions("snp_id").write.mode("overwrite").csv(path, header=True)


def write_bad(bad: DataFrame, path: str) -> None:
    """One text part, sorted as strings."""
    bad.select(F.col("snp_id").cast("string").alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)
