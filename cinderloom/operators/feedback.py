"""Learning across runs: counters of each marker, and markers that are dropped from now on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bad_of_run(summary: DataFrame, threshold: float) -> DataFrame:
    """(snp_id) of markers whose share of missing calls reaches the threshold; none if that is 0 or less."""
    return summary.where(F.lit(threshold > 0) & (F.col("nocall") / F.col("seen") >= threshold)).select("snp_id")


def updated_feedback(old: DataFrame, summary: DataFrame, threshold: float) -> DataFrame:
    """Old counters plus those of this run; a marker once bad stays bad."""
    new = summary.select("snp_id", *(F.col(c).alias(f"add_{c}") for c in ("seen", "nocall_raw", "nocall_p")), (F.lit(threshold > 0) & (F.col("nocall") / F.col("seen") >= threshold)).alias("add_bad"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    both = old.join(new, "snp_id", "full_outer")
    return both.select("snp_id", *((zero(F.col(c)) + zero(F.col(f"add_{c}"))).alias(c) for c in ("seen", "nocall_raw", "nocall_p")), (no(F.col("bad")) | no(F.col("add_bad"))).alias("bad"))


def updated_bad(old: DataFrame, run: DataFrame) -> DataFrame:
    return old.select("snp_id").union(run.select("snp_id")).distinct()
