"""Marker sets: intersection over samples, exclusion, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CohortConfig


#: Samples of one bitmap: a long.  (``bitmap_construct_agg`` has bitmaps of 4 KiB, one for each marker and task.)
WORD = 64


def _bitmaps(probes: DataFrame, *by: str) -> DataFrame:
    """``by``, samples and cells: how many samples the cells of a group come from, and how many cells those are.

    Samples are bits of a few words of 64, which each task combines by OR before the shuffle: no distinct cells are gathered.
    """
    word, bit = F.floor(F.col("sample_idx") / WORD).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(sample_idx, {WORD}) as int))")
    words = probes.groupBy(*by, word).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("cells"))
    return words.groupBy(*by).agg(F.sum(F.bit_count("bits")).alias("samples"), F.sum("cells").alias("cells"))


def common_snps(probes: DataFrame, once: bool = False, samples: int | None = None) -> DataFrame:
    """Markers that every sample has; with ``once``, a marker that a sample has twice is an error.

    ``samples`` is their number where it is known; else ``probes`` is read once more for it.
    """
    seen, every = _bitmaps(probes, "snp_id"), F.lit(samples)
    if samples is None:
        seen = seen.join(F.broadcast(_bitmaps(probes).select(F.col("samples").alias("all_samples"))))  # one row is broadcast
        every = F.col("all_samples")
    common = F.col("samples") == every
    if once:
        common = F.when(F.col("cells") == F.col("samples"), common).otherwise(F.raise_error(F.lit("a sample has a marker twice")).cast("boolean"))
    return seen.where(common).select("snp_id")


def drop_bad(snps: DataFrame, bad: DataFrame) -> DataFrame:
    return snps.join(bad, "snp_id", "left_anti")


def first_snps(snps: DataFrame, n: int) -> DataFrame:
    return snps.orderBy("snp_id").limit(n)


def draw(snp_id: Column, seed: int) -> Column:
    """A seeded number that orders markers at random, the same in any engine."""
    return (snp_id * F.lit(1103515245) + F.lit(seed * 1013904223)) % F.lit(2147483648)


def sampled_snps(snps: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` markers (all if there are fewer), whatever the partitioning."""
    return snps.orderBy(draw(F.col("snp_id"), seed), "snp_id").limit(n)


def selected(probes: DataFrame, cfg: CohortConfig, bad: DataFrame | None = None, samples: int | None = None) -> DataFrame:
    """The markers of a run."""
    snps = common_snps(probes, once=True, samples=samples)
    if cfg.drop_bad_snps and bad is not None:
        snps = drop_bad(snps, bad)
    if cfg.sample_snps:
        return sampled_snps(snps, cfg.sample_snps, cfg.seed)
    return first_snps(snps, cfg.max_snps) if cfg.max_snps else snps
