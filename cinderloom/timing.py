"""Timed spans of a run and their summary."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Timer:
    def __init__(self) -> None:
        self.records: list[tuple[str, float]] = []

    @contextmanager
    def span(self, label: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.records.append((label, (time.perf_counter() - start) * 1000))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, "label string, ms double")


    def lines(self) -> list[str]:
        """A table of totals, the longest first."""
        total: dict[str, list[float]] = {}
        for label, ms in self.records:
            total.setdefault(label, []).append(ms)
        rows = sorted(total.items(), key=lambda x: -sum(x[1]))
        return [f"{'step':<28}{'total ms':>14}{'count':>8}{'avg ms':>14}", *(f"{n:<28}{sum(v):>14.1f}{len(v):>8}{sum(v) / len(v):>14.1f}" for n, v in rows)]


def timing_summary(records: DataFrame) -> DataFrame:
    """label, total_ms, count, avg_ms of (label, ms)."""
    return records.groupBy("label").agg(F.sum("ms").alias("total_ms"), F.count("*").alias("count"), F.avg("ms").alias("avg_ms"))
