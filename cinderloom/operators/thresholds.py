"""Thresholds learned from the data: intensity floor and posterior cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RMIN_HIGH, RMIN_LOW, TAU_HIGH, TAU_LOW, TAU_MARKERS, TAU_NONE


def _two_normals(t: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Two-component EM on values t (ascending) that occur n times: w0, m0, s0, w1, m1, s1 by ascending mean."""
    size, place = n.sum(), np.cumsum(n)
    at = lambda p: t[np.searchsorted(place, int(size * p), "right")]
    mean = (n * t).sum() / size
    sd = max(float(np.sqrt((n * (t - mean) ** 2).sum() / size)), 1e-3)
    w, m, s = np.array([0.5, 0.5]), np.array([at(0.25), at(0.75)]), np.array([sd, sd])
    last = -np.inf
    for _ in range(50):
        d = np.exp(-((t[:, None] - m) ** 2) / (2 * s**2) - np.log(s)) * w
        total = np.maximum(d.sum(1), 1e-300)
        r0 = d[:, 0] / total
        r = np.stack([r0, 1 - r0], 1) * n[:, None]
        loglik = float((n * np.log(total)).sum())
        mass = r.sum(0)
        w0 = float(np.clip(mass[0] / size, 1e-6, 1 - 1e-6))
        mass = np.maximum(mass, 1e-8)
        w = np.array([w0, 1 - w0])
        m = (r * t[:, None]).sum(0) / mass
        s = np.sqrt(np.maximum((r * (t[:, None] - m) ** 2).sum(0) / mass, 1e-6))
        if abs(loglik - last) < 1e-6:
            break
        last = loglik
    a, b = (0, 1) if m[0] <= m[1] else (1, 0)
    return w[a], m[a], s[a], w[b], m[b], s[b]


def crossing(w0: float, m0: float, s0: float, w1: float, m1: float, s1: float, formula: str = "reference") -> float:
    """Where the two densities cross between their means, or the midpoint."""
    twice, sign = (2, 1) if formula == "reference" else (1, -1)
    a = 0.5 * (1 / s1**2 - 1 / s0**2)
    b = twice * (m0 / s0**2 - m1 / s1**2)
    c = 0.5 * (m1**2 / s1**2 - m0**2 / s0**2) + sign * float(np.log(w1 * s0 / (w0 * s1)))
    if abs(a) < 1e-12:
        return -c / b if abs(b) >= 1e-12 else (m0 + m1) / 2
    if (d := b * b - 4 * a * c) < 0:
        return (m0 + m1) / 2
    one, two = (-b - np.sqrt(d)) / (2 * a), (-b + np.sqrt(d)) / (2 * a)
    return one if min(m0, m1) <= one <= max(m0, m1) else two


def floor_of(t: float) -> int:
    value = float(np.exp(min(t, 700.0)) - 1)
    value = 0.0 if np.isnan(value) else max(value, 0.0)
    return int(min(max(np.floor(value + 0.5), RMIN_LOW), RMIN_HIGH))


def sample_floors(probes: DataFrame, formula: str = "reference") -> DataFrame:
    """(sample_idx, r_min) from all probes of each sample.

    Intensity sums are 17-bit numbers, so a sample is at most 131,071 (value, count) rows when it reaches its task.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("raw")
        t = np.log(rows["raw"].to_numpy(np.float64) + 1)
        r_min = floor_of(crossing(*_two_normals(t, rows["n"].to_numpy(np.float64)), formula))
        return pd.DataFrame({"sample_idx": [rows["sample_idx"].iloc[0]], "r_min": [r_min]})

    counts = probes.groupBy("sample_idx", (F.col("red").cast("long") + F.col("grn").cast("long")).alias("raw")).agg(F.count("*").alias("n"))
    return counts.groupBy("sample_idx").applyInPandas(fit, "sample_idx int, r_min int")


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """The element at n div 2 of the sorted values (one per sample)."""
    ordered = values.agg(F.array_sort(F.collect_list(column)).alias("v"))
    return ordered.select(F.expr("try_element_at(v, cast(size(v) div 2 + 1 as int))").alias(column))


def cohort_floor(probes: DataFrame, formula: str = "reference") -> DataFrame:
    return upper_median(sample_floors(probes, formula), "r_min")


#: Errors that one task puts in order at most, and parts of a binade (first) and of a range of errors (after it).
CUT_ROWS, BINADE_PARTS, RANGE_PARTS = 100_000, 64, 4096


def cut_range(errors: DataFrame, alpha: float, rows: int = CUT_ROWS) -> tuple[DataFrame, int, float] | None:
    """The errors (e in [0, 1]) among which the last one lies up to which the mean is within ``alpha``, and number and sum of those below.

    Errors are summed by parts of their range, and the last part whose first error is good is cut again, until it has ``rows``
    errors at most or a single value.  The first cut is by binades, since most errors are tiny.  None if no error is good.
    """
    inside, n0, s0 = errors, 0, 0.0
    part = F.when(F.col("e") > 0, F.floor(F.log2("e") * BINADE_PARTS)).otherwise(-(1 << 30))
    while True:
        sums = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.min("e").alias("low"), F.max("e").alias("high"))
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
        sums = sums.withColumns({"n0": F.coalesce(F.sum("n").over(earlier), F.lit(0)) + n0, "s0": F.coalesce(F.sum("s").over(earlier), F.lit(0.0)) + s0})
        last = sums.where((F.col("s0") + F.col("low")) / (F.col("n0") + 1) <= alpha).orderBy(F.desc("part")).first()
        if last is None:
            return None
        n0, s0, low, high = last.n0, last.s0, last.low, last.high
        inside = errors.where(F.col("e").between(low, high))
        if last.n <= rows or low == high:
            return inside, n0, s0
        part = F.least(F.floor((F.col("e") - low) / (high - low) * RANGE_PARTS), F.lit(RANGE_PARTS - 1))


def auto_tau(confident: DataFrame, alpha: float, rows: int = CUT_ROWS) -> DataFrame:
    """One row ``tau``: the cut at which the mean error (1 - post) of what is called stays within ``alpha``.

    Errors ascend, so their running mean does too, and one part of their range holds the last good one (``cut_range``): only
    that part is put in order, ``rows`` distinct errors at most.
    """
    spark = confident.sparkSession
    errors = confident.select(F.greatest(F.least(1 - F.col("post"), F.lit(1.0)), F.lit(0.0)).alias("e"))
    if (found := cut_range(errors, alpha, rows)) is None:
        return spark.createDataFrame([(TAU_NONE,)], "tau double")
    inside, n0, s0 = found
    before = Window.orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    distinct = inside.groupBy("e").agg(F.count("*").alias("n"))
    n = F.coalesce(F.sum("n").over(before), F.lit(0)) + n0
    s = F.coalesce(F.sum(F.col("e") * F.col("n")).over(before), F.lit(0.0)) + s0
    good = distinct.select("e", ((s + F.col("e")) / (n + 1)).alias("mean")).where(F.col("mean") <= alpha)
    return good.agg(F.least(F.greatest(1 - F.max("e"), F.lit(TAU_LOW)), F.lit(TAU_HIGH)).alias("tau"))


def tau_input(fits: DataFrame, r_min: int, markers: int = TAU_MARKERS) -> DataFrame:
    """Posteriors that the cut is learned from: the first markers by id, points of enough intensity."""
    last = fits.select("snp_id").orderBy("snp_id").limit(markers).agg(F.max("snp_id").alias("last"))  # only ids are put in order
    first = fits.join(F.broadcast(last), F.col("snp_id") <= F.col("last"))  # one row is broadcast
    return first.select(F.explode(F.arrays_zip("raw", "post")).alias("p")).select("p.raw", "p.post").where(F.col("raw") >= r_min)
