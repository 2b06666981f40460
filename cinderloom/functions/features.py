"""Scalar functions on intensities and mixture components, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CohortConfig


def theta(red: Column, grn: Column) -> Column:
    """2 atan2(G, R) / pi: 0 is all red, 1 all green; 0 where both are 0."""
    return F.atan2(grn.cast("double"), red.cast("double")) * 2 / math.pi


def raw_sum(red: Column, grn: Column) -> Column:
    return red.cast("long") + grn.cast("long")


def log_intensity(red: Column, grn: Column) -> Column:
    """ln(R + G + 1)."""
    return F.log(raw_sum(red, grn) + 1)


def log1p_intensity(value: Column) -> Column:
    return F.log1p(value.cast("double"))


def theta_r(red: Column, grn: Column, cfg: CohortConfig) -> tuple[Column, Column]:
    """The weighted feature point."""
    return theta(red, grn) * cfg.w_theta, log_intensity(red, grn) * cfg.w_r


def sample_name(path: Column, strict_names: bool = True) -> Column:
    """The file's stem without its channel; ``strict_names`` keeps the quirk that one extension goes and then ``_Grn`` if it is at the end."""
    name = F.element_at(F.split(path, "/"), -1)
    if strict_names:
        return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "_Grn$", "")
    return F.regexp_replace(name, r"_(Grn|Green|Red)\.idat(\.gz)?$", "")


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array, shifted by its maximum; a maximum that is not finite is the result."""
    top = F.array_max(values)
    return F.when(F.isnan(top) | (F.abs(top) == math.inf), top).otherwise(top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def mahalanobis2(x: Column, y: Column, mx: Column, my: Column, vx: Column, vy: Column) -> Column:
    floor = F.lit(1e-8)
    return (x - mx) ** 2 / F.greatest(vx, floor) + (y - my) ** 2 / F.greatest(vy, floor)


def log_density(x: Column, y: Column, mx: Column, my: Column, vx: Column, vy: Column) -> Column:
    """Diagonal normal density with the normaliser -ln(pi): the same constant for all models, so it cancels."""
    vx, vy = F.greatest(vx, F.lit(1e-8)), F.greatest(vy, F.lit(1e-8))
    return -0.5 * ((x - mx) ** 2 / vx + (y - my) ** 2 / vy) - 0.5 * F.log(vx * vy) - math.log(math.pi)


def bic(loglik: Column, k: Column, n: Column) -> Column:
    return -2 * loglik + (5 * k - 1) * F.log(n.cast("double"))


def snp_name(snp_id: Column) -> Column:
    """Eight digits, or as many as the number has."""
    return F.format_string("snp_%08d", snp_id)
