"""Genotype labels, centre refinement and the cascade of call gates, as column expressions on fitted markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GUARD_BAND, HOM_HIGH, HOM_LOW, P90, STRONG_POSTERIOR, CohortConfig
from ..functions.features import mahalanobis2

CALLS = ["AA", "AB", "BB"]


def genotypes(k: Column, comps: Column, scale: float) -> Column:
    """The genotype of each component: by theta, ascending BB, AB, AA; one component by its place."""
    t = comps[0]["mx"] / scale
    one = F.when(t <= HOM_LOW, "BB").when(t >= HOM_HIGH, "AA").otherwise("AB")
    order = F.transform(F.array_sort(F.transform(comps, lambda c, j: F.struct(c["mx"].alias("t"), j.alias("j")))), lambda s: s["j"])
    names = F.when(k == 2, F.array(F.lit("BB"), F.lit("AA"))).otherwise(F.array(F.lit("BB"), F.lit("AB"), F.lit("AA")))
    ranked = F.transform(comps, lambda c, j: F.element_at(names, F.array_position(order, j).cast("int")))
    return F.when(k == 1, F.array(one)).otherwise(ranked)


def refined(comps: Column, points: Column, tau: Column) -> Column:
    """Centres moved to the posterior-weighted mean of their confident points; the fitted ones if there are none."""

    def centre(c: Column, j: Column) -> Column:
        own = F.filter(points, lambda p: (p["lab"] == j) & (p["post"] >= tau))
        zero = F.struct(*(F.lit(0.0).alias(n) for n in ("w", "x", "y")))
        total = F.aggregate(own, zero, lambda a, p: F.struct((a["w"] + p["post"]).alias("w"), (a["x"] + p["post"] * p["x"]).alias("x"), (a["y"] + p["post"] * p["y"]).alias("y")))
        moved = total["w"] > 1e-6
        return F.struct(F.when(moved, total["x"] / total["w"]).otherwise(c["mx"]).alias("mx"), F.when(moved, total["y"] / total["w"]).otherwise(c["my"]).alias("my"))

    return F.transform(comps, centre)


def guard(k: Column, thetas: Column, call: Column, theta: Column) -> Column:
    """Whether a point lies on its genotype's side of the midpoints between sorted centres, give or take a band."""
    mid = lambda i: (thetas[i] + thetas[i + 1]) / 2
    two = F.when(call == "BB", theta <= mid(0) + GUARD_BAND).otherwise(theta >= mid(0) - GUARD_BAND)
    three = F.when(call == "BB", theta <= mid(0) + GUARD_BAND).when(call == "AA", theta >= mid(1) - GUARD_BAND).otherwise(theta.between(mid(0) - GUARD_BAND, mid(1) + GUARD_BAND))
    return F.when(k == 1, True).when(k == 2, two).otherwise(three)


def refined_markers(fits: DataFrame, cfg: CohortConfig, tau: Column) -> DataFrame:
    """Fitted markers with ``geno`` (by component), ``centres`` and the sorted thetas of the centres."""
    zipped = F.arrays_zip("samples", "raw", "x", "y", "lab", "post")
    rows = fits.withColumn("points", zipped).withColumns({"geno": genotypes(F.col("k"), F.col("comps"), cfg.theta_scale), "centres": refined(F.col("comps"), F.col("points"), tau)})
    return rows.withColumn("thetas", F.array_sort(F.transform("centres", lambda c: c["mx"] / cfg.theta_scale)))


def calls(fits: DataFrame, cfg: CohortConfig, tau: float, r_min: int) -> DataFrame:
    """One row per marker and sample: snp_id, sample_idx, raw, x, y, k, lab, geno, post, maha2, the gates and the call.

    The order of the gates is part of the result: intensity, distance, posterior, theta guard.
    """
    rows = refined_markers(fits, cfg, F.lit(tau)).select("snp_id", "k", "comps", "geno", "centres", "thetas", F.explode("points").alias("p"))
    rows = rows.select("snp_id", F.col("p.samples").alias("sample_idx"), "p.raw", "p.x", "p.y", "k", "p.lab", "p.post", F.expr("geno[p.lab]").alias("geno"), F.expr("centres[p.lab]").alias("c"), F.expr("comps[p.lab]").alias("m"), "thetas")
    far = mahalanobis2(F.col("x"), F.col("y"), F.col("c.mx"), F.col("c.my"), F.col("m.vx"), F.col("m.vy"))
    rows = rows.withColumns({"maha2": far, "pass_raw": F.col("raw") >= r_min})
    rows = rows.withColumns({"maha_gated": (F.col("post") >= tau) & (F.sqrt("maha2") > cfg.max_maha), "guard_ok": guard(F.col("k"), F.col("thetas"), F.col("geno"), F.col("x") / cfg.theta_scale)})
    ok = F.col("pass_raw") & ~F.col("maha_gated") & (F.col("post") >= tau) & ((F.col("post") >= STRONG_POSTERIOR) | F.col("guard_ok"))
    return rows.withColumn("call", F.when(ok, F.col("geno")).otherwise("NoCall")).drop("c", "m", "thetas")


def sample_summary(called: DataFrame, tau: float, r_min: int) -> DataFrame:
    """The quality table, one row per sample."""
    pass_raw = F.col("pass_raw")
    rows = called.groupBy("sample_idx").agg(
        F.count("*").alias("total_snps"),
        F.count_if(pass_raw).alias("pass_raw"),
        F.count_if(~pass_raw).alias("nocall_raw"),
        F.count_if(pass_raw & (F.col("call") == "NoCall")).alias("nocall_p_at_tau"),
        F.count_if(pass_raw & F.col("maha_gated")).alias("nocall_maha_at_tau"),
        F.count_if(F.col("call") != "NoCall").alias("calls_at_tau"),
        F.count_if(pass_raw & (F.col("post") >= P90)).alias("calls_p090"),
    )
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total_snps")), F.lit(float("nan")))
    return rows.withColumns({"call_rate_tau": rate("calls_at_tau"), "call_rate_p090": rate("calls_p090"), "r_min_used": F.lit(r_min), "tau_used": F.lit(float(tau))})


def totals() -> list[Column]:
    """Counters of all calls, for an ``Observation`` of the pass that writes them."""
    pass_raw, none = F.col("pass_raw"), F.col("call") == "NoCall"
    counts = {
        "total": F.count(F.lit(1)),
        "pass_raw": F.count_if(pass_raw),
        "nocall_raw": F.count_if(~pass_raw),
        "nocall_p": F.count_if(pass_raw & none),
        "nocall_maha": F.count_if(pass_raw & F.col("maha_gated")),
        "calls_tau": F.count_if(~none),
        "calls_p090": F.count_if(pass_raw & (F.col("post") >= P90)),
    }
    return [c.alias(name) for name, c in counts.items()]


def check_totals(t: dict[str, int]) -> None:
    """What the cascade of gates makes true of its counters."""
    sound = t["total"] == t["nocall_raw"] + t["pass_raw"] and t["pass_raw"] == t["nocall_p"] + t["calls_tau"] and t["nocall_maha"] <= t["nocall_p"]
    if not sound:
        raise ValueError(f"counters of the calls don't add up: {t}")


def marker_summary(called: DataFrame) -> DataFrame:
    """(snp_id, seen, nocall_raw, nocall_p, nocall): what a run adds to the feedback of each marker."""
    none = F.col("call") == "NoCall"
    return called.groupBy("snp_id").agg(F.count("*").alias("seen"), F.count_if(~F.col("pass_raw")).alias("nocall_raw"), F.count_if(F.col("pass_raw") & none).alias("nocall_p"), F.count_if(none).alias("nocall"))
