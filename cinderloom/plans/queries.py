"""The registered queries over a cohort that Spark derives from the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CohortConfig
from ..functions import features
from ..operators import feedback, gates, mixture, outputs, snps, thresholds
from ..sources import idat, matrix, state
from ..sources import idat_source as idat_source_module
from ..streaming import feedback as stream_feedback
from ..timing import timing_summary
from .cohort import shared, stage

CFG = CohortConfig()
SAMPLES = 24
#: Markers of the limit and sampling operators, and rounds of the fixed-length fits.
LIMIT, ROUNDS = 100, 10
#: Share of missing calls from which the stream's markers are bad.
STREAM_BAD = 0.75
#: Markers of one range of ids in a channel file that a query writes.
FILE_MARKERS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe cells (snp_id, sample_idx, red, grn) made of all of ``lineitem``: three clusters, weak cells, gaps."""
    m = table(spark, sf_dir, "part").count() // 8
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % m + 1).alias("snp_id"), (F.col("l_orderkey") % SAMPLES).alias("sample_idx"))
    rows = rows.agg(F.max("l_quantity").cast("long").alias("q1"), F.min("l_quantity").cast("long").alias("q0"), F.count("*").alias("n"))
    rows = rows.where(~((F.col("sample_idx") == 5) & (F.col("snp_id") % 11 == 0)))
    g, weak = (F.col("snp_id") * 7 + F.col("sample_idx") * 5 + F.col("n")) % 3, (F.col("snp_id") + F.col("sample_idx") * 3) % 37 == 0
    q0, q1 = F.col("q0"), F.col("q1")
    red = F.when(weak, 100 + q0).otherwise(F.when(g == 0, 9000).when(g == 1, 5000).otherwise(700) + q1 * 20 - q0 * 10)
    grn = F.when(weak, 90 + q1).otherwise(F.when(g == 0, 700 + q0 * 20 - q1 * 5).when(g == 1, 5000 + q0 * 20 - q1 * 5).otherwise(9000 + q0 * 20 - q1 * 5))
    return rows.select("snp_id", F.col("sample_idx").cast("int").alias("sample_idx"), red.cast("int").alias("red"), grn.cast("int").alias("grn"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = probes(spark, sf_dir)
    return mixture.markers(cells, snps.common_snps(cells), CFG)


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.fits(points(spark, sf_dir), CFG)


def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.calls(fits(spark, sf_dir), CFG, CFG.p_min, CFG.r_min)


def _r(name: str, digits: int = 4, alias: str | None = None):
    return F.round(name, digits).alias(alias or name)


def probe_cells(spark, sf_dir):
    return probes(spark, sf_dir)


def common_snps(spark, sf_dir):
    return snps.common_snps(probes(spark, sf_dir))


def theta_r(spark, sf_dir):
    x, y = features.theta_r(F.col("red"), F.col("grn"), CFG)
    return probes(spark, sf_dir).select("snp_id", "sample_idx", F.round(x, 6).alias("theta"), F.round(y, 6).alias("r"))


def raw_gate(spark, sf_dir):
    raw = features.raw_sum(F.col("red"), F.col("grn"))
    return probes(spark, sf_dir).select("snp_id", "sample_idx", raw.alias("raw"), (raw >= CFG.r_min).alias("pass_raw"))


def log_intensity_stats(spark, sf_dir):
    z = features.log_intensity(F.col("red"), F.col("grn"))
    return probes(spark, sf_dir).groupBy("sample_idx").agg(F.count("*").alias("n"), F.round(F.avg(z), 6).alias("mean_z"), F.round(F.var_pop(z), 6).alias("var_z"))


def first_snps(spark, sf_dir):
    return snps.first_snps(common_snps(spark, sf_dir), LIMIT)


def sampled_snps(spark, sf_dir):
    return snps.sampled_snps(common_snps(spark, sf_dir), LIMIT, CFG.seed)


def bad_snp_antijoin(spark, sf_dir):
    """Markers without those that the parts' sizes mark as bad."""
    bad = table(spark, sf_dir, "part").where("p_size % 7 = 0").select(F.col("p_partkey").alias("snp_id"))
    return snps.drop_bad(common_snps(spark, sf_dir), bad)


def channel_pairs(spark, sf_dir):
    """Pairs among file names that all customers give: plain and gzipped, two spellings, some without a partner."""
    c = F.col("c_custkey")
    base = F.concat(F.lit("/data/"), F.col("c_nationkey").cast("string"), F.lit("/C"), c.cast("string"))
    green = F.when(c % 4 == 0, "_Grn.idat").when(c % 4 == 1, "_Green.idat.gz").when(c % 4 == 2, "_Grn.idat.gz").otherwise(".txt")
    red = F.when(c % 3 == 0, "_Red.idat").when(c % 3 == 1, "_Red.idat.gz").otherwise("_red.idat")
    names = table(spark, sf_dir, "customer").select(F.explode(F.array(F.concat(base, green), F.concat(base, red))).alias("path"))
    pairs = idat.pair_channels(idat.channel_files(names))
    return pairs.select("base", features.sample_name(F.col("green_path")).alias("sample"), "green_path", "red_path")


def idat_decode(spark, sf_dir):
    """Each sample's cells as a pair of channel files' bytes, read again by the decoder."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("snp_id")
        return pd.DataFrame({"sample_idx": [rows["sample_idx"].iloc[0]], "green": [idat.encode(rows["snp_id"], rows["grn"])], "red": [idat.encode(rows["snp_id"], rows["red"])]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sample, green, red in batch.itertuples(index=False):
                ids, grn = idat.decode(green)
                yield pd.DataFrame({"sample_idx": sample, "snp_id": ids, "red": idat.decode(red)[1], "grn": grn})

    # A file holds a sample's markers of one range of ids, so that no task gets a whole sample, however many markers there are.
    files = probes(spark, sf_dir).groupBy("sample_idx", F.floor(F.col("snp_id") / FILE_MARKERS)).applyInPandas(write, "sample_idx int, green binary, red binary")
    return files.mapInPandas(read, "sample_idx int, snp_id long, red int, grn int")


def channel_zip(spark, sf_dir):
    """Channel files of all samples, of which some have fewer values in red or green: channels meet as far as the shorter goes."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows, sample = rows.sort_values("snp_id"), rows["sample_idx"].iloc[0]
        piece = rows["piece"].iloc[0]
        short = {"green": len(rows) - sample % 2, "red": len(rows) - sample % 3}
        if not min(short.values()):  # a pair without values is an error when it is read
            return pd.DataFrame({"sample_idx": [], "channel": [], "content": []})
        return pd.DataFrame([(SAMPLES * piece + sample, c, idat.encode(rows["snp_id"][:n], rows[v][:n])) for (c, n), v in zip(short.items(), ("grn", "red"), strict=True)])

    cells = probes(spark, sf_dir).withColumn("piece", F.floor(F.col("snp_id") / FILE_MARKERS).cast("int"))
    files = cells.groupBy("sample_idx", "piece").applyInPandas(write, "sample_idx int, channel string, content binary")
    return idat.zipped(files).select((F.col("sample_idx") % SAMPLES).alias("sample_idx"), "snp_id", "red", "grn")


def idat_source(spark, sf_dir):
    """All cells written as a folder of gzipped channel files by the ``idat`` source, and read by it: a task opens a sample's two files."""
    idat_source_module.register(spark)
    place, piece = shared(spark, "channel_files"), F.floor(F.col("snp_id") / FILE_MARKERS).cast("int")
    cells = probes(spark, sf_dir).select(F.format_string("S%d_%d", "sample_idx", piece).alias("sample"), "snp_id", "red", "grn")
    cells.repartition("sample").sortWithinPartitions("sample", "snp_id").write.format("idat").option("gzip", "true").mode("overwrite").save(place)
    read = spark.read.format("idat").load(place)
    number = F.regexp_extract("sample", r"^S(\d+)_", 1).cast("int")  # gzipped files keep an extension and their channel in the name
    return read.select(number.alias("sample_idx"), "snp_id", "red", "grn")


def k1_fit(spark, sf_dir):
    """One-component fits by plain aggregation."""
    cells = probes(spark, sf_dir)
    x, y = features.theta_r(F.col("red"), F.col("grn"), CFG)
    flat = cells.join(snps.common_snps(cells), "snp_id", "left_semi").select("snp_id", x.alias("x"), y.alias("y"))
    means = flat.groupBy("snp_id").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.greatest(F.var_pop("x"), F.lit(0.01)).alias("vx"), F.greatest(F.var_pop("y"), F.lit(0.01)).alias("vy"))
    density = features.log_density(*map(F.col, ("x", "y", "mx", "my", "vx", "vy")))
    rows = flat.join(means, "snp_id").groupBy("snp_id", "n", "mx", "my", "vx", "vy").agg(F.sum(density).alias("loglik"))
    return rows.select("snp_id", "n", *map(_r, ("mx", "my", "vx", "vy", "loglik")), F.round(features.bic(F.col("loglik"), F.lit(1), F.col("n")), 4).alias("bic"))


def _fixed(k: int):
    def query(spark, sf_dir):
        return mixture.fixed_em(points(spark, sf_dir), k, ROUNDS).select("snp_id", "comp", *map(_r, ("w", "mx", "my", "vx", "vy", "loglik")))

    return query


def bic_choose_k(spark, sf_dir):
    return fits(spark, sf_dir).select("snp_id", F.col("k_bic").alias("k"), *(F.round(F.col("bics")[j], 3).alias(f"bic{j + 1}") for j in range(3)))


def collapse_k(spark, sf_dir):
    return fits(spark, sf_dir).select("snp_id", "k_bic", "k")


def posteriors(spark, sf_dir):
    rows = fits(spark, sf_dir).select("snp_id", "k", F.explode(F.arrays_zip("samples", "lab", "post")).alias("p"))
    return rows.select("snp_id", "k", F.col("p.samples").alias("sample_idx"), "p.lab", F.round("p.post", 4).alias("post"))


def genotype_labels(spark, sf_dir):
    geno = gates.genotypes(F.col("k"), F.col("comps"), CFG.theta_scale)
    return fits(spark, sf_dir).select("snp_id", F.posexplode(F.arrays_zip(F.col("comps.mx").alias("mx"), geno.alias("geno"))).alias("comp", "c")).select("snp_id", "comp", F.round("c.mx", 4).alias("mx"), "c.geno")


def refined_centres(spark, sf_dir):
    rows = gates.refined_markers(fits(spark, sf_dir), CFG, F.lit(CFG.p_min))
    return rows.select("snp_id", F.posexplode("centres").alias("comp", "c")).select("snp_id", "comp", F.round("c.mx", 4).alias("mx"), F.round("c.my", 4).alias("my"))


def maha_gate(spark, sf_dir):
    return called(spark, sf_dir).groupBy("snp_id").agg(F.count_if("maha_gated").alias("n_gated"), F.round(F.max("maha2"), 2).alias("max_maha2"))


def theta_guard(spark, sf_dir):
    return called(spark, sf_dir).groupBy("snp_id", "geno").agg(F.count_if("guard_ok").alias("n_ok"), F.count_if(~F.col("guard_ok")).alias("n_off"))


def calls(spark, sf_dir):
    return called(spark, sf_dir).select("snp_id", "sample_idx", "raw", "k", "lab", "pass_raw", "maha_gated", "call")


def calls_wide(spark, sf_dir):
    return outputs.wide_calls(called(spark, sf_dir), list(range(SAMPLES)))


def calls_matrix(spark, sf_dir):
    """The matrix of a run, written as CSV parts by the ``callmatrix`` sink and read again."""
    place = shared(spark, "call_matrix")
    matrix.write_matrix(called(spark, sf_dir), [f"S{k}" for k in range(SAMPLES)], place)
    return matrix.read_matrix(spark, place, SAMPLES)


def qc_summary(spark, sf_dir):
    rows = gates.sample_summary(called(spark, sf_dir), CFG.p_min, CFG.r_min)
    return rows.withColumns({c: F.round(c, 6) for c in ("call_rate_tau", "call_rate_p090")})


def auto_tau(spark, sf_dir):
    posteriors = stage(spark, thresholds.tau_input(stage(spark, fits(spark, sf_dir), "tau_fits"), CFG.r_min), "tau_input")  # fitted once
    return thresholds.auto_tau(posteriors, CFG.alpha).select(_r("tau"))


def rmin_per_sample(spark, sf_dir):
    return thresholds.sample_floors(probes(spark, sf_dir))


def rmin_upper_median(spark, sf_dir):
    return thresholds.cohort_floor(probes(spark, sf_dir))


def kpp_centres(spark, sf_dir):
    """Where the restarts of the largest fit begin."""
    return mixture.starts(points(spark, sf_dir), 3, CFG).select("snp_id", "restart", "comp", _r("x", 6), _r("y", 6))


def kpp_fits(spark, sf_dir):
    """Fits from k-means++ starts, the best of several restarts."""
    rows = mixture.fits(points(spark, sf_dir), replace(CFG, init="kpp"))
    return rows.select("snp_id", "k", _r("loglik"), _r("bic"))


def state_round_trip(spark, sf_dir):
    """Counters and bad markers of all parts, written as state files and read again; the reader leaves marker 0 out."""
    place, old = shared(spark, "state"), _old_feedback(spark, sf_dir)
    state.write_feedback(old, f"{place}/feedback")
    state.write_bad(old.where("bad").select("snp_id"), f"{place}/bad")
    bad = state.read_bad(spark, f"{place}/bad").select("snp_id", F.lit(True).alias("listed"))
    return state.read_feedback(spark, f"{place}/feedback").join(bad, "snp_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def _old_feedback(spark, sf_dir):
    """Earlier counters for all parts' numbers."""
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("snp_id"), size.alias("seen"), (size % 3).alias("nocall_raw"), (size % 5).alias("nocall_p"), (size % 10 == 0).alias("bad"))


def feedback_update(spark, sf_dir):
    return feedback.updated_feedback(_old_feedback(spark, sf_dir), gates.marker_summary(called(spark, sf_dir)), CFG.nocall_bad_thresh)


def bad_snps_learned(spark, sf_dir):
    old = _old_feedback(spark, sf_dir).where("bad").select("snp_id")
    return feedback.updated_bad(old, feedback.bad_of_run(gates.marker_summary(called(spark, sf_dir)), 0.1))


def feedback_stream(spark, sf_dir):
    """Counters of all events' users over cohorts (a cohort is a kind of event), by a stream in which every cohort arrives twice."""
    low, high = F.col("value") < 20, F.col("value") > 80
    cohorts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cohort"), F.col("user_id").alias("snp_id"))
    rows = cohorts.agg(F.count("*").alias("seen"), F.count_if(low).alias("nocall_raw"), F.count_if(high).alias("nocall_p"), F.count_if(low | high).alias("nocall"))
    place, again = shared(spark, "summaries"), shared(spark, "feedback_state")
    rows.write.parquet(place)
    stream_feedback.counted_files(spark, place, STREAM_BAD, again).count()
    rows.write.mode("append").parquet(place)  # the same cohorts once more, for a stream that starts again
    return stream_feedback.counted_files(spark, place, STREAM_BAD, again)


def plot_points(spark, sf_dir):
    return outputs.plot_points(called(spark, sf_dir), CFG).select("snp_id", "sample_idx", _r("theta", 6), _r("r", 6), "call", "n_called")


def plot_bounds(spark, sf_dir):
    points = outputs.plot_points(called(spark, sf_dir), CFG)
    return outputs.plot_bounds(points).select("snp_id", *(_r(c, 5) for c in ("low_theta", "high_theta", "low_r", "high_r")))


def plot_png(spark, sf_dir):
    """Where the pictures of the first markers have colour: the pixel of each called point, read from the drawn file."""
    fitted = stage(spark, fits(spark, sf_dir), "plot_fits")
    drawn = stage(spark, outputs.plot_points(gates.calls(fitted, CFG, CFG.p_min, CFG.r_min), CFG), "plot_points")
    bounds = outputs.plot_bounds(drawn.select("snp_id", "theta", "r"))
    at = lambda v, low, high, size: F.floor((F.col(v) - F.col(low)) / (F.col(high) - F.col(low)) * size).cast("int")
    pixels = drawn.join(bounds, "snp_id").select("snp_id", "sample_idx", at("theta", "low_theta", "high_theta", outputs.WIDTH).alias("px"), at("r", "high_r", "low_r", outputs.HEIGHT).alias("py"))

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        image = outputs.pixels(rows["png"].iloc[0])
        return rows[["snp_id", "sample_idx", "px", "py"]].assign(inked=(image[rows["py"], rows["px"]] < 255).any(1))

    # Without centres, which would move the bounds.
    pictures = outputs.plots(drawn, fitted.withColumn("comps", F.slice("comps", 1, 0)), CFG, CFG.p_min).select("snp_id", "png")
    return pixels.join(pictures, "snp_id").groupBy("snp_id").applyInPandas(look, "snp_id long, sample_idx int, px int, py int, inked boolean")


def timings(spark, sf_dir):
    """Totals of all events' values by their kind, as spans of a run."""
    rows = timing_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("value").alias("ms")))
    return rows.select("label", _r("total_ms", 3), "count", _r("avg_ms"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "probe_cells": probe_cells,
    "common_snps": common_snps,
    "theta_r": theta_r,
    "raw_gate": raw_gate,
    "log_intensity_stats": log_intensity_stats,
    "first_snps": first_snps,
    "sampled_snps": sampled_snps,
    "bad_snp_antijoin": bad_snp_antijoin,
    "channel_pairs": channel_pairs,
    "idat_decode": idat_decode,
    "channel_zip": channel_zip,
    "idat_source": idat_source,
    "k1_fit": k1_fit,
    "em_k2": _fixed(2),
    "em_k3": _fixed(3),
    "kpp_centres": kpp_centres,
    "kpp_fits": kpp_fits,
    "bic_choose_k": bic_choose_k,
    "collapse_k": collapse_k,
    "posteriors": posteriors,
    "genotype_labels": genotype_labels,
    "refined_centres": refined_centres,
    "maha_gate": maha_gate,
    "theta_guard": theta_guard,
    "calls": calls,
    "calls_wide": calls_wide,
    "calls_matrix": calls_matrix,
    "qc_summary": qc_summary,
    "auto_tau": auto_tau,
    "rmin_per_sample": rmin_per_sample,
    "rmin_upper_median": rmin_upper_median,
    "feedback_update": feedback_update,
    "feedback_stream": feedback_stream,
    "bad_snps_learned": bad_snps_learned,
    "state_round_trip": state_round_trip,
    "plot_points": plot_points,
    "plot_bounds": plot_bounds,
    "plot_png": plot_png,
    "timing_summary": timings,
}
