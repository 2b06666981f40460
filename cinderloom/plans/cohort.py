"""A whole run: probes to calls, quality table and state."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import CohortConfig
from ..operators import feedback, gates, mixture, outputs, snps, thresholds
from ..sources import files, idat, idat_source, matrix, state
from ..sources.places import SCHEMES, scheme
from ..timing import Timer, timing_summary


def shared(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; where that is unset, a local session gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder for intermediate tables")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/cohort/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: later steps don't compute ``df`` again."""
    path = shared(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class Run:
    calls: DataFrame
    qc: DataFrame
    summary: DataFrame
    fits: DataFrame
    tau: float
    r_min: int
    timer: Timer
    #: Counters of all calls, taken while they were written.
    totals: dict[str, int]


def _chosen(spark: SparkSession, probes: DataFrame, cfg: CohortConfig, bad: DataFrame | None, samples: int) -> DataFrame:
    if samples < 2:
        raise ValueError("a run needs two samples or more")
    chosen = stage(spark, snps.selected(probes, cfg, bad, samples), "snps")
    if chosen.isEmpty():
        raise ValueError("no common markers")
    return chosen


def run(probes: DataFrame, cfg: CohortConfig | None = None, bad: DataFrame | None = None, chosen: DataFrame | None = None) -> Run:
    """Fit and call all selected markers of ``probes`` (sample_idx, snp_id, red, grn), or the ``chosen`` ones (snp_id)."""
    cfg, spark, timer = cfg or CohortConfig(), probes.sparkSession, Timer()
    with timer.span("load_samples"):
        probes = stage(spark, probes.select("sample_idx", "snp_id", "red", "grn"), "probes")
    with timer.span("common_ids"):
        if chosen is None:
            chosen = _chosen(spark, probes, cfg, bad, probes.select("sample_idx").distinct().count())
    with timer.span("compute_r_min"):
        r_min = cfg.r_min or int(thresholds.cohort_floor(probes, cfg.rmin_formula).first()[0])
    with timer.span("chunk_cluster_em_bic"):
        fits = stage(spark, mixture.fits(mixture.markers(probes, chosen, cfg), cfg), "fits")
    with timer.span("auto_tau"):
        tau = cfg.p_min if cfg.p_min is not None else float(thresholds.auto_tau(thresholds.tau_input(fits, r_min), cfg.alpha).first()[0])
    with timer.span("chunk_finalize_and_write"):
        seen = Observation("calls")
        called = stage(spark, gates.calls(fits, cfg, tau, r_min).observe(seen, *gates.totals()), "calls")
        gates.check_totals(seen.get)
    return Run(called, gates.sample_summary(called, tau, r_min), gates.marker_summary(called), fits, tau, r_min, timer, seen.get)


def preflight_floor(spark: SparkSession, root: str, first: int = 0, formula: str = "reference") -> int:
    """The intensity floor that a run over the files below ``root`` would learn, without fitting anything."""
    return int(thresholds.cohort_floor(idat.read_probes(spark, root, first), formula).first()[0])


def decoded_cells(spark: SparkSession, root: str, cfg: CohortConfig, bad: DataFrame | None, samples: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Cells (sample_idx, snp_id, red, grn) of the ``samples`` below ``root``, their names, and the chosen markers if these are known already.

    A run that wants some markers only reads ids first; the second reading leaves the other markers out where they are
    decoded, so their cells are never written or shuffled.  (A learned floor needs all cells, so then they are read once.)
    """
    every = idat.read_probes(spark, root, cfg.first)
    few = cfg.max_snps or cfg.sample_snps or (bad is not None and cfg.drop_bad_snps)
    if not few or not cfg.r_min or scheme(root) not in SCHEMES:
        probes = stage(spark, every, "decoded")
        return probes.drop("sample"), probes.select("sample_idx", "sample").distinct(), None
    chosen = _chosen(spark, every, cfg, bad, samples)
    place = idat_source.write_bloom(chosen, shared(spark, "chosen_markers"))
    cells = stage(spark, idat.read_probes(spark, root, cfg.first, place), "decoded")
    return cells.drop("sample"), cells.select("sample_idx", "sample").distinct(), chosen


def run_from_files(spark: SparkSession, root: str, out_dir: str, cfg: CohortConfig | None = None, feedback_in: str | None = None, feedback_out: str | None = None, bad_in: str | None = None, bad_out: str | None = None) -> Run | None:
    """The command line's run: files below ``root``, results below ``out_dir``.  None if there is no pair of files."""
    cfg = cfg or CohortConfig()
    if not (samples := idat.find_pairs(spark, root, cfg.first).count()):
        return None
    bad = state.read_bad(spark, bad_in) if bad_in else None
    probes, names, chosen = decoded_cells(spark, root, cfg, bad, samples)
    done = run(probes, cfg, bad, chosen)
    with done.timer.span("write_calls_header"):
        done.calls.join(names, "sample_idx").write.mode("overwrite").parquet(f"{out_dir}/calls")
        if scheme(out_dir) in SCHEMES:  # the matrix is written by Python
            order = [r["sample"] for r in names.orderBy("sample_idx").collect()]  # a row for each sample, which the driver has listed
            matrix.write_matrix(done.calls, order, f"{out_dir}/cohort_calls")
    with done.timer.span("write_qc_summary"):
        rates = {c: F.format_string("%.6f", c) for c in ("call_rate_tau", "call_rate_p090")} | {"tau_used": F.format_string("%.4f", "tau_used")}
        qc = names.join(done.qc, "sample_idx").withColumns(rates).withColumnRenamed("sample", "Sample")
        qc.coalesce(1).sortWithinPartitions("sample_idx").drop("sample_idx").write.mode("overwrite").csv(f"{out_dir}/cohort_qc_summary", header=True)
    with done.timer.span("save_learning_state"):
        if feedback_out:
            old = state.read_feedback(spark, feedback_in) if feedback_in else spark.createDataFrame([], state.FEEDBACK)
            state.write_feedback(stage(spark, feedback.updated_feedback(old, done.summary, cfg.nocall_bad_thresh), "feedback"), feedback_out)
        if bad_out:
            old = bad if bad is not None else spark.createDataFrame([], "snp_id long")
            state.write_bad(stage(spark, feedback.updated_bad(old, feedback.bad_of_run(done.summary, cfg.nocall_bad_thresh)), "bad"), bad_out)
    if cfg.plot_first_snps:
        with done.timer.span("plot_one_snp"):
            points = stage(spark, outputs.plot_points(done.calls, cfg), "plot_points")
            points.write.mode("overwrite").parquet(f"{out_dir}/plot_points")
            drawn = stage(spark, outputs.plots(points, done.fits, cfg, done.tau), "plots")
            drawn.select("name", "svg").write.mode("overwrite").partitionBy("name").text(f"{out_dir}/plots")
            if scheme(out_dir) in SCHEMES:
                files.write_files(drawn.select(F.concat("name", F.lit(".png")).alias("name"), F.col("png").alias("content")), f"{out_dir}/pictures")
    if cfg.debug_snp is not None:
        with done.timer.span("debug_csv_one_snp"):
            outputs.marker_centres(done.fits, cfg.debug_snp, cfg, done.tau).coalesce(1).write.mode("overwrite").csv(f"{out_dir}/debug_snp_{cfg.debug_snp:08d}_centres", header=True)
            outputs.marker_dump(done.calls, cfg.debug_snp, done.tau, done.r_min).coalesce(1).write.mode("overwrite").csv(f"{out_dir}/debug_snp_{cfg.debug_snp:08d}", header=True)
    times = done.timer.frame(spark)
    times.coalesce(1).write.mode("overwrite").csv(f"{out_dir}/timings", header=True)
    timing_summary(times).orderBy(F.desc("total_ms")).coalesce(1).write.mode("overwrite").csv(f"{out_dir}/timings_summary", header=True)
    return done
