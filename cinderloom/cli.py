"""Command line: ``python -m cinderloom.cli --root DIR --out-dir DIR [...]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import CohortConfig
from .plans.cohort import run_from_files


def parse(argv: list[str] | None = None) -> tuple[argparse.Namespace, CohortConfig]:
    p, d = argparse.ArgumentParser(prog="cinderloom"), CohortConfig()
    p.add_argument("--root", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--feat", default="thetar", choices=["thetar"])
    p.add_argument("--thetar", nargs=2, type=float, default=(d.w_theta, d.w_r), metavar=("W_THETA", "W_R"))
    p.add_argument("--r-min", default=str(d.r_min), help="a number, or auto")
    p.add_argument("--p-min", default=str(d.p_min), help="a number, or auto")
    for name, value in (("alpha", d.alpha), ("max-maha", d.max_maha), ("tol", d.tol), ("nocall-bad-thresh", d.nocall_bad_thresh)):
        p.add_argument(f"--{name}", type=float, default=value)
    for name, value in (("k-max", d.k_max), ("max-iters", d.max_iters), ("seed", d.seed), ("restarts", d.restarts), ("first", 0), ("plot-first-snps", d.plot_first_snps), ("max-snps", 0), ("sample-snps", 0)):
        p.add_argument(f"--{name}", type=int, default=value)
    for name in ("feedback-in", "feedback-out", "bad-snps-in", "bad-snps-out"):
        p.add_argument(f"--{name}")
    p.add_argument("--drop-bad-snps", action=argparse.BooleanOptionalAction, default=d.drop_bad_snps)
    p.add_argument("--debug-snp", type=int)
    p.add_argument("--init", default=d.init, choices=["quantile", "kpp"])
    p.add_argument("--rmin-formula", default=d.rmin_formula, choices=["reference", "exact"])
    a = p.parse_args(argv)
    names = ("alpha", "max_maha", "tol", "nocall_bad_thresh", "k_max", "max_iters", "seed", "restarts", "first", "plot_first_snps", "max_snps", "sample_snps", "drop_bad_snps", "debug_snp", "init", "rmin_formula")
    cfg = CohortConfig(w_theta=a.thetar[0], w_r=a.thetar[1], r_min=0 if a.r_min == "auto" else int(a.r_min), p_min=None if a.p_min == "auto" else float(a.p_min), **{n: getattr(a, n) for n in names})
    return a, cfg


def main(argv: list[str] | None = None) -> int:
    a, cfg = parse(argv)
    done = run_from_files(SparkSession.builder.getOrCreate(), a.root, a.out_dir, cfg, a.feedback_in, a.feedback_out, a.bad_snps_in, a.bad_snps_out)
    print("no pairs of channel files" if done is None else f"{a.out_dir}/calls\n{a.out_dir}/cohort_calls\n{a.out_dir}/cohort_qc_summary")
    if done is not None:
        print(*done.timer.lines(), sep="\n", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
