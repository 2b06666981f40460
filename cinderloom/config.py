"""Settings of a cohort run."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the call rules.
STRONG_POSTERIOR, GUARD_BAND, P90 = 0.97, 0.04, 0.90
MIN_WEIGHT, GAP_K3, GAP_K2 = 0.03, 0.035, 0.020
HOM_LOW, HOM_HIGH = 0.33, 0.67
VAR_INIT, VAR_EM, VAR_DIST, TINY = 1e-2, 5e-6, 1e-8, 1e-12
TAU_LOW, TAU_HIGH, TAU_NONE = 0.85, 0.9999, 0.99
RMIN_LOW, RMIN_HIGH = 300, 800
#: Markers from which an automatic posterior threshold is learned.
TAU_MARKERS = 10_000


@dataclass(frozen=True)
class CohortConfig:
    """Defaults are those of the command line.  ``p_min`` None learns it at false-call rate ``alpha``; ``r_min`` 0 learns it.

    ``init`` is "quantile" (deterministic) or "kpp" (seeded, best of ``restarts``).  ``rmin_formula`` "reference"
    keeps the published quadratic with its two slips, "exact" is the equal-density point.
    """

    w_theta: float = 1.0
    w_r: float = 0.45
    r_min: int = 500
    p_min: float | None = 0.85
    alpha: float = 0.005
    max_maha: float = 6.0
    k_max: int = 3
    max_iters: int = 200
    tol: float = 1e-6
    seed: int = 42
    restarts: int = 3
    init: str = "quantile"
    first: int = 0
    max_snps: int = 0
    sample_snps: int = 0
    drop_bad_snps: bool = True
    nocall_bad_thresh: float = 0.35
    plot_first_snps: int = 20
    debug_snp: int | None = None
    rmin_formula: str = "reference"

    def __post_init__(self) -> None:
        if not 1 <= self.k_max <= 3:
            raise ValueError("k_max must be 1, 2 or 3")
        if not 1 <= self.restarts <= 13:
            raise ValueError("restarts must be 1 to 13")
        if self.max_snps and self.sample_snps:
            raise ValueError("max_snps and sample_snps exclude each other")
        if self.init not in ("quantile", "kpp") or self.rmin_formula not in ("reference", "exact"):
            raise ValueError("unknown init or rmin_formula")

    @property
    def theta_scale(self) -> float:
        return max(self.w_theta, 1e-9)
