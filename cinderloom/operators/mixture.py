"""One small Gaussian mixture per marker, fitted for batches of markers with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GAP_K2, GAP_K3, MIN_WEIGHT, TINY, VAR_DIST, VAR_EM, VAR_INIT, CohortConfig
from ..functions.features import theta_r

COMPONENT = "struct<w: double, mx: double, my: double, vx: double, vy: double>"
FIT = f"snp_id long, k int, comps array<{COMPONENT}>, loglik double, bic double, bics array<double>, k_bic int, samples array<int>, raw array<long>, x array<double>, y array<double>, lab array<int>, post array<double>"
LN_PI = float(np.log(np.pi))


class Model:
    """Mixtures of one size for B markers: w, mx, my, vx, vy [B, K] and loglik [B]."""

    def __init__(self, w, mx, my, vx, vy, loglik):
        self.w, self.mx, self.my, self.vx, self.vy, self.loglik = w, mx, my, vx, vy, loglik

    @property
    def k(self) -> int:
        return self.w.shape[1]

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.w, self.mx, self.my, self.vx, self.vy


def log_joint(x: np.ndarray, y: np.ndarray, m: Model) -> np.ndarray:
    """ln(weight * density) [B, S, K]."""
    vx, vy = np.maximum(m.vx, VAR_DIST)[:, None], np.maximum(m.vy, VAR_DIST)[:, None]
    far = (x[..., None] - m.mx[:, None]) ** 2 / vx + (y[..., None] - m.my[:, None]) ** 2 / vy
    return np.log(np.maximum(m.w, TINY))[:, None] - 0.5 * far - 0.5 * np.log(vx * vy) - LN_PI


def _lse(values: np.ndarray) -> np.ndarray:
    top = values.max(-1)
    shift = np.where(np.isfinite(top), top, 0)
    return np.where(np.isfinite(top), shift + np.log(np.maximum(np.exp(np.minimum(values - shift[..., None], 0)).sum(-1), TINY)), top)


def single(x: np.ndarray, y: np.ndarray) -> Model:
    """The one-component fit in closed form."""
    one = np.ones((len(x), 1))
    spread = [np.maximum(v.var(1, keepdims=True), VAR_INIT) for v in (x, y)]
    m = Model(one, x.mean(1, keepdims=True), y.mean(1, keepdims=True), *spread, None)
    m.loglik = log_joint(x, y, m)[..., 0].sum(1)
    return m


def quantile_centres(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(x, axis=1, kind="stable")
    at = np.minimum((np.arange(1, k + 1) / (k + 1) * x.shape[1]).astype(np.int64), x.shape[1] - 1)
    return np.take_along_axis(x, order[:, at], 1), np.take_along_axis(y, order[:, at], 1)


def stream(seed: int, restart: int, draw: int) -> float:
    """A number in [0, 1) that depends on its counters alone, so any engine with MD5 draws the same."""
    return int(hashlib.md5(f"{seed}:{restart}:{draw}".encode()).hexdigest()[:8], 16) / 2**32


def spread_centres(x: np.ndarray, y: np.ndarray, k: int, seed: int, restart: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """k-means++: a centre is the first point at which the running sum of squared distances reaches a drawn part of their total.

    All markers draw the same numbers.  Points that are all equal to centres give the first centre again.
    """
    n, line = x.shape[1], np.arange(len(x))
    chosen = [np.full(len(x), min(int(stream(seed, restart, 0) * n), n - 1))]
    nearest = np.full(x.shape, np.inf)
    while len(chosen) < k:
        c = chosen[-1]
        nearest = np.minimum(nearest, (x - x[line, c][:, None]) ** 2 + (y - y[line, c][:, None]) ** 2)
        total = np.cumsum(nearest, 1)
        pick = (total < stream(seed, restart, len(chosen)) * total[:, -1:]).sum(1)
        chosen.append(np.where(total[:, -1] > 0, np.where(pick < n, pick, 0), chosen[0]))
    at = np.stack(chosen, 1)
    return np.take_along_axis(x, at, 1), np.take_along_axis(y, at, 1)


def expectation_maximisation(x: np.ndarray, y: np.ndarray, centres: tuple[np.ndarray, np.ndarray], max_iters: int, tol: float) -> Model:
    """EM for all markers at once; a marker that has converged is left alone."""
    b, k = centres[0].shape
    s = x.shape[1]
    floor = [np.repeat(np.maximum(v.var(1, keepdims=True), VAR_INIT), k, 1) for v in (x, y)]
    m = Model(np.full((b, k), 1 / k), *(c.copy() for c in centres), *floor, np.full(b, -np.inf))
    live = np.arange(b)
    for _ in range(max_iters):
        if not len(live):
            break
        px, py = x[live], y[live]
        now = Model(*(p[live] for p in m.parts()), None)
        joint = log_joint(px, py, now)
        total = _lse(joint)
        r = np.exp(joint - total[..., None])
        mass = r.sum(1)
        n = np.maximum(mass, 1e-8)
        mx, my = (r * px[..., None]).sum(1) / n, (r * py[..., None]).sum(1) / n
        vx = np.maximum((r * px[..., None] ** 2).sum(1) / n - mx**2, VAR_EM)
        vy = np.maximum((r * py[..., None] ** 2).sum(1) / n - my**2, VAR_EM)
        w = np.clip(mass / s, TINY, 1)
        moved = np.sqrt((mx - now.mx) ** 2 + (my - now.my) ** 2).sum(1)
        for old, new in zip(m.parts(), (w / w.sum(1, keepdims=True), mx, my, vx, vy), strict=True):
            old[live] = new
        loglik = total.sum(1)
        done = (np.abs(loglik - m.loglik[live]) <= tol) | (moved / k < tol)
        m.loglik[live] = loglik
        live = live[~done]
    return m


def fitted(x: np.ndarray, y: np.ndarray, k: int, cfg: CohortConfig) -> Model:
    if k == 1:
        return single(x, y)
    if cfg.init == "quantile":
        return expectation_maximisation(x, y, quantile_centres(x, y, k), cfg.max_iters, cfg.tol)
    best = None
    for r in range(cfg.restarts):
        m = expectation_maximisation(x, y, spread_centres(x, y, k, cfg.seed, r), cfg.max_iters, cfg.tol)
        if best is None:
            best = m
        else:
            better = m.loglik > best.loglik
            for old, new in zip((*best.parts(), best.loglik), (*m.parts(), m.loglik), strict=True):
                old[better] = new[better]
    return best


def choose_k(bics: np.ndarray) -> np.ndarray:
    """The size of least BIC, ties to the smaller one; bics [B, sizes]."""
    return 1 + np.argmin(bics, 1)


def _gap(m: Model, scale: float) -> np.ndarray:
    return np.diff(np.sort(m.mx / scale, 1), axis=1).min(1) if m.k > 1 else np.full(len(m.w), np.inf)


def collapse(k: np.ndarray, models: dict[int, Model], scale: float) -> np.ndarray:
    """Sizes after the weight rule and then the gap rule; smaller fits are the ones already made."""
    k = k.copy()
    light = {j: m.w.min(1) < MIN_WEIGHT for j, m in models.items()}
    gap = {j: _gap(m, scale) for j, m in models.items()}
    for j in (2, 3):
        if j in models:
            light[j] &= k == j
    for j in (2, 3):
        if j in models:
            k[light[j]] = j - 1
    if 3 in models:
        k[(k == 3) & (gap[3] < GAP_K3)] = 2
    if 2 in models:
        k[(k == 2) & (gap[2] < GAP_K2)] = 1
    return k


def fit_all(x: np.ndarray, y: np.ndarray, cfg: CohortConfig) -> dict:
    """Final sizes, models, labels and posteriors of B markers."""
    b, s = x.shape
    models = {j: fitted(x, y, j, cfg) for j in range(1, cfg.k_max + 1)}
    bics = np.stack([-2 * m.loglik + (5 * j - 1) * np.log(s) for j, m in models.items()], 1)
    best = choose_k(bics)
    k = collapse(best, models, cfg.theta_scale)
    lab, post = np.zeros((b, s), np.int32), np.ones((b, s))
    for j, m in models.items():
        on = np.flatnonzero(k == j)
        if len(on):
            joint = log_joint(x[on], y[on], Model(*(p[on] for p in m.parts()), None))
            joint -= _lse(joint)[..., None]
            lab[on] = joint.argmax(-1)
            post[on] = np.exp(joint.max(-1))
    return {"k": k, "k_bic": best, "bics": bics, "models": models, "lab": lab, "post": post}


def markers(probes: DataFrame, snps: DataFrame, cfg: CohortConfig) -> DataFrame:
    """One row per marker with its samples' points as arrays in sample order: the one large shuffle of a run."""
    x, y = theta_r(F.col("red"), F.col("grn"), cfg)
    points = probes.join(snps, "snp_id", "left_semi").select("snp_id", F.struct("sample_idx", (F.col("red").cast("long") + F.col("grn").cast("long")).alias("raw"), x.alias("x"), y.alias("y")).alias("p"))
    rows = points.groupBy("snp_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    once = F.when(F.size(F.array_distinct("p.sample_idx")) == F.size("p"), F.col("p")).otherwise(F.raise_error(F.lit("a sample has a marker twice")).cast(rows.schema["p"].dataType))
    return rows.withColumn("p", once).select("snp_id", F.col("p.sample_idx").cast("array<int>").alias("samples"), F.col("p.raw").alias("raw"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def fits(points: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Adds the chosen mixture, labels and posteriors to ``markers()`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                rows, s = part.num_rows, len(part.column(1)[0])
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (3, 4)]
                if any(len(f) != rows * s for f in flat):
                    raise ValueError("every marker needs all samples")
                x, y = (f.reshape(rows, s) for f in flat)
                got = fit_all(x, y, cfg)
                comps, loglik, bic = [], [], []
                for r, k in enumerate(got["k"].tolist()):
                    m = got["models"][k]
                    comps.append([dict(zip(("w", "mx", "my", "vx", "vy"), v, strict=True)) for v in zip(*(p[r].tolist() for p in m.parts()), strict=True)])
                    loglik.append(float(m.loglik[r]))
                    bic.append(float(got["bics"][r, k - 1]))
                columns = {"snp_id": part.column(0), "k": got["k"].astype(np.int32), "comps": comps, "loglik": loglik, "bic": bic, "bics": got["bics"].tolist(), "k_bic": got["k_bic"].astype(np.int32), "samples": part.column(1), "raw": part.column(2), "x": part.column(3), "y": part.column(4), "lab": got["lab"].tolist(), "post": got["post"].tolist()}
                kinds = {"comps": pa.list_(pa.struct([(n, pa.float64()) for n in ("w", "mx", "my", "vx", "vy")])), "lab": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds.get(n)) for n, c in columns.items()], list(columns))

    return points.select("snp_id", "samples", "raw", "x", "y").mapInArrow(run, FIT)


def starts(points: DataFrame, k: int, cfg: CohortConfig) -> DataFrame:
    """The k-means++ centres of each marker and restart: snp_id, restart, comp, x, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (1, 2))
                for r in range(cfg.restarts):
                    cx, cy = spread_centres(x, y, k, cfg.seed, r)
                    columns = [np.repeat(batch.column(0).to_numpy(), k), np.full(cx.size, r, np.int32), np.tile(np.arange(k, dtype=np.int32), len(cx)), cx.ravel(), cy.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["snp_id", "restart", "comp", "x", "y"])

    return points.select("snp_id", "x", "y").mapInArrow(run, "snp_id long, restart int, comp int, x double, y double")


def fixed_em(points: DataFrame, k: int, iterations: int) -> DataFrame:
    """Components after exactly ``iterations`` rounds from the quantile start: snp_id, comp, w, mx, my, vx, vy, loglik."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (1, 2))
                m = expectation_maximisation(x, y, quantile_centres(x, y, k), iterations, -1.0)
                columns = [np.repeat(batch.column(0).to_numpy(), k), np.tile(np.arange(k, dtype=np.int32), batch.num_rows), *(p.ravel() for p in m.parts()), np.repeat(m.loglik, k)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["snp_id", "comp", "w", "mx", "my", "vx", "vy", "loglik"])

    return points.select("snp_id", "x", "y").mapInArrow(run, "snp_id long, comp int, w double, mx double, my double, vx double, vy double, loglik double")
