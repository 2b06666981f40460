"""Outputs of a run: call matrix, plot points, one marker's dump."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CohortConfig
from ..functions.features import snp_name
from . import gates


def wide_calls(called: DataFrame, samples: list[int], prefix: str = "s") -> DataFrame:
    """A row for each marker and a column for each sample; the list of samples is given, so the pivot reads once."""
    wide = called.groupBy("snp_id").pivot("sample_idx", samples).agg(F.first("call"))
    return wide.select("snp_id", *(F.col(str(s)).alias(f"{prefix}{s}") for s in samples))


def plot_points(called: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Called points of the first markers by id (and of the debug marker): snp_id, sample_idx, theta, r, call, n_called."""
    ids = called.select("snp_id").distinct().orderBy("snp_id").limit(cfg.plot_first_snps)
    if cfg.debug_snp is not None:
        ids = ids.union(called.where(F.col("snp_id") == cfg.debug_snp).select("snp_id")).distinct()
    points = called.where("call != 'NoCall'").join(F.broadcast(ids), "snp_id")  # at most plot_first_snps + 1 rows
    return points.select("snp_id", "sample_idx", (F.col("x") / cfg.theta_scale).alias("theta"), (F.col("y") / max(cfg.w_r, 1e-9)).alias("r"), "call", F.count("*").over(Window.partitionBy("snp_id")).alias("n_called"))


def plot_bounds(points: DataFrame) -> DataFrame:
    """Axis ranges of each marker's plot, padded by 6 percent of the range (1 at least)."""
    pad = lambda c: 0.06 * F.greatest(F.max(c) - F.min(c), F.lit(1.0))
    return points.groupBy("snp_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("theta", "r") for n, f in (("low", lambda c: F.min(c) - pad(c)), ("high", lambda c: F.max(c) + pad(c)))))


#: Fixed values of the picture: size, colours of the genotypes, and how far dots and crosses reach.
WIDTH, HEIGHT = 1400, 1000
COLOURS = {"AA": "#d62728", "AB": "#1f77b4", "BB": "#2ca02c"}
DOT, CROSS = 4, 8


def _scales(points: list, centres: list[tuple[float, float]], width: int, height: int) -> list:
    """Where a theta and an r fall in the picture: the ranges of ``plot_bounds``, over centres as well."""
    scale = []
    for i, (name, size) in enumerate((("theta", width), ("r", height))):
        v = [p[name] for p in points] + [m[i] for m in centres]
        pad = 0.06 * max(max(v) - min(v), 1.0)
        low, high = min(v) - pad, max(v) + pad
        scale.append(lambda x, low=low, high=high, size=size, flip=i == 1: (high - x if flip else x - low) / (high - low) * size)
    return scale


def svg(points: list, centres: list[tuple[float, float]] = (), width: int = WIDTH, height: int = HEIGHT) -> str:
    """A scatter plot of one marker's rows of ``plot_points`` as SVG text; crosses mark centres."""
    if not points and not centres:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"/>'
    x_of, y_of = _scales(points, centres, width, height)
    dots = "".join(f'<circle cx="{x_of(p["theta"]):.1f}" cy="{y_of(p["r"]):.1f}" r="{DOT}" fill="{COLOURS[p["call"]]}"/>' for p in points)
    marks = "".join(f'<path d="M{x_of(x) - CROSS:.1f} {y_of(y):.1f}h{2 * CROSS}m-{CROSS} -{CROSS}v{2 * CROSS}" stroke="black"/>' for x, y in centres)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{dots}{marks}</svg>'


def raster(points: list, centres: list[tuple[float, float]] = (), width: int = WIDTH, height: int = HEIGHT) -> np.ndarray:
    """The same plot as pixels [height, width, 3]: dots, and black crosses over them."""
    out = np.full((height, width, 3), 255, np.uint8)
    if not points and not centres:
        return out
    x_of, y_of = _scales(points, centres, width, height)

    def paint(x: float, y: float, dx: np.ndarray, dy: np.ndarray, colour: tuple[int, ...]) -> None:
        px, py = int(x_of(x)) + dx, int(y_of(y)) + dy
        on = (px >= 0) & (px < width) & (py >= 0) & (py < height)
        out[py[on], px[on]] = colour

    dy, dx = np.mgrid[-DOT : DOT + 1, -DOT : DOT + 1]
    disc = dx**2 + dy**2 <= DOT**2
    for p in points:
        paint(p["theta"], p["r"], dx[disc], dy[disc], tuple(bytes.fromhex(COLOURS[p["call"]][1:])))
    arm = np.arange(-CROSS, CROSS + 1)
    for x, y in centres:
        paint(x, y, np.append(arm, 0 * arm), np.append(0 * arm, arm), (0, 0, 0))
    return out


def png(pixels: np.ndarray) -> bytes:
    """Pixels [height, width, 3] as a PNG file: true colour, eight bits, each row filtered by the row above."""
    height, width, _ = pixels.shape
    rows = pixels.reshape(height, width * 3)
    up = rows.copy()
    up[1:] -= rows[:-1]  # modulo 256, as filter 2 wants it
    data = np.concatenate([np.full((height, 1), 2, np.uint8), up], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data, 6)) + chunk(b"IEND", b"")


def pixels(raw: bytes) -> np.ndarray:
    """The pixels of a file by ``png``."""
    at, width, height, data = 8, 0, 0, b""
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 3 * width)[:, 1:]
    return np.cumsum(rows, 0, dtype=np.uint8).reshape(height, width, 3)


def plots(points: DataFrame, fits: DataFrame, cfg: CohortConfig, tau: float) -> DataFrame:
    """(snp_id, name, svg, png): pictures of each marker of ``plot_points`` rows with its refined centres; a task draws a marker."""
    rows = gates.refined_markers(fits.join(F.broadcast(points.select("snp_id").distinct()), "snp_id"), cfg, F.lit(tau))  # at most plot_first_snps + 1 rows
    places = F.transform("centres", lambda c: F.struct((c["mx"] / cfg.theta_scale).alias("theta"), (c["my"] / max(cfg.w_r, 1e-9)).alias("r")))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        centres = [(c["theta"], c["r"]) for c in rows["places"].iloc[0]]
        dots = rows.sort_values("sample_idx").to_dict("records")
        return pd.DataFrame({"snp_id": [rows["snp_id"].iloc[0]], "name": [rows["name"].iloc[0]], "svg": [svg(dots, centres)], "png": [png(raster(dots, centres))]})

    joined = points.join(rows.select("snp_id", places.alias("places")), "snp_id")
    return joined.select("snp_id", snp_name(F.col("snp_id")).alias("name"), "sample_idx", "theta", "r", "call", "places").groupBy("snp_id").applyInPandas(draw, "snp_id long, name string, svg string, png binary")


def marker_dump(called: DataFrame, snp_id: int, tau: float, r_min: int) -> DataFrame:
    """All samples of one marker, for looking at."""
    rows = called.where(F.col("snp_id") == snp_id)
    return rows.select("snp_id", snp_name(F.col("snp_id")).alias("name"), "sample_idx", F.col("x").alias("theta"), F.col("y").alias("r"), "lab", F.col("post").alias("posterior"), "maha_gated", F.col("raw").alias("raw_sum"), F.col("call").alias("final_call"), F.lit(tau).alias("tau"), F.lit(r_min).alias("r_min"))


def marker_centres(fits: DataFrame, snp_id: int, cfg: CohortConfig, tau: float) -> DataFrame:
    """The fitted and the refined centre of each component of one marker, with its genotype."""
    rows = gates.refined_markers(fits.where(F.col("snp_id") == snp_id), cfg, F.lit(tau))
    rows = rows.select("snp_id", F.posexplode(F.arrays_zip("comps", "centres", "geno")).alias("comp", "c"))
    return rows.select("snp_id", "comp", "c.geno", F.col("c.comps.mx").alias("mean_x"), F.col("c.comps.my").alias("mean_y"), F.col("c.centres.mx").alias("refined_x"), F.col("c.centres.my").alias("refined_y"))
