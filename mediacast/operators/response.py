"""Spend elasticity: robust log-log regression of revenue on spend for each segment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..functions.stage import ship

SEGMENT = ["run_id", "segment_key"]
FIT = pa.schema(
    [("run_id", pa.string()), ("segment_key", pa.string()), ("beta", pa.float64()), ("scale", pa.float64()), ("n", pa.int64()), ("r2", pa.float64()),
     ("spend_ref", pa.float64()), ("revenue_ref", pa.float64())]
)


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and r2 by least squares; the least-norm line where all x are equal."""
    mx, my = x.mean(), y.mean()
    if x.min() == x.max():
        flat = my / (mx * mx + 1)
        return flat * mx, flat, 0.0
    dx, dy = x - mx, y - my
    xx, xy, yy = dx @ dx, dx @ dy, dy @ dy
    return xy / xx, my - xy / xx * mx, xy * xy / (xx * yy) if yy > 0 else 1.0


def _robust(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, int]:
    """The line through the points that aren't far from the first line, and how many these are."""
    slope, intercept, _ = _line(x, y)
    e = y - intercept - slope * x
    off = np.abs(e - np.median(e))
    mad = np.median(off)
    near = (off <= 3 * 1.4826 * mad) | (mad <= 0)
    if near.sum() >= 5:
        x, y = x[near], y[near]
    return *_line(x, y), len(x)


def fit_elasticity(segments: DataFrame) -> DataFrame:
    """(run_id, segment_key, beta, scale, n, r2, spend_ref, revenue_ref) of every segment.

    Two passes: points further than three scaled median deviations from the first line's median
    residual are left out of the second, if five stay. Under ten usable days beta is the default.
    A segment's days, some thousands, meet once, and all medians and both lines come from their arrays.
    """
    low, high = config.BETA_BOUNDS

    def run(t: pa.Table) -> pa.Table:
        spend, revenue = (t[c].to_numpy().astype(float) for c in ("spend", "revenue"))
        usable = (spend > 0) & (revenue > 0)
        spend, revenue = spend[usable], revenue[usable]
        days = len(spend)
        beta, scale, n, r2 = config.BETA_DEFAULT, None, days, 0.0
        if days >= 10:
            slope, intercept, r2, n = _robust(np.log(spend), np.log(revenue))
            beta, scale = min(max(slope, low), high), float(np.exp(intercept))
        refs = [float(np.median(v)) if days else 0.0 for v in (spend, revenue)]
        row = [t["run_id"][0].as_py(), t["segment_key"][0].as_py(), beta, scale, n, r2, *refs]
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(FIT, row, strict=True)})

    ship(segments.sparkSession)
    return segments.select(*SEGMENT, "spend", "revenue").groupBy(*SEGMENT).applyInArrow(
        run, "run_id string, segment_key string, beta double, scale double, n long, r2 double, spend_ref double, revenue_ref double"
    )


def response_curve(fits: DataFrame, spends: DataFrame) -> DataFrame:
    """``fits`` at each ``spend`` of a short grid (run_id, segment_key, spend): revenue, average and marginal return."""
    at = spends.join(fits, SEGMENT)
    s, a, b = F.col("spend"), F.col("scale"), F.col("beta")
    return at.select(*SEGMENT, "spend", (S.average_roas(s, a, b) * s).alias("revenue"), S.average_roas(s, a, b).alias("average_roas"), S.marginal_roas(s, a, b).alias("marginal_roas"))


def spend_grid(fits: DataFrame, points: int = 40) -> DataFrame:
    """Even grids from a fifth (1 at least) to three times the reference spend."""
    low, high = F.greatest(0.2 * F.col("spend_ref"), F.lit(1.0)), 3 * F.col("spend_ref") + 1
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    return fits.select(*SEGMENT, low.alias("low"), high.alias("high"), k.alias("k")).select(*SEGMENT, (F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / (points - 1)).alias("spend"))
