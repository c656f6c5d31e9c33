"""Monte-Carlo paths on a counter-based generator: a draw is a hash of what it is for.

The generator is defined in whole numbers modulo 2^64 alone: any engine that can multiply and take a
remainder, SQL among them, draws the same (``oracles_draws``).

No draw depends on partitions, order or other segments. The scenario isn't part of a draw's name,
so the two runs of a comparison share their random numbers; a backtest's origin is. A task gets
segments' parameters and a range of simulations, and sums their daily paths before they leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..functions.stage import ship
from .seasonality import factor_for_dates

STEP = 7
#: Simulations of one segment in a row of work.
CHUNK = 500
SIGMA = 0.08
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
NAMES = ["run_id", "segment_key", "platform", "campaign_type"]


def key(seed: int, stream: str, *names: str) -> int:
    """The 64-bit key of a stream of draws: the head of the MD5 of its name."""
    return int(hashlib.md5("|".join([str(seed), stream, *names]).encode()).hexdigest()[:16], 16)


def uniforms(stream: int, *counters: np.ndarray) -> np.ndarray:
    """In (0, 1), one for each combination of counters (from -1 on): a 64-bit finaliser after each of them."""
    with np.errstate(over="ignore"):
        x = np.uint64(stream)
        for c in counters:
            x = x + (np.asarray(c, np.int64) + 1).astype(np.uint64) * np.uint64(GOLDEN)
            x = (x ^ x >> np.uint64(30)) * np.uint64(MIX_A)
            x = (x ^ x >> np.uint64(27)) * np.uint64(MIX_B)
            x = x ^ x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def normals(seed: int, stream: str, names: tuple[str, ...], *counters: np.ndarray) -> np.ndarray:
    u, v = (uniforms(key(seed, stream + end, *names), *counters) for end in ("-r", "-a"))
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def walks(cfg: config.Forecast, draw_id: str, sims: np.ndarray, days: int) -> np.ndarray:
    """A random walk a simulation, less its mean, shared by all segments: the market's common shock."""
    step = normals(cfg.seed, "macro", (draw_id,), sims[:, None], np.arange(1, days + 1)[None, :]) * (SIGMA / 30.0**0.5)
    walk = np.cumsum(step, axis=1)
    return walk - walk.mean(axis=1, keepdims=True)


def future(origins: DataFrame, keys: DataFrame, days: int) -> DataFrame:
    """``keys`` (run_id, segment_key, metric) for each day 1..days after the run's origin: day, date."""
    dated = keys.join(F.broadcast(origins.select("run_id", "origin")), "run_id")
    return dated.select(*keys.columns, F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"), "origin").select(
        *keys.columns, "day", F.date_add("origin", F.col("day")).alias("date")
    )


def expected(models: DataFrame, profile: DataFrame, origins: DataFrame, days: int) -> DataFrame:
    """(run_id, segment_key, metric, day, season, path): the expected path without any draw."""
    grid = factor_for_dates(future(origins, models.select("run_id", "segment_key", "metric"), days), profile)
    joined = grid.join(models.select("run_id", "segment_key", "metric", "level", "growth_annual"), ["run_id", "segment_key", "metric"])
    path = F.col("level") * S.growth_multiplier(F.col("day").cast("double"), F.col("growth_annual")) * F.col("season")
    return joined.select("run_id", "segment_key", "metric", "day", "season", path.alias("path"))


def shocks(runs: DataFrame, cfg: config.Forecast, days: int) -> DataFrame:
    """(run_id, sim, day, shock): ``walks`` of ``runs`` (run_id) as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_id, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sims = np.arange(first, min(first + CHUNK, cfg.n_sims))
                yield _by_day({"run_id": run_id}, sims, days, "shock", walks(cfg, run_id, sims, days))

    ship(runs.sparkSession)
    return _chunked(runs.select("run_id").distinct(), cfg).mapInArrow(run, "run_id string, sim int, day int, shock double")


def segment_normals(keys: DataFrame, cfg: config.Forecast, stream: str, days: int) -> DataFrame:
    """(run_id, segment_key, sim, day, z): what a stream of draws holds for ``keys`` (run_id, segment_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_id, segment, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sims = np.arange(first, min(first + CHUNK, cfg.n_sims))
                z = normals(cfg.seed, stream, (run_id, segment), sims[:, None], np.arange(1, days + 1)[None, :])
                yield _by_day({"run_id": run_id, "segment_key": segment}, sims, days, "z", z)

    ship(keys.sparkSession)
    work = _chunked(keys.select("run_id", "segment_key").distinct(), cfg)
    return work.mapInArrow(run, "run_id string, segment_key string, sim int, day int, z double")


def _chunked(keys: DataFrame, cfg: config.Forecast) -> DataFrame:
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_sims - 1), F.lit(CHUNK))).alias("first"))


def _by_day(own: dict[str, str], sims: np.ndarray, days: int, name: str, values: np.ndarray) -> pa.RecordBatch:
    n = len(sims) * days
    columns = {k: pa.array([v] * n, pa.string()) for k, v in own.items()}
    columns |= {"sim": np.repeat(sims, days).astype(np.int32), "day": np.tile(np.arange(1, days + 1), len(sims)).astype(np.int32), name: values.ravel()}
    return pa.RecordBatch.from_pydict(columns)


def simulate(
    models: DataFrame, profile: DataFrame, betas: DataFrame, origins: DataFrame, cfg: config.Forecast, overrides: DataFrame | None = None
) -> DataFrame:
    """The work of a run: a row for each segment and range of ``CHUNK`` simulations, with all that its paths need.

    ``models``: decompositions with platform, campaign_type and ``draw_id`` (what names the draws).
    ``overrides`` (run_id, segment_key, day, plan) replace the free spend paths of their segments.
    ``periods`` and ``cumulative_fan`` draw the paths and sum them.
    """
    keys = ["run_id", "segment_key"]
    by_day = lambda value: F.sort_array(F.collect_list(F.struct("day", value)))
    held = F.struct("level", "level_log_sigma", "growth_annual", "growth_sigma", "resid_block")
    path = expected(models, profile, origins, max(cfg.horizons)).groupBy(*keys, "metric").agg(
        by_day("season")["season"].alias("season"), by_day("path")["path"].alias("path")
    )
    one = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    per = models.select(*NAMES, "draw_id", "metric", held.alias("model")).join(path, [*keys, "metric"])
    per = per.groupBy(*NAMES, "draw_id").agg(*[one(m, c) for m in ("revenue", "spend") for c in ("model", "season")], one("spend", "path"))
    per = per.join(betas.select(*keys, "beta"), keys)
    if overrides is not None:
        per = per.join(overrides.groupBy(*keys).agg(by_day("plan")["plan"].alias("plan")), keys, "left")
    else:
        per = per.withColumn("plan", F.lit(None).cast("array<double>"))
    starts = F.explode(F.sequence(F.lit(0), F.lit(cfg.n_sims - 1), F.lit(CHUNK)))
    # By number: few bytes are much work here, and would be coalesced into one task.
    tasks = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return per.withColumn("first", starts).repartition(tasks, *NAMES, "first")


def paths(row: dict, cfg: config.Forecast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(simulations, revenue, spend) of a row of work; the latter have a line a simulation and a column a day."""
    sims = np.arange(row["first"], min(row["first"] + CHUNK, cfg.n_sims))
    days = np.arange(1, max(cfg.horizons) + 1)
    names = (row["draw_id"], row["segment_key"])
    months = (1 - config.DAMPING ** (days / 30.0)) / (1 - config.DAMPING)

    def drawn(m: str, sim: np.ndarray) -> np.ndarray:
        x = row[f"{m}_model"]
        level = x["level"] * np.exp(normals(cfg.seed, f"{m}-level", names, sim) * x["level_log_sigma"])
        growth = np.clip(x["growth_annual"] + normals(cfg.seed, f"{m}-growth", names, sim) * x["growth_sigma"], -0.6, 0.9)
        grown = np.clip((1 + growth[:, None]) ** (months / 12)[None, :], 0.4, 2.5)
        return level[:, None] * grown * np.array(row[f"{m}_season"])[None, :]

    def block(m: str) -> np.ndarray:
        """Blocks of seven days from a random start, in a circle; single days where the block is shorter."""
        held = np.array(row[f"{m}_model"]["resid_block"])
        step = STEP if len(held) >= STEP else 1
        week, offset = (days - 1) // step, (days - 1) % step
        start = np.floor(uniforms(key(cfg.seed, f"{m}-block", *names), sims[:, None], np.arange(week[-1] + 1)[None, :]) * len(held))
        return held[(start.astype(np.int64)[:, week] + offset) % len(held)]

    base = np.array(row["spend_path"])[None, :] if cfg.anchor == "expected" else drawn("spend", np.array([-1]))
    base = np.maximum(base, 1e-9)
    if row["plan"] is None:
        spend = drawn("spend", sims) * (1 + 0.5 * (block("spend") - 1))
    else:
        spend = np.array(row["plan"])[None, :] * np.exp(normals(cfg.seed, "execution", names, sims[:, None], days[None, :]) * 0.03)
    spend = np.maximum(spend, 0.0)
    ratio = spend / base
    response = np.where(ratio > 0, np.power(np.where(ratio > 0, ratio, 1.0), row["beta"]), 0.0 if cfg.zero_spend == "strict" else 1.0)
    revenue = drawn("revenue", sims) * block("revenue") * response * np.exp(walks(cfg, row["draw_id"], sims, len(days)))
    return sims, np.maximum(revenue, 0.0), spend


def periods(work: DataFrame, cfg: config.Forecast) -> DataFrame:
    """(run_id, segment, sim, horizon, revenue, spend): sums of each path's first days, all horizons in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                sims, revenue, spend = paths(row, cfg)
                for h in cfg.horizons:
                    n = len(sims)
                    own = [pa.array([row[c]] * n, pa.string()) for c in NAMES]
                    sums = [pa.array(x[:, :h].sum(axis=1)) for x in (revenue, spend)]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(sims.astype(np.int32)), pa.array(np.full(n, h, np.int32)), *sums], [*NAMES, "sim", "horizon", "revenue", "spend"]
                    )

    ship(work.sparkSession)
    schema = ", ".join(f"{c} string" for c in NAMES)
    return work.mapInArrow(run, f"{schema}, sim int, horizon int, revenue double, spend double")


def cumulative_fan(work: DataFrame, cfg: config.Forecast) -> DataFrame:
    """(run_id, day, cum_rev_p10, cum_rev_p50, cum_rev_p90) of total revenue, not calibrated.

    A group is all segments of a run in one range of simulations: taxonomy bounds their number.
    """

    def run(t: pa.Table) -> pa.Table:
        total = 0.0
        for row in t.to_pylist():
            sims, revenue, _ = paths(row, cfg)
            total = total + revenue
        cum = np.cumsum(total, axis=1)
        n, days = cum.shape
        return pa.table({
            "run_id": pa.array(t["run_id"].to_pylist()[:1] * (n * days), pa.string()), "sim": np.repeat(sims, days).astype(np.int32),
            "day": np.tile(np.arange(1, days + 1), n).astype(np.int32), "cum": cum.ravel(),
        })

    ship(work.sparkSession)
    found = work.groupBy("run_id", "first").applyInArrow(run, "run_id string, sim int, day int, cum double")
    return found.groupBy("run_id", "day").agg(*[F.percentile("cum", F.lit(q / 100)).alias(f"cum_rev_p{q}") for q in (10, 50, 90)])
