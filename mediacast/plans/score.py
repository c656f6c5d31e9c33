"""The three entry points: score, train (backtest and calibrate), and what-if."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.stage import cut, write_csv, write_text
from ..operators import backtest, budget, hierarchy, insights, model, prepare, response, simulate


@dataclass
class Result:
    origins: DataFrame
    models: DataFrame
    profile: DataFrame
    work: DataFrame
    nodes: DataFrame
    summary: DataFrame
    predictions: DataFrame

    def group(self, level: str, channel: str = "blended", campaign_type: str = "all", campaign_id: str = "all") -> DataFrame:
        """The draws of one node (campaigns have none of their own): horizon, sim, revenue, spend, roas."""
        same = (F.col("level") == level) & (F.col("channel") == channel) & (F.col("campaign_type") == campaign_type) & (F.col("campaign_id") == campaign_id)
        return self.nodes.where(same)


def score(p: prepare.Prepared, priors: model.Model, cfg: config.Forecast, plan: DataFrame | None = None) -> Result:
    models, profile, betas = model.build_segments(p, priors)
    work = simulate.simulate(models, profile, betas, p.origins, cfg, plan)
    nodes = cut(hierarchy.reconcile(simulate.periods(work, cfg)), "nodes")
    summary = cut(hierarchy.summarise(hierarchy.as_campaigns(nodes), priors.scales, cfg.quantiles), "summary")
    shared = hierarchy.campaigns(summary, prepare.top_campaigns(p.meta), cfg.quantiles)
    whole = summary.where("level <> 'campaign'").unionByName(shared)
    return Result(p.origins, models, profile, work, nodes, whole, hierarchy.predictions(whole, p.origins, cfg.currency))


def calibrate(p: prepare.Prepared, priors: model.Model, cfg: config.Forecast) -> DataFrame:
    """Backtest records of all origins in one plan: each is a run, and its draws are named by it."""
    runs = backtest.origins(p.panel, p.origins)
    runs = cut(runs, "backtest-origins")
    past = prepare.replay(p, runs)
    models, profile, betas = model.build_segments(past, replace_scales(priors, None))
    work = simulate.simulate(models, profile, betas, past.origins, replace(cfg, seed=cfg.seed + 7))
    nodes = cut(hierarchy.reconcile(simulate.periods(work, cfg)), "nodes")
    return backtest.records(nodes, backtest.actuals(p.panel, runs, cfg.horizons))


def replace_scales(priors: model.Model, scales: DataFrame | None) -> model.Model:
    return model.Model(priors.seasonal, priors.elasticity, scales)


def train(p: prepare.Prepared, cfg: config.Forecast) -> model.Model:
    priors = model.fit_priors(p)
    return replace_scales(priors, backtest.scales(calibrate(p, priors, cfg)))


def what_if(p: prepare.Prepared, priors: model.Model, scenario: budget.Scenario, cfg: config.Forecast) -> tuple[Result, Result]:
    """Baseline and scenario, both with planned spend and the same draws: untouched segments cancel exactly."""
    models, profile, _ = model.build_segments(p, priors)
    base = budget.baseline(simulate.expected(models, profile, p.origins, max(cfg.horizons)), models)
    plans = [budget.overrides(base, s) for s in (budget.Scenario(scenario.horizon, multiplier=1.0), scenario)]
    first, second = (score(p, priors, cfg, plan) for plan in plans)
    return first, second


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One CSV with a header, numbers to 4 decimals, replacing what is there."""
    numbers = [c for c in predictions.columns if c in ("mean", "std") or c[:1] == "p" and c[1:].isdigit()]
    write_csv(predictions.withColumns({c: F.round(c, 4) for c in numbers}).drop("run_id"), path)


def headline(predictions: DataFrame) -> dict[str, dict[str, float]]:
    """By horizon: revenue and return of the total at p10, p50 and p90."""
    rows = predictions.where("level = 'aggregate' and metric in ('revenue', 'roas')").select("horizon_days", "metric", "p10", "p50", "p90").collect()
    out: dict[str, dict[str, float]] = {}
    for r in sorted(rows, key=lambda r: (r["horizon_days"], r["metric"])):
        out.setdefault(f"{r['horizon_days']}d", {}).update({f"{r['metric']}_{q}": r[q] for q in ("p50", "p10", "p90")})
    return out


def facts(result: Result, p: prepare.Prepared, cfg: config.Forecast, metrics: DataFrame | None = None) -> dict[str, list[dict]]:
    """What the briefing tells: short lists of rows, one a horizon, channel or segment at most."""
    first = cfg.horizons[0]
    base = budget.baseline(simulate.expected(result.models, result.profile, p.origins, max(cfg.horizons)), result.models)
    channels = insights.channel_summary(result.nodes, p, first)
    ranked = budget.reallocation(response.fit_elasticity(p.segment_daily), base, first)
    tables = {
        "outlook": insights.outlook(result.nodes, p, result.models, result.profile, cfg.horizons), "channels": channels,
        "watch": insights.roas_watch(channels), "movers": insights.movers(result.models), "opportunities": insights.opportunities(ranked),
    }
    return {name: [r.asDict() for r in t.collect()] for name, t in tables.items()} | {"notes": insights.notes(p.origins, metrics)}


def write_briefing(found: dict[str, list[dict]], spark: SparkSession, path: str, polish: Callable[[str], str | None] | None = None) -> str:
    """``path``.md and ``path``.json; the text is returned."""
    text = insights.briefing(found, polish)
    write_text(spark, f"{path}.md", text)
    write_text(spark, f"{path}.json", json.dumps(found, indent=2, default=str))
    return text
