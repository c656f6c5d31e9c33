"""The queries of the reference's own operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import scalars as S
from .operators import backtest, budget, decompose, hierarchy, insights, model, prepare, reports, response, seasonality, simulate
from .oracles import ORACLES
from .oracles_draws import WATCHED
from .oracles_draws import oracles as drawn
from .plans import score as plans
from .sources import star

FLAGSHIP = "prediction_table"
#: Few draws of the same generator and paths, for what SQL draws again; all else takes production's.
FEW = config.Forecast(n_sims=40)
#: Interval scales by level (None: any other) and horizon, in place of a backtest's.
FEW_SCALES = {("channel", 30): 1.4, (None, 60): 1.2, ("campaign", 30): 0.8}
FULL = config.Forecast()
BACKTEST = config.Forecast(n_sims=config.BACKTEST_SIMS)


def _panel(spark: SparkSession, sf_dir: str, short: bool = False) -> DataFrame:
    return (star.short_panel if short else star.panel)(spark, sf_dir)


def _prepared(spark: SparkSession, sf_dir: str, short: bool = False) -> prepare.Prepared:
    return prepare.prepare(_panel(spark, sf_dir, short))


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def panel_canonical(spark, sf_dir):
    sums = [F.sum(m).cast("double").alias(m) for m in config.METRICS]
    days = _panel(spark, sf_dir).groupBy("platform", "campaign_id", "campaign_name", "channel_type_raw")
    return _rounded(days.agg(F.sum("n_rows").alias("n_rows"), *sums), 4, "spend", "revenue")


def panel_taxonomy(spark, sf_dir):
    keys = ["platform", "channel_type_raw", "campaign_name", "campaign_type", "brand_intent", "segment_key", "campaign_uid"]
    return prepare.add_taxonomy(_panel(spark, sf_dir)).groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))


def brand_mix(spark, sf_dir):
    rows = prepare.add_taxonomy(_panel(spark, sf_dir)).groupBy("platform", "brand_intent")
    return _rounded(rows.agg(F.sum("spend").cast("double").alias("spend"), F.sum("revenue").cast("double").alias("revenue")), 4, "spend", "revenue")


def active_series_per_day(spark, sf_dir):
    return prepare.active_series(prepare.with_run(_panel(spark, sf_dir))).select("date", "n", "typical")


def ragged_edge_trim(spark, sf_dir):
    return prepare.trim_edge(prepare.with_run(_panel(spark, sf_dir))).select("cutoff", "origin", F.col("dropped").cast("long").alias("dropped"))


def segment_daily_dense(spark, sf_dir, short=False):
    rows = _prepared(spark, sf_dir, short).segment_daily
    return _rounded(rows.select("segment_key", "date", *config.METRICS), 4, "spend", "revenue")


def campaign_daily_dense(spark, sf_dir):
    rows = _prepared(spark, sf_dir).campaign_daily.groupBy("campaign_uid", F.trunc("date", "month").alias("month"))
    return _rounded(rows.agg(F.count(F.lit(1)).alias("days"), F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue")), 4, "spend", "revenue")


def campaign_meta_shares(spark, sf_dir):
    meta = _prepared(spark, sf_dir).meta.select(
        "campaign_uid", "segment_key", "campaign_name", "total_spend", "total_revenue", "n_days", "first_day", "last_day", "last_active_day",
        "recent_spend", "recent_revenue", "rev_share", "spend_share", F.col("days_since_active").cast("long").alias("days_since_active"),
    )
    return _rounded(_rounded(meta, 4, "total_spend", "total_revenue", "recent_spend", "recent_revenue"), 6, "rev_share", "spend_share")


def top_campaigns_per_segment(spark, sf_dir):
    return prepare.top_campaigns(_prepared(spark, sf_dir).meta, 5).select("segment_key", F.col("place").cast("long").alias("place"), "campaign_uid", F.round("recent_revenue", 4).alias("recent_revenue"))


def _dates(spark: SparkSession) -> DataFrame:
    return spark.sql("select explode(sequence(date'2018-01-01', date'2027-12-31')) as date")


def calendar_events(spark, sf_dir):
    name = S.event_name(F.col("date"))
    flags = [(name == e).alias(e) for e, _, _ in config.EVENTS]
    return _dates(spark).select("date", name.alias("event_name"), S.event_uplift(name).alias("event_uplift_prior"), *flags)


def calendar_frame(spark, sf_dir):
    d = F.col("date")
    return _dates(spark).select(
        "date", F.month(d).alias("month"), F.weekday(d).alias("dow"), F.dayofyear(d).alias("doy"), F.weekofyear(d).alias("iso_week"), F.year(d).alias("year"),
        S.thanksgiving(F.year(d)).alias("thanksgiving"),
    )


def us_holidays(spark, sf_dir):
    return _dates(spark).where(S.us_holiday(F.col("date")))


def window_events(spark, sf_dir):
    """Which events fall within 90 days after each month's first day."""
    starts = _dates(spark).where(F.dayofmonth("date") == 1)
    days = starts.select(F.col("date").alias("start"), F.explode(F.sequence("date", F.date_add("date", 89))).alias("date"))
    name = S.event_name(F.col("date"))
    labels = [F.max(F.when(name == e, label)) for e, _, label in config.EVENTS]
    return days.groupBy("start").agg(F.concat_ws(", ", *labels).alias("events"))


def _series(spark, sf_dir, short=False) -> DataFrame:
    return seasonality.long_metrics(_prepared(spark, sf_dir, short).segment_daily)


def seasonal_profile(spark, sf_dir, kind):
    rows = seasonality.profiles(_series(spark, sf_dir)).where(F.col("kind") == kind)
    return _rounded(rows.select("segment_key", "metric", F.col("slot").cast("int").alias("slot"), "factor"), 6, "factor")


def pooled_prior(spark, sf_dir):
    rows = model.fit_priors(_prepared(spark, sf_dir)).seasonal.where("scope not like '%::%'")
    return _rounded(rows.select("scope", "metric", "kind", F.col("slot").cast("int").alias("slot"), "factor"), 5, "factor")


def _segments(spark, sf_dir, short=False):
    p = _prepared(spark, sf_dir, short)
    return p, *model.build_segments(p, model.fit_priors(p))


def blended_profile(spark, sf_dir):
    rows = _segments(spark, sf_dir)[2]
    return _rounded(rows.select("segment_key", "metric", "kind", F.col("slot").cast("int").alias("slot"), "factor"), 5, "factor")


def decomposition(spark, sf_dir, short=False):
    rows = _segments(spark, sf_dir, short)[1]
    values = ["level", "level_log_sigma", "growth_annual", "growth_sigma", "resid_log_sigma", "mean_value"]
    return _rounded(rows.select("segment_key", "metric", *values, F.size("resid_block").alias("block"), "n_days", "n_positive", "sparse"), 4, *values)


def decomposition_flat(spark, sf_dir, short=False):
    """Level and spread without a season, which SQL can follow."""
    rows = decompose.decompose(_series(spark, sf_dir, short).withColumn("season", F.lit(1.0)))
    values = ["level", "level_log_sigma", "growth_annual", "growth_sigma", "resid_log_sigma", "mean_value"]
    return _rounded(rows.select("segment_key", "metric", *values, "n_days", "n_positive", "sparse"), 4, *values)


def elasticity_fit(spark, sf_dir):
    rows = response.fit_elasticity(_prepared(spark, sf_dir).segment_daily)
    return _rounded(rows.select("segment_key", "beta", "scale", "n", "r2", "spend_ref", "revenue_ref"), 4, "beta", "scale", "r2", "spend_ref", "revenue_ref")


def response_curve(spark, sf_dir):
    fits = response.fit_elasticity(_prepared(spark, sf_dir).segment_daily)
    rows = response.response_curve(fits, response.spend_grid(fits)).drop("run_id")
    return _rounded(rows, 3, "spend", "revenue", "average_roas", "marginal_roas")


def growth_multiplier_table(spark, sf_dir):
    grid = spark.range(1, 366).select(F.col("id").cast("double").alias("day"), F.explode(F.array(*[F.lit(g / 10) for g in range(-6, 10)])).alias("growth"))
    return grid.select("day", "growth", F.round(S.growth_multiplier(F.col("day"), F.col("growth")), 6).alias("multiplier"))


def response_multiplier_table(spark, sf_dir):
    spends = F.array(*[F.lit(float(x)) for x in (-1, 0, 1, 50, 100, 200, 1000)])
    grid = spark.range(1).select(F.explode(spends).alias("spend")).select("spend", F.explode(spends).alias("base"))
    grid = grid.select("*", F.explode(F.array(F.lit(0.15), F.lit(0.65), F.lit(1.05))).alias("beta"))
    m, z = (S.response_multiplier(F.col("spend"), F.col("base"), F.col("beta"), z) for z in (False, True))
    return grid.select("spend", "base", "beta", F.round(m, 6).alias("multiplier"), F.round(z, 6).alias("strict"))


def expected_spend_path(spark, sf_dir):
    p, models, profile, _ = _segments(spark, sf_dir)
    rows = simulate.expected(models, profile, p.origins, 90).where("metric = 'spend'")
    return _rounded(rows.select("segment_key", "day", "path"), 3, "path")


def marginal_roas_rank(spark, sf_dir):
    p, models, profile, _ = _segments(spark, sf_dir)
    base = budget.baseline(simulate.expected(models, profile, p.origins, 90), models)
    rows = budget.reallocation(response.fit_elasticity(p.segment_daily), base)
    return _rounded(rows.select("segment_key", "place", "spend", "marginal_roas"), 4, "spend", "marginal_roas")


def rng_normals_md5(spark, sf_dir):
    """What a stream of the simulation's generator, keyed by MD5, holds for each segment."""
    keys = _prepared(spark, sf_dir).segment_daily.select("run_id", "segment_key")
    return _rounded(simulate.segment_normals(keys, FEW, "check", 10).drop("run_id"), 8, "z")


def macro_shock_md5(spark, sf_dir):
    """The common shock that every segment's paths take."""
    return _rounded(simulate.shocks(_prepared(spark, sf_dir).origins, FEW, 90).drop("run_id"), 8, "shock")


def _few_work(spark, sf_dir):
    p, models, profile, betas = _segments(spark, sf_dir)
    return p, models, profile, simulate.simulate(models, profile, betas, p.origins, FEW)


def mc_periods_few(spark, sf_dir):
    rows = simulate.periods(_few_work(spark, sf_dir)[3], FEW)
    return _rounded(rows.select("segment_key", "sim", "horizon", "revenue", "spend"), 2, "revenue", "spend")


def cumulative_fan_few(spark, sf_dir):
    rows = simulate.cumulative_fan(_few_work(spark, sf_dir)[3], FEW).drop("run_id")
    return _rounded(rows, 2, *[c for c in rows.columns if c != "day"])


def _few_score(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    scales = spark.createDataFrame([(level, h, s) for (level, h), s in FEW_SCALES.items()], "level string, horizon int, scale double")
    return p, plans.score(p, plans.replace_scales(model.fit_priors(p), scales), FEW)


def prediction_table_few(spark, sf_dir):
    rows = _few_score(spark, sf_dir)[1].predictions.drop("run_id")
    return _rounded(rows, 2, "mean", "std", *[c for c in rows.columns if c[:1] == "p" and c[1:].isdigit()])


def budget_deltas_few(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    cfg = config.Forecast(n_sims=FEW.n_sims, horizons=(30,))
    first, second = plans.what_if(p, model.fit_priors(p), budget.Scenario(30, channels={"meta": 5000.0}), cfg)
    rows = budget.deltas(first.summary.where("level <> 'campaign'"), second.summary.where("level <> 'campaign'"))
    return _rounded(_rounded(rows, 2, *[c for c in rows.columns if c.endswith(("_revenue", "_spend"))]), 4, "incremental_roas")


def channel_summary_few(spark, sf_dir):
    p, result = _few_score(spark, sf_dir)
    rows = insights.channel_summary(result.nodes, p, 30).drop("run_id")
    return _rounded(_rounded(rows, 2, "p50", "roas", "trailing_revenue", "trailing_roas"), 5, "change")


def roas_watch_few(spark, sf_dir):
    """The forecast's watch list at a threshold that some channels are below."""
    p, result = _few_score(spark, sf_dir)
    return _rounded(insights.roas_watch(insights.channel_summary(result.nodes, p, 30), WATCHED).select("channel", "roas"), 2, "roas")


def outlook_few(spark, sf_dir):
    p, result = _few_score(spark, sf_dir)
    rows = insights.outlook(result.nodes, p, result.models, result.profile, config.HORIZONS).drop("run_id")
    effects = ["total", "season", "trend", "spend_and_mix", "interval_width"]
    return _rounded(_rounded(rows, 2, "p10", "p50", "p90", "roas", "spend", "trailing_revenue", "trailing_roas"), 5, *effects)


def top_campaigns_few(spark, sf_dir):
    """The dashboard's 15 largest campaigns of the next 30 days."""
    rows = reports.largest(_few_score(spark, sf_dir)[1].predictions, "campaign", 30, 15).drop("run_id")
    return _rounded(rows, 2, "p10", "p50", "p90", "roas")


def top_types_few(spark, sf_dir):
    """The dashboard's 10 largest channel and type pairs of the next 30 days."""
    rows = reports.largest(_few_score(spark, sf_dir)[1].predictions, "campaign_type", 30, 10)
    return _rounded(rows.select("place", "channel", "campaign_type", "p50"), 2, "p50")


def waterfall_few(spark, sf_dir):
    p, result = _few_score(spark, sf_dir)
    rows = reports.waterfall(insights.outlook(result.nodes, p, result.models, result.profile, config.HORIZONS)).drop("run_id")
    return _rounded(rows, 3, "change", "reached")


def completeness_few(spark, sf_dir):
    """Nulls in the scored table, and rows that are 0 throughout."""
    return reports.completeness(_few_score(spark, sf_dir)[1].predictions).drop("run_id")


def elasticity_priors(spark, sf_dir):
    """The elasticities that short segments fall back on: their type's, and all segments'."""
    rows = model.fit_priors(_prepared(spark, sf_dir)).elasticity.where("scope not like '%::%'")
    return _rounded(rows.select("scope", "beta", F.col("n").cast("long").alias("n")), 6, "beta")


def residual_blocks(spark, sf_dir):
    """The residuals that simulations draw blocks of."""
    rows = _segments(spark, sf_dir)[1].select("segment_key", "metric", F.posexplode("resid_block").alias("place", "residual"))
    return _rounded(rows, 5, "residual")


def _score(spark, sf_dir, short=False):
    """The forecast with intervals calibrated by the backtest."""
    p = _prepared(spark, sf_dir, short)
    return p, plans.score(p, plans.train(p, BACKTEST), FULL)


def mc_periods(spark, sf_dir):
    p, models, profile, betas = _segments(spark, sf_dir)
    rows = simulate.periods(simulate.simulate(models, profile, betas, p.origins, FULL), FULL)
    return _rounded(rows.select("segment_key", "sim", "horizon", "revenue", "spend"), 4, "revenue", "spend")


def hierarchy_rollup(spark, sf_dir):
    """The hierarchy over months in place of simulations: the same grouping sets, on observed sums."""
    d = _prepared(spark, sf_dir).segment_daily.withColumns({"sim": F.year("date") * 12 + F.month("date"), "horizon": F.lit(30)})
    keys = ["run_id", "segment_key", "platform", "campaign_type", "sim", "horizon"]
    rows = hierarchy.reconcile(d.groupBy(*keys).agg(F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend")))
    return _rounded(_rounded(rows.select("level", "channel", "campaign_type", "sim", "revenue", "spend", "roas"), 4, "revenue", "spend"), 4, "roas")


def conformal_summary(spark, sf_dir):
    """Calibrated quantiles of monthly sums by node: the summary step on observed numbers."""
    d = _prepared(spark, sf_dir).segment_daily.withColumns({"sim": F.year("date") * 12 + F.month("date"), "horizon": F.lit(30)})
    keys = ["run_id", "segment_key", "platform", "campaign_type", "sim", "horizon"]
    nodes = hierarchy.reconcile(d.groupBy(*keys).agg(F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))).where("level in ('aggregate', 'channel')")
    scales = spark.createDataFrame([("channel", 30, 1.4), (None, 30, 1.2)], "level string, horizon int, scale double")
    rows = hierarchy.summarise(nodes, scales)
    values = ["mean", "std", "p05", "p10", "p25", "p50", "p75", "p90", "p95"]
    return _rounded(rows.select("level", "channel", "metric", *values), 3, *values)


def prediction_table(spark, sf_dir, short=False):
    return _score(spark, sf_dir, short=short)[1].predictions.drop("run_id")


def cumulative_fan(spark, sf_dir):
    p, models, profile, betas = _segments(spark, sf_dir)
    return simulate.cumulative_fan(simulate.simulate(models, profile, betas, p.origins, FULL), FULL).drop("run_id")


def backtest_origins(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return backtest.origins(p.panel, p.origins).select("origin")


def backtest_actual_windows(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    rows = backtest.actuals(p.panel, backtest.origins(p.panel, p.origins))
    return _rounded(rows.select(F.col("run_id").cast("date").alias("origin"), "horizon", "level", "channel", "actual"), 4, "actual")


def _records(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return plans.calibrate(p, model.fit_priors(p), BACKTEST)


def backtest_metrics(spark, sf_dir):
    return backtest.metrics(_records(spark, sf_dir))


def conformal_scales(spark, sf_dir):
    return backtest.scales(_records(spark, sf_dir))


def budget_plan(spark, sf_dir, scenario):
    p, models, profile, _ = _segments(spark, sf_dir)
    base = budget.baseline(simulate.expected(models, profile, p.origins, 90), models)
    return _rounded(budget.window_spend(budget.overrides(base, scenario), scenario.horizon).drop("run_id"), 4, "baseline_spend", "planned_spend")


def budget_deltas(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    scenario = budget.Scenario(30, channels={"meta": 5000.0})
    first, second = plans.what_if(p, plans.train(p, BACKTEST), scenario, config.Forecast(horizons=(30,)))
    return budget.deltas(first.summary.where("level <> 'campaign'"), second.summary.where("level <> 'campaign'"))


def trailing_actuals(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return _rounded(_rounded(insights.trailing_actuals(p.panel, p.origins, 30).drop("run_id"), 4, "revenue", "spend"), 4, "roas")


def trailing_roas_watch(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return insights.roas_watch(insights.trailing_actuals(p.panel, p.origins, 30), 25.0).select("channel")


def roas_watch(spark, sf_dir):
    p, result = _score(spark, sf_dir)
    return insights.roas_watch(insights.channel_summary(result.nodes, p, 30)).select("channel", "roas")


def outlook(spark, sf_dir):
    """The briefing's numbers: quantiles of the total, trailing actuals, attributed change, events ahead."""
    p, result = _score(spark, sf_dir)
    return insights.outlook(result.nodes, p, result.models, result.profile, config.HORIZONS).drop("run_id")


def seasonal_index(spark, sf_dir):
    p, models, profile, _ = _segments(spark, sf_dir)
    rows = insights.seasonal_index(p, models, profile, config.HORIZONS).join(insights.trend_index(models, config.HORIZONS), ["run_id", "horizon"])
    return _rounded(rows.select("horizon", "season_next", "season_last", "growth"), 5, "season_next", "season_last", "growth")


def movers(spark, sf_dir):
    return _rounded(insights.movers(_segments(spark, sf_dir)[1]).drop("run_id"), 4, "growth_annual", "level")


def channel_summary(spark, sf_dir):
    p, result = _score(spark, sf_dir)
    return insights.channel_summary(result.nodes, p, 30).drop("run_id")


def opportunities(spark, sf_dir):
    p, models, profile, _ = _segments(spark, sf_dir)
    base = budget.baseline(simulate.expected(models, profile, p.origins, 90), models)
    return insights.opportunities(budget.reallocation(response.fit_elasticity(p.segment_daily), base)).select("action", "place", "segment_key")


def queries() -> dict:
    plain = (
        panel_canonical, panel_taxonomy, brand_mix, active_series_per_day, ragged_edge_trim, segment_daily_dense, campaign_daily_dense,
        campaign_meta_shares, top_campaigns_per_segment, calendar_events, calendar_frame, us_holidays, window_events, pooled_prior, blended_profile,
        decomposition, decomposition_flat, elasticity_fit, response_curve, growth_multiplier_table, response_multiplier_table,
        expected_spend_path, marginal_roas_rank, rng_normals_md5, macro_shock_md5, mc_periods_few, cumulative_fan_few,
        prediction_table_few, budget_deltas_few, channel_summary_few, roas_watch_few, outlook_few,
        top_campaigns_few, top_types_few, waterfall_few, completeness_few, elasticity_priors, residual_blocks, mc_periods, hierarchy_rollup, conformal_summary,
        prediction_table, cumulative_fan, backtest_origins, backtest_actual_windows, backtest_metrics, conformal_scales, budget_deltas,
        trailing_actuals, trailing_roas_watch, roas_watch, outlook, seasonal_index, movers, channel_summary, opportunities,
    )
    scenarios = {
        "multiplier": budget.Scenario(30, multiplier=1.3), "channel": budget.Scenario(30, channels={"meta": 5000.0}),
        "total": budget.Scenario(60, total=20000.0), "segment": budget.Scenario(30, segments={"google::Search": 900.0}),
    }
    found = {f.__name__: f for f in plain}
    found |= {f"budget_{k}": partial(budget_plan, scenario=s) for k, s in scenarios.items()}
    found |= {f"seasonal_{k}_profile": partial(seasonal_profile, kind=k) for k in ("week", "dow")}
    found |= {f"{f.__name__}_short": partial(f, short=True) for f in (segment_daily_dense, decomposition_flat, prediction_table)}
    return found


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES) | drawn(FEW.n_sims, FEW_SCALES)
