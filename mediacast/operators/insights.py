"""Facts for the briefing: actuals, change attribution, movers, warnings; and their text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import scalars as S
from .prepare import Prepared
from .seasonality import factor_for_dates

#: A 90 % quantile more than this above the 10 % one, as a share of it, is a wide range.
WIDE = 1.2


def trailing_actuals(panel: DataFrame, origins: DataFrame, days: int) -> DataFrame:
    """(run_id, channel, revenue, spend, roas) of the last ``days`` days, by channel and in all."""
    recent = panel.join(F.broadcast(origins.select("run_id", "origin")), "run_id").where((F.col("date") <= F.col("origin")) & (F.col("date") > F.date_sub("origin", days)))
    sets = [[F.col("run_id")], [F.col("run_id"), F.col("platform")]]
    out = recent.groupingSets(sets, F.col("run_id"), F.col("platform")).agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("spend").cast("double").alias("spend"))
    return out.select("run_id", F.coalesce("platform", F.lit("blended")).alias("channel"), "revenue", "spend", S.roas(F.col("revenue"), F.col("spend")).alias("roas"))


def seasonal_index(p: Prepared, models: DataFrame, profile: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(run_id, horizon, season_next, season_last): mean revenue season of the days after and before the origin, weighted by level."""
    keys = models.where("metric = 'revenue'").select("run_id", "segment_key", "metric", F.greatest("level", F.lit(0.0)).alias("weight"))
    dated = keys.join(F.broadcast(p.origins.select("run_id", "origin")), "run_id")
    reach = max(horizons)
    days = dated.select("*", F.explode(F.sequence(F.lit(1 - reach), F.lit(reach))).alias("day"))
    days = factor_for_dates(days.withColumn("date", F.date_add("origin", F.col("day"))), profile)
    days = days.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).where("day between 1 - horizon and horizon")
    mean = lambda test: F.try_divide(F.sum(F.when(test, F.col("weight") * F.col("season"))), F.sum(F.when(test, F.col("weight"))))
    return days.groupBy("run_id", "horizon").agg(mean(F.col("day") >= 1).alias("season_next"), mean(F.col("day") < 1).alias("season_last"))


def trend_index(models: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(run_id, horizon, growth): mean growth multiplier over the horizon's days, weighted by level; 1 without a level above 0."""
    rows = models.where("metric = 'revenue' and level > 0").select("run_id", "level", "growth_annual")
    rows = rows.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("horizon"))).alias("day"))
    growth = S.growth_multiplier(F.col("day").cast("double"), F.col("growth_annual"))
    return rows.groupBy("run_id", "horizon").agg((F.sum(growth * F.col("level")) / F.sum("level")).alias("growth"))


def _change(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b) - 1)


def attribution(forecast: DataFrame, actual: DataFrame, season: DataFrame, trend: DataFrame) -> DataFrame:
    """The forecast's change over the trailing period as effects: season, trend, and what is left to spend and mix.

    All are keyed by run and horizon. In logs the three add up to the total; null where one is unknown.
    """
    out = forecast.join(actual, ["run_id", "horizon"], "left").join(season, ["run_id", "horizon"], "left").join(trend, ["run_id", "horizon"], "left")
    out = out.withColumns({
        "total": _change("p50", "trailing_revenue"), "season": _change("season_next", "season_last"), "trend": F.coalesce("growth", F.lit(1.0)) - 1,
    })
    rest = F.expm1(F.log1p("total") - F.log1p("season") - F.log1p("trend"))
    return out.withColumns({"spend_and_mix": rest, "interval_width": _change("p90", "p10")}).drop("season_next", "season_last", "growth")


def outlook(nodes: DataFrame, p: Prepared, models: DataFrame, profile: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """A row for each run and horizon: the total's raw quantiles, trailing actuals, attributed change and the events ahead."""
    at = lambda c, q: F.percentile(c, F.lit(q))
    total = nodes.where("level = 'aggregate'").groupBy("run_id", "horizon").agg(
        at("revenue", 0.1).alias("p10"), at("revenue", 0.5).alias("p50"), at("revenue", 0.9).alias("p90"), at("roas", 0.5).alias("roas"), at("spend", 0.5).alias("spend")
    )
    trailing = _trailing_by_horizon(p, horizons).where("channel = 'blended'").drop("channel")
    out = attribution(total, trailing, seasonal_index(p, models, profile, horizons), trend_index(models, horizons))
    ahead = p.origins.select("run_id", "origin", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    ahead = ahead.select("run_id", "horizon", F.explode(F.sequence(F.date_add("origin", 1), F.date_add("origin", F.col("horizon")))).alias("date"))
    name = S.event_name(F.col("date"))
    events = F.concat_ws(", ", *[F.max(F.when(name == e, label)) for e, _, label in config.EVENTS])
    return out.join(ahead.groupBy("run_id", "horizon").agg(events.alias("events")), ["run_id", "horizon"], "left")


def _trailing_by_horizon(p: Prepared, horizons: tuple[int, ...]) -> DataFrame:
    out = None
    for h in horizons:
        one = trailing_actuals(p.panel, p.origins, h).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out.select("run_id", "horizon", "channel", F.col("revenue").alias("trailing_revenue"), F.col("roas").alias("trailing_roas"))


def movers(models: DataFrame, k: int = 4, least: float = 0.05) -> DataFrame:
    """Up to ``k`` segments growing, and declining, by more than 5 % a year."""
    rows = models.where("metric = 'revenue' and level > 0").select("run_id", "segment_key", "growth_annual", "level")
    up = Window.partitionBy("run_id").orderBy(F.desc("growth_annual"), "segment_key")
    down = Window.partitionBy("run_id").orderBy("growth_annual", "segment_key")
    rank = lambda w, test, name: rows.where(test).withColumns({"direction": F.lit(name), "place": F.row_number().over(w)}).where(F.col("place") <= k)
    return rank(up, F.col("growth_annual") > least, "growing").union(rank(down, F.col("growth_annual") < -least, "declining"))


def channel_summary(nodes: DataFrame, p: Prepared, horizon: int) -> DataFrame:
    """(run_id, channel, p50, roas, trailing_revenue, trailing_roas, change) of the raw draws, the largest first."""
    rows = nodes.where((F.col("level") == "channel") & (F.col("horizon") == horizon)).groupBy("run_id", "channel")
    found = rows.agg(F.percentile("revenue", F.lit(0.5)).alias("p50"), F.percentile("roas", F.lit(0.5)).alias("roas"))
    trailing = _trailing_by_horizon(p, (horizon,)).drop("horizon")
    out = found.join(trailing, ["run_id", "channel"], "left").withColumn("change", _change("p50", "trailing_revenue"))
    return out.orderBy(F.desc("p50"), "channel")


def roas_watch(channels: DataFrame, least: float = 2.0) -> DataFrame:
    return channels.where(F.col("roas") < least)


def opportunities(ranked: DataFrame) -> DataFrame:
    """The three best segments to scale and the two to review, of those with a known marginal return; with few segments one may be both."""
    known = ranked.where("marginal_roas is not null")
    last = known.withColumn("from_end", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("place"))))
    return last.where("place <= 3").withColumn("action", F.lit("scale_up")).union(last.where("from_end <= 2").withColumn("action", F.lit("review"))).drop("from_end")


def money(x: float | None) -> str:
    return "n/a" if x is None else f"${x:,.0f}"


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:+.0f}%"


def briefing(facts: dict[str, list[dict]], polish: Callable[[str], str | None] | None = None) -> str:
    """Markdown of collected facts (short lists of rows); ``polish`` may rewrite it, and None keeps the draft."""
    ahead = sorted(facts.get("outlook", []), key=lambda r: r["horizon"])
    lines = lambda rows, text: "\n".join(f"- {text(r)}" for r in rows) or "- none"
    told = lambda r: f"{r['horizon']} days: revenue of {money(r['p50'])} ({money(r['p10'])} to {money(r['p90'])}), return {ratio(r['roas'])}"
    parts = ["## Outlook\n\n" + (lines(ahead, told) if ahead else "No forecast.")]
    if any((r["interval_width"] or 0) > WIDE for r in ahead):
        parts[0] += "\n\nThe range is wide."
    effects = lambda r: f"{percent(r['total'])} on the last {r['horizon']} days: season {percent(r['season'])}, trend {percent(r['trend'])}, spend and mix {percent(r['spend_and_mix'])}"
    parts.append("## Drivers\n\n" + lines(ahead, lambda r: effects(r) + main_driver(r) + (f"; ahead: {r['events']}" if r["events"] else "")))
    parts.append("## Channels\n\n" + lines(facts.get("channels", []), lambda r: f"{r['channel']}: {money(r['p50'])} ({percent(r['change'])}), return {ratio(r['roas'])}"))
    parts.append("## Movers\n\n" + lines(facts.get("movers", []), lambda r: f"{r['segment_key']} {r['direction']}, {percent(r['growth_annual'])} a year"))
    watch = lines(facts.get("watch", []), lambda r: f"watch {r['channel']}: return {ratio(r['roas'])}")
    parts.append("## Actions\n\n" + lines(facts.get("opportunities", []), lambda r: f"{r['action']}: {r['segment_key']}, next dollar returns {ratio(r['marginal_roas'])}") + "\n" + watch)
    parts.append("## Data\n\n" + lines(facts.get("notes", []), lambda r: r["note"]))
    draft = "\n\n".join(parts) + "\n"
    return (polish and polish(draft)) or draft


def ratio(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.2f}x"


def main_driver(row: dict) -> str:
    """The effect that is largest either way."""
    known = {k: row[k] for k in ("season", "trend", "spend_and_mix") if row[k] is not None}
    return f"; mostly {max(known, key=lambda k: abs(known[k])).replace('_', ' ')}" if known else ""


def notes(origins: DataFrame, metrics: DataFrame | None = None) -> list[dict]:
    """Data-quality notes: days trimmed from the end, and how often past intervals held."""
    out = [{"note": f"{r['dropped']} incomplete day(s) at the end were left out, from {r['cutoff']} on."} for r in origins.where("dropped > 0").collect()]
    held = sorted(metrics.collect(), key=lambda r: r["horizon"]) if metrics is not None else []
    if held:
        out.append({"note": "Past 80 % intervals held: " + ", ".join(f"{r['horizon']} days {r['coverage']:.0f} %" for r in held) + "."})
    return out
