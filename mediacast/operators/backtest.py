"""Rolling-origin backtest and interval calibration: every origin is a run of one batched plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S


def origins(panel: DataFrame, origin: DataFrame) -> DataFrame:
    """(run_id, origin): from 90 days before the score's origin back by 30 days, at most 8, with 180 days of history each."""
    span = panel.agg(F.min("date").alias("first")).join(origin.select(F.col("origin").alias("last")))
    steps = F.sequence(F.lit(0), F.lit(config.BACKTEST_ORIGINS - 1))
    back = max(config.HORIZONS)
    at = span.select("first", F.explode(F.transform(steps, lambda k: F.date_sub("last", (k * config.BACKTEST_STEP + back).cast("int")))).alias("origin"))
    return at.where(F.datediff("origin", "first") >= config.BACKTEST_HISTORY).select(F.col("origin").cast("string").alias("run_id"), "origin")


def actuals(panel: DataFrame, runs: DataFrame, horizons: tuple[int, ...] = config.HORIZONS) -> DataFrame:
    """(run_id, horizon, level, channel, actual): revenue of the days after each origin, in total and by channel."""
    by_day = panel.groupBy("date", "platform").agg(F.sum("revenue").cast("double").alias("revenue"))
    span = by_day.join(F.broadcast(runs), (F.col("date") > F.col("origin")) & (F.col("date") <= F.date_add("origin", max(horizons))))
    span = span.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).where(F.col("date") <= F.date_add("origin", F.col("horizon")))
    sets = [[F.col("run_id"), F.col("horizon")], [F.col("run_id"), F.col("horizon"), F.col("platform")]]
    out = span.groupingSets(sets, F.col("run_id"), F.col("horizon"), F.col("platform")).agg(F.sum("revenue").alias("actual"), F.grouping("platform").alias("g"))
    level = F.when(F.col("g") == 1, "aggregate").otherwise("channel")
    return out.select("run_id", "horizon", level.alias("level"), F.when(F.col("g") == 1, "blended").otherwise(F.col("platform")).alias("channel"), "actual")


def records(nodes: DataFrame, actual: DataFrame) -> DataFrame:
    """Scores of the raw forecast distributions; pairs without a positive median, actual or width are left out."""
    shares = F.percentile("revenue", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    forecast = nodes.where("level in ('aggregate', 'channel')").groupBy("run_id", "level", "channel", "horizon").agg(shares.alias("q"))
    forecast = forecast.select("run_id", "level", "channel", "horizon", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))
    both = forecast.join(actual, ["run_id", "level", "channel", "horizon"]).where("median > 0 and actual > 0 and p90 > p10")
    low = F.greatest("p10", F.lit(1e-9))
    return both.withColumns({
        "score": F.abs(F.log(F.col("actual") / F.col("median"))), "halfwidth_log": (F.log("p90") - F.log(low)) / 2,
        "in80": F.col("actual").between(F.col("p10"), F.col("p90")), "ape": F.abs(F.col("actual") - F.col("median")) / F.col("actual"),
    })


def scales(found: DataFrame) -> DataFrame:
    """(level, horizon, scale): the 80 % quantile of score over half-width, clipped to [0.5, 3]; 4 records at least.

    A type's intervals are a tenth wider than a channel's, a campaign's a quarter; level null is the total's.
    """
    ratio = F.when(F.col("halfwidth_log") > 0, F.col("score") / F.col("halfwidth_log"))
    by = found.groupBy("level", "horizon").agg(F.percentile(ratio, F.lit(0.8)).alias("q"), F.count(ratio).alias("n"))
    own = by.select("level", "horizon", F.when(F.col("n") >= 4, S.clip(F.col("q"), 0.5, 3.0)).otherwise(1.0).alias("scale"))
    wider = lambda name, factor: own.where("level = 'channel'").select(F.lit(name).alias("level"), "horizon", (F.col("scale") * factor).alias("scale"))
    every = own.where("level = 'aggregate'").select(F.lit(None).cast("string"), "horizon", "scale")
    return own.union(wider("campaign_type", 1.10)).union(wider("campaign", 1.25)).union(every)


def metrics(found: DataFrame) -> DataFrame:
    """Per horizon of the total: records, mean and median error and coverage in per cent, to one decimal."""
    total = found.where("level = 'aggregate'").groupBy("horizon")
    return total.agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("ape"), 1).alias("mape"), F.round(100 * F.median("ape"), 1).alias("median_ape"),
        F.round(100 * F.avg(F.col("in80").cast("int")), 1).alias("coverage"),
    )
