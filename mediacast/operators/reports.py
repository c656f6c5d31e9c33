"""Tables that a dashboard shows of a finished score: the largest nodes, the steps of the change, and what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config

EFFECTS = ("season", "trend", "spend_and_mix")
VALUES = ("mean", "std", *[f"p{round(100 * q):02d}" for q in config.QUANTILES])


def largest(predictions: DataFrame, level: str, horizon: int, k: int) -> DataFrame:
    """(run_id, place, node's names, p10, p50, p90, roas): a run's ``k`` nodes of ``level`` with the highest median revenue.

    Types over several channels take no part, as their channels' do; equal medians go by name. Rows of a
    metric meet by node, and each task keeps its best ``k`` before they meet.
    """
    names = ["channel", "campaign_type", "campaign_id", "campaign_name"]
    own = (F.col("level") == level) & (F.col("horizon_days") == horizon)
    own = own & ((F.col("channel") != "blended") if level != "aggregate" else F.lit(True))
    of = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    rows = predictions.where(own & F.col("metric").isin("revenue", "roas")).groupBy("run_id", *names)
    found = rows.agg(*[of("revenue", c).alias(c) for c in ("p10", "p50", "p90")], of("roas", "p50").alias("roas"))
    best = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("p50"), *names)
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def waterfall(outlook: DataFrame) -> DataFrame:
    """(run_id, horizon, place, effect, change, reached): the effects of ``insights.outlook`` in per cent, in their order, and their running sum; an unknown one is 0."""
    steps, reached = [], F.lit(0.0)
    for place, name in enumerate(EFFECTS, 1):
        change = 100 * F.coalesce(name, F.lit(0.0))
        reached = reached + change
        steps.append(F.struct(F.lit(place).alias("place"), F.lit(name).alias("effect"), change.alias("change"), reached.alias("reached")))
    return outlook.select("run_id", "horizon", F.inline(F.array(*steps)))


def completeness(predictions: DataFrame) -> DataFrame:
    """(run_id, level, metric, rows, nulls, idle): of the scored table, rows, cells that are null or not a number, and rows without any spend or revenue in view (all quantiles 0)."""
    missing = sum(F.col(c).isNull().cast("long") for c in config.PREDICTION_COLUMNS) + sum(F.coalesce(F.isnan(c), F.lit(False)).cast("long") for c in VALUES)
    # Null where a value is null, as such a row isn't known to be idle.
    idle = F.coalesce(reduce(Column.__and__, [F.col(c) == 0 for c in VALUES]), F.lit(False))
    return predictions.groupBy("run_id", "level", "metric").agg(F.count(F.lit(1)).alias("rows"), F.sum(missing).alias("nulls"), F.sum(idle.cast("long")).alias("idle"))
