"""Budget scenarios: plans for every segment's daily spend, and what two runs differ by."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import response


@dataclass(frozen=True)
class Scenario:
    """The first that is set counts: multiplier, segment budgets, channel budgets, total."""

    horizon: int = 30
    multiplier: float | None = None
    segments: dict[str, float] = field(default_factory=dict)
    channels: dict[str, float] = field(default_factory=dict)
    total: float | None = None
    label: str = "scenario"


def baseline(expected: DataFrame, names: DataFrame) -> DataFrame:
    """(run_id, segment_key, platform, day, base): the expected spend path, above 0."""
    spend = expected.where("metric = 'spend'").select("run_id", "segment_key", "day", F.greatest("path", F.lit(1e-9)).alias("base"))
    return spend.join(names.select("run_id", "segment_key", "platform").distinct(), ["run_id", "segment_key"])


def overrides(base: DataFrame, scenario: Scenario) -> DataFrame:
    """(run_id, segment_key, platform, day, base, scale, plan). Scales are clipped to [0, 10]; untouched segments keep 1."""
    window = F.when(F.col("day") <= scenario.horizon, F.col("base"))
    over = lambda *keys: F.sum(window).over(Window.partitionBy("run_id", *keys))

    def of(budgets: dict[str, float], key: str):
        known = F.create_map(*[F.lit(x) for k, v in budgets.items() for x in (k, float(v))])
        return F.coalesce(F.try_element_at(known, F.col(key)) / F.nullif(over(key), F.lit(0.0)), F.lit(1.0))

    if scenario.multiplier is not None:
        scale = F.lit(float(scenario.multiplier))
    elif scenario.segments:
        scale = of(scenario.segments, "segment_key")
    elif scenario.channels:
        scale = of(scenario.channels, "platform")
    elif scenario.total is not None:
        scale = F.coalesce(F.lit(float(scenario.total)) / F.nullif(over(), F.lit(0.0)), F.lit(1.0))
    else:
        scale = F.lit(1.0)
    out = base.withColumn("scale", S.clip(scale, 0.0, 10.0))
    return out.withColumn("plan", F.col("base") * F.col("scale"))


def window_spend(plan: DataFrame, horizon: int) -> DataFrame:
    return plan.where(F.col("day") <= horizon).groupBy("run_id", "platform").agg(F.sum("base").alias("baseline_spend"), F.sum("plan").alias("planned_spend"))


def deltas(baseline_summary: DataFrame, scenario_summary: DataFrame) -> DataFrame:
    """Median revenue and spend of both runs by node, what the scenario adds, and revenue added per spend added."""
    keys = ["level", "channel", "campaign_type", "horizon"]

    def medians(summary: DataFrame, name: str) -> DataFrame:
        one = lambda m: F.max(F.when(F.col("metric") == m, F.col("p50")))
        return summary.groupBy(*keys).agg(one("revenue").alias(f"{name}_revenue"), one("spend").alias(f"{name}_spend"))

    out = medians(baseline_summary, "base").join(medians(scenario_summary, "new"), keys)
    out = out.withColumns({"d_revenue": F.col("new_revenue") - F.col("base_revenue"), "d_spend": F.col("new_spend") - F.col("base_spend")})
    return out.withColumn("incremental_roas", F.when(F.abs("d_spend") > 1e-6, F.col("d_revenue") / F.col("d_spend")))


def reallocation(fits: DataFrame, base: DataFrame, horizon: int = 30) -> DataFrame:
    """Segments by marginal return at their mean baseline spend, unknown ones last."""
    mean = base.where(F.col("day") <= horizon).groupBy("run_id", "segment_key").agg(F.avg("base").alias("spend"))
    at = response.response_curve(fits, mean)
    order = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("marginal_roas"), "segment_key")
    return at.withColumn("place", F.row_number().over(order))
