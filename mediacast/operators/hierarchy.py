"""The coherent hierarchy: total, channel, campaign type, campaign; calibrated quantiles of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import scalars as S
from ..functions.stage import cut

NODE = ["run_id", "level", "channel", "campaign_type", "campaign_id", "campaign_name"]
METRICS = ["revenue", "spend", "roas"]
#: Ranges in which a node's draws are counted.
BINS = 256


def reconcile(period: DataFrame) -> DataFrame:
    """Node rows (NODE, horizon, sim, revenue, spend, roas) down to the type, by one pass of grouping sets.

    A type across channels is a node only if more than one channel has it.
    """
    sets = [[], ["platform"], ["platform", "campaign_type"], ["campaign_type"]]
    base = [F.col("run_id"), F.col("horizon"), F.col("sim")]
    summed = period.groupingSets(
        [[*base, *map(F.col, s)] for s in sets], *base, F.col("platform"), F.col("campaign_type")
    ).agg(
        F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"), (F.min("platform") < F.max("platform")).alias("several"),
        F.grouping("platform").alias("gp"), F.grouping("campaign_type").alias("gt"),
    )
    summed = summed.where("not (gp = 1 and gt = 0 and not several)")
    level = F.when((F.col("gp") == 1) & (F.col("gt") == 1), "aggregate").when(F.col("gt") == 1, "channel").otherwise("campaign_type")
    return summed.select(
        "run_id", level.alias("level"), F.when(F.col("gp") == 1, "blended").otherwise(F.col("platform")).alias("channel"),
        F.when(F.col("gt") == 1, "all").otherwise(F.col("campaign_type")).alias("campaign_type"),
        F.lit("all").alias("campaign_id"), F.lit("all").alias("campaign_name"), "horizon", "sim", "revenue", "spend",
        S.roas(F.col("revenue"), F.col("spend")).alias("roas"),
    )


def conformal(x: Column, middle: Column, scale: Column) -> Column:
    """Spread about the median by a power: what isn't positive counts as 1e-9 of the median."""
    ratio = F.when(x > 0, x / middle).otherwise(1e-9)
    return F.when((scale == 1) | ~(middle > 0), F.greatest(x, F.lit(0.0))).otherwise(middle * F.pow(ratio, scale))


def with_scale(nodes: DataFrame, scales: DataFrame | None) -> DataFrame:
    """``nodes`` with ``scale``: of level and horizon, else of the horizon (level null), else 1."""
    if scales is None:
        return nodes.withColumn("scale", F.lit(1.0))
    own = scales.where("level is not null").select("level", "horizon", F.col("scale").alias("own"))
    every = scales.where("level is null").select("horizon", F.col("scale").alias("every"))
    out = nodes.join(F.broadcast(own), ["level", "horizon"], "left").join(F.broadcast(every), "horizon", "left")
    return out.withColumn("scale", F.coalesce("own", "every", F.lit(1.0))).drop("own", "every")


def _at(quantiles: tuple[float, ...], found: Column, n: Column, of) -> list[Column]:
    """``of`` the order statistics in the map ``found``, linear between the two about each position."""
    out = []
    for q in quantiles:
        place = (n - 1) * F.lit(q)
        low = F.floor(place)
        a, b = of(F.element_at(found, low)), of(F.element_at(found, F.least(low + 1, n - 1)))
        out.append(a + (b - a) * (place - low))
    return out


def order_statistics(rows: DataFrame, keys: list[str], quantiles: tuple[float, ...], bins: int = BINS) -> DataFrame:
    """(keys, n, mean, found): of each key's ``x`` the order statistics about ``quantiles``, as a map from rank (from 0) to value.

    Exact, by counting in two rounds: the first counts each key's values in equal ranges between its
    least and greatest, the second sorts what lies in the few ranges that hold a wanted rank. Values
    leave their tasks as counts alone; no task ever has a key's values together. What is broadcast has a
    row for each key and wanted range.
    """
    span = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = cut(span, "spans")
    width = F.col("hi") - F.col("lo")
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = rows.join(F.broadcast(span.select(*keys, "lo", "hi")), keys).groupBy(*keys, at.alias("bin")).count()
    upto = F.sum("count").over(Window.partitionBy(*keys).orderBy("bin"))
    counts = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("count")).join(F.broadcast(span), keys)
    ranks = [r for q in quantiles for low in [F.floor((F.col("n") - 1) * F.lit(q))] for r in (low, F.least(low + 1, F.col("n") - 1))]
    wanted = F.filter(F.array_distinct(F.array(*ranks)), lambda r: (F.col("before") <= r) & (r < F.col("upto")))
    ranges = counts.select(*keys, "bin", "before", "lo", "hi", wanted.alias("ranks")).where(F.size("ranks") > 0)
    ranges = cut(ranges, "ranges")
    near = rows.join(F.broadcast(ranges.select(*keys, F.col("bin").alias("at"), "lo", "hi")), keys).where(at == F.col("at"))
    near = near.groupBy(*keys, F.col("at").alias("bin"), "x").count()
    upto = F.sum("count").over(Window.partitionBy(*keys, "bin").orderBy("x"))
    placed = near.withColumn("upto", upto).join(F.broadcast(ranges.select(*keys, "bin", "before", "ranks")), [*keys, "bin"])
    end = F.col("before") + F.col("upto")
    held = F.filter("ranks", lambda r: (end - F.col("count") <= r) & (r < end))
    picked = placed.select(*keys, F.explode(held).alias("rank"), "x")
    found = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("found"))
    return span.select(*keys, "n", "mean").join(F.broadcast(found), keys)


def summarise(nodes: DataFrame, scales: DataFrame | None, quantiles: tuple[float, ...] = config.QUANTILES) -> DataFrame:
    """(NODE, horizon, metric, mean, std, p05 ...): the mean of the raw draws, the rest after calibration.

    Calibration keeps the order of draws, so that its quantiles are those of the raw draws' order
    statistics, calibrated. Draws without a value (a return without spend) are left out; a metric without
    any is null throughout. Nodes are few, as platforms and types bound them; their draws are not.
    """
    keys = [*NODE, "horizon", "metric"]
    values = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS]))
    rows = nodes.select(*NODE, "horizon", values)
    every = rows.select(*keys).distinct()
    rows = rows.where("x is not null")
    found = with_scale(order_statistics(rows, keys, (*quantiles, 0.5)), scales)
    found = cut(found.withColumn("middle", _at((0.5,), F.col("found"), F.col("n"), lambda x: x)[0]), "order-statistics")
    calibrated = lambda x: conformal(x, F.col("middle"), F.col("scale"))
    spread = rows.join(F.broadcast(found.select(*keys, "middle", "scale")), keys).groupBy(*keys).agg(F.stddev_pop(calibrated(F.col("x"))).alias("std"))
    names = [f"p{round(100 * q):02d}" for q in quantiles]
    at = _at(quantiles, F.col("found"), F.col("n"), calibrated)
    whole = found.select(*keys, "mean", *[c.alias(name) for c, name in zip(at, names, strict=True)]).join(F.broadcast(spread), keys)
    return every.join(F.broadcast(whole), keys, "left").select(*keys, "mean", "std", *names)


def as_campaigns(nodes: DataFrame) -> DataFrame:
    """``nodes`` with segments' draws once more as those of campaigns, which are calibrated by a scale of their own."""
    own = nodes.where("level = 'campaign_type' and channel <> 'blended'").withColumn("level", F.lit("campaign"))
    return nodes.unionByName(own)


def campaigns(summary: DataFrame, meta: DataFrame, quantiles: tuple[float, ...] = config.QUANTILES) -> DataFrame:
    """Campaign rows by pushing shares through the summary of ``as_campaigns``.

    Shares are constants, and mean, spread, quantiles and calibration all scale with their
    argument; so a campaign is its segment, calibrated as a campaign, times its share. No
    campaign x simulation rows exist. Returns of a campaign without spend share are 0 or null.
    """
    parts = summary.where("level = 'campaign'").drop("campaign_id", "campaign_name")
    shares = meta.select(
        "run_id", F.col("platform").alias("channel"), "campaign_type", "campaign_id", "campaign_name", F.coalesce("rev_share", F.lit(0.0)).alias("wr"),
        F.coalesce("spend_share", "rev_share", F.lit(0.0)).alias("ws"),
    )
    joined = parts.join(shares, ["run_id", "channel", "campaign_type"])
    factor = F.when(F.col("metric") == "revenue", F.col("wr")).when(F.col("metric") == "spend", F.col("ws")).when(F.col("ws") > 0, F.col("wr") / F.col("ws"))
    idle = (F.col("metric") == "roas") & (F.col("ws") <= 0) & (F.col("wr") <= 0)
    values = ["mean", "std", *[f"p{round(100 * q):02d}" for q in quantiles]]
    return joined.select(*NODE, "horizon", "metric", *[F.when(idle, F.lit(0.0)).otherwise(F.col(v) * factor).alias(v) for v in values])


def predictions(summary: DataFrame, origins: DataFrame, currency: str = "USD") -> DataFrame:
    """The tidy table in its fixed column order, sorted."""
    rank = F.array_position(F.array(*map(F.lit, config.LEVELS)), F.col("level"))
    dated = summary.join(F.broadcast(origins.select("run_id", "origin")), "run_id")
    out = dated.withColumns({
        "forecast_origin": F.col("origin").cast("string"), "horizon_days": F.col("horizon"), "period_start": F.date_add("origin", 1).cast("string"),
        "period_end": F.date_add("origin", F.col("horizon")).cast("string"),
        "currency": F.when(F.col("metric") == "roas", "ratio").otherwise(currency),
    })
    return out.orderBy(rank, "channel", "campaign_type", "campaign_id", "horizon_days", "metric").select("run_id", *config.PREDICTION_COLUMNS)
