"""Week and weekday profiles: ratios to a centred annual mean, smoothed, normalised, pooled and blended.

A profile is long: (keys, metric, kind, slot, factor), kind ``week`` with slots 1..53 or ``dow`` with 0..6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import scalars as S

KEY = ["run_id", "segment_key", "metric"]
HALF_YEAR = 182


def long_metrics(segments: DataFrame) -> DataFrame:
    """(run_id, segment_key, platform, campaign_type, date, metric, value) of revenue and spend, floored at 0."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.greatest(F.col(m), F.lit(0.0)).alias("value")) for m in ("revenue", "spend")])
    return segments.select("run_id", "segment_key", "platform", "campaign_type", "date", F.inline(pairs))


def normalised(factors: DataFrame, keys: list[str]) -> DataFrame:
    """``factor`` over its geometric mean within keys; what isn't positive becomes 1."""
    positive = F.when((F.col("factor") > 0) & ~F.isnan("factor"), F.col("factor"))
    mean = F.exp(F.avg(F.log(positive)).over(Window.partitionBy(*keys)))
    return factors.withColumn("factor", F.coalesce(positive / mean, F.lit(1.0)))


def _ratios(series: DataFrame) -> DataFrame:
    """Series with their centred 365-row mean (90 rows at least, else the mean of positive values).

    The moving mean is a difference of running sums: a sliding frame would add up 365 rows for each.
    """
    by = Window.partitionBy(*KEY)
    order = by.orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    one = (F.col("value") > 0).cast("int")
    run = series.withColumns({
        "i": F.row_number().over(order), "n_days": F.count(F.lit(1)).over(by), "sum": F.sum("value").over(upto), "pos": F.sum(one).over(upto),
        "total": F.sum("value").over(by), "n_pos": F.sum(one).over(by),
    })
    around = lambda c, whole: F.coalesce(F.lead(c, HALF_YEAR).over(order), F.col(whole)) - F.coalesce(F.lag(c, HALF_YEAR + 1).over(order), F.lit(0))
    rows = F.least(F.col("i") + HALF_YEAR, F.col("n_days")) - F.greatest(F.col("i") - HALF_YEAR - 1, F.lit(0))
    near = run.withColumns({"near": around("sum", "total"), "near_pos": around("pos", "n_pos"), "rows": rows})
    positive = F.try_divide("total", "n_pos")
    mean = F.when((F.col("rows") >= 90) & (F.col("near_pos") > 0), F.col("near") / F.col("rows")).otherwise(positive)
    fits = (F.col("n_days") >= 14) & (F.col("total") > 0)
    return near.select(*series.columns, mean.alias("mean"), fits.alias("fits"), "n_days")


def _slots(keys: DataFrame, n: int, first: int) -> DataFrame:
    return keys.select("*", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("slot"))


def _smooth(weeks: DataFrame, width: int = 5) -> DataFrame:
    """The mean of ``width`` neighbouring weeks, in a circle."""
    half = width // 2
    shifts = F.array(*[F.lit(k) for k in range(-half, half + 1)])
    spread = weeks.select(*KEY, F.explode(shifts).alias("by"), "slot", "factor")
    return spread.groupBy(*KEY, (F.pmod(F.col("slot") - 1 + F.col("by"), F.lit(config.WEEKS)) + 1).cast("int").alias("slot")).agg((F.sum("factor") / width).alias("factor"))


def profiles(series: DataFrame) -> DataFrame:
    """(keys, kind, slot, factor, n_days) of every segment and metric; flat where the history is too short or empty."""
    ratios = _ratios(series)
    keys = ratios.groupBy(*KEY).agg(F.max("n_days").alias("n_days"))
    usable = ratios.where("fits")
    ratio = F.try_divide("value", "mean")
    week = usable.withColumn("ratio", ratio).where("ratio > 0").groupBy(*KEY, F.weekofyear("date").alias("slot")).agg(F.avg("ratio").alias("factor"))
    weeks = _slots(keys.select(*KEY), config.WEEKS, 1).join(week, [*KEY, "slot"], "left").select(*KEY, "slot", F.coalesce("factor", F.lit(1.0)).alias("factor"))
    weeks = normalised(_smooth(weeks), KEY)
    placed = usable.withColumn("slot", F.weekofyear("date")).join(weeks.withColumnRenamed("factor", "w"), [*KEY, "slot"])
    level = F.try_divide(F.col("value"), F.col("mean") * F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    dow = placed.withColumn("v", level).where("v > 0").groupBy(*KEY, F.weekday("date").alias("slot")).agg(F.avg("v").alias("factor"))
    days = _slots(keys.select(*KEY), 7, 0).join(dow, [*KEY, "slot"], "left").select(*KEY, "slot", F.coalesce("factor", F.lit(1.0)).alias("factor"))
    both = weeks.select(*KEY, F.lit("week").alias("kind"), "slot", "factor").union(normalised(days, KEY).select(*KEY, F.lit("dow"), "slot", "factor"))
    return both.join(keys, KEY)


def pool(found: DataFrame, weights: DataFrame, scope: Column) -> DataFrame:
    """Weighted log-mean of segments' profiles by (run_id, scope, metric); ``weights``: run_id, segment_key, weight."""
    joined = found.where("n_days > 0").join(weights, ["run_id", "segment_key"]).withColumn("scope", scope)
    log = F.log(F.when(F.col("factor") > 0, F.col("factor")).otherwise(1.0))
    mean = joined.groupBy("run_id", "scope", "metric", "kind", "slot").agg(F.exp(F.sum(F.col("weight") * log) / F.sum("weight")).alias("factor"))
    return normalised(mean, ["run_id", "scope", "metric", "kind"])


def blend(own: DataFrame, prior: DataFrame) -> DataFrame:
    """Own profiles (keys, kind, slot, factor, n_days) mixed in logs with their prior's ``factor``, by n_days / (n_days + 365)."""
    joined = own.join(prior.withColumnRenamed("factor", "p"), [*KEY, "kind", "slot"], "left")
    good = lambda x: F.when(F.col(x) > 0, F.col(x)).otherwise(1.0)
    w = S.pooling_weight(F.col("n_days"))
    mixed = joined.withColumn("factor", F.exp(w * F.log(good("factor")) + (1 - w) * F.log(good("p")))).drop("p")
    return normalised(mixed, [*KEY, "kind"])


def factor_for_dates(dates: DataFrame, profile: DataFrame) -> DataFrame:
    """``dates`` (keys, date, ...) with ``season``, the week's factor times the weekday's."""
    week = profile.where("kind = 'week'").select(*KEY, F.col("slot").alias("week"), F.col("factor").alias("fw"))
    dow = profile.where("kind = 'dow'").select(*KEY, F.col("slot").alias("dow"), F.col("factor").alias("fd"))
    placed = dates.withColumns({"week": F.weekofyear("date"), "dow": F.weekday("date")})
    joined = placed.join(week, [*KEY, "week"], "left").join(dow, [*KEY, "dow"], "left")
    season = F.coalesce(F.col("fw") * F.col("fd"), F.lit(1.0))
    return joined.withColumn("season", F.when(season > 0, season).otherwise(1.0)).drop("week", "dow", "fw", "fd")
