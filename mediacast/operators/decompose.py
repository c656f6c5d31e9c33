"""Level, growth, residual spread and residual block of each segment's series, set-wise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import scalars as S
from .seasonality import KEY

BLOCK = 120


def winsorised(values: Column, p: float = 0.10) -> Column:
    """Mean of an array after clipping to its linear p and 1 - p quantiles; 0 if empty."""
    def at(s: Column, q: float) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        a, b = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
        return a + (b - a) * (place - low)

    def mean(s: Column) -> Column:
        clipped = F.transform(s, lambda x: F.least(F.greatest(x, at(s, p)), at(s, 1 - p)))
        return F.aggregate(clipped, F.lit(0.0), lambda acc, x: acc + x) / F.size(s)

    # sort_array is evaluated once here, however often the quantiles name it.
    return F.coalesce(F.get(F.transform(F.array(F.sort_array(values)), lambda s: F.when(F.size(s) > 0, mean(s))), F.lit(0)), F.lit(0.0))


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns behind a barrier: an expression that a later lambda names is not evaluated anew for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def decompose(seasonal: DataFrame) -> DataFrame:
    """One row for each key of ``seasonal`` (keys, date, value, season): level, growth and residual columns.

    A segment's history, at most some thousands of days, is gathered into one sorted array; the
    windows and trimmed means are expressions over it.
    """
    days = seasonal.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("date", "value", (F.col("value") / F.col("season")).alias("d"), "season"))).alias("h")
    )
    h = F.col("h")
    part = lambda a, f: F.transform(a, lambda x: x[f])
    last = lambda n: F.slice(h, F.greatest(F.size(h) - (n - 1), F.lit(1)), n)
    out = _settled(days, n_days=F.size(h), all=part(h, "value"), recent=part(last(config.LEVEL_WINDOW), "d"), end=F.element_at(h, -1)["date"])
    total = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x)
    year = F.filter(h, lambda x: x["date"].between(F.date_sub("end", 393), F.date_sub("end", 337)))
    out = _settled(
        out, total=total, n_positive=F.size(F.filter("all", lambda x: x > 0)), first=winsorised(F.col("recent")), every=winsorised(part(h, "d")),
        raw=winsorised(F.col("all")), before=winsorised(part(year, "d")),
    )
    sparse = (F.col("n_days") < config.MIN_SEGMENT_DAYS) | (F.col("n_positive") < 8) | (F.col("total") <= 0)
    level = F.when(sparse, F.col("raw")).when(F.col("first") > 0, F.col("first")).otherwise(F.greatest("every", F.lit(1e-6)))
    out = _settled(out, mean_value=F.col("total") / F.col("n_days"), sparse=sparse, level=level)
    logs = F.transform(F.filter("recent", lambda x: x > 0), lambda x: F.log(x / F.col("level")))
    out = _settled(out, logs=F.when(F.col("level") > 0, logs).otherwise(F.array().cast("array<double>")))
    out = _settled(out, mean_log=F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size("logs"), F.lit(1)))
    spread = F.sqrt(F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + (x - F.col("mean_log")) * (x - F.col("mean_log"))) / F.size("logs"))
    sigma = F.when(F.col("sparse"), 0.7).when(F.size("logs") >= 5, S.clip(spread, 0.05, 2.0)).otherwise(0.5)
    out = out.withColumn("resid_log_sigma", sigma)
    effective = F.greatest(F.least(F.col("n_days"), F.lit(config.LEVEL_WINDOW)) / 5.0, F.lit(1.0))
    out = out.withColumn("level_log_sigma", F.when(F.col("sparse"), 0.5).otherwise(S.clip(F.col("resid_log_sigma") / F.sqrt(effective), 0.02, 0.6)))
    block = F.transform(last(BLOCK), lambda x: x["value"] / (x["season"] * F.col("level")))
    out = out.withColumn("resid_block", F.when(F.col("sparse") | (F.col("n_days") < 10), F.array(F.lit(1.0))).otherwise(block))
    out = out.join(_slope(seasonal), KEY, "left")
    yearly = ~F.col("sparse") & (F.col("n_days") >= 400) & (F.col("before") > 0) & (F.col("first") > 0)
    sloped = ~F.col("sparse") & (F.col("n_days") >= 120)
    trend = S.clip(F.expm1(365.0 * F.coalesce("slope", F.lit(0.0))) * F.least(F.col("n_days") / 400.0, F.lit(1.0)), -0.4, 0.6)
    growth = F.when(yearly, S.clip(F.col("first") / F.col("before") - 1, -0.5, 0.8)).when(sloped, trend).otherwise(0.0)
    doubt = F.when(yearly, 0.15).when(sloped | F.col("sparse"), 0.25).otherwise(0.2)
    return out.select(
        *KEY, "level", "level_log_sigma", growth.alias("growth_annual"), doubt.alias("growth_sigma"), "resid_log_sigma", "resid_block",
        "n_days", "n_positive", "mean_value", "sparse",
    )


def _slope(seasonal: DataFrame) -> DataFrame:
    """Slope a day of the log of the 14-day mean (5 days at least; the first ones take the first such mean)."""
    order = Window.partitionBy(*KEY).orderBy("date")
    near = order.rowsBetween(-13, 0)
    d = F.greatest(F.col("value") / F.col("season"), F.lit(1e-9))
    m = seasonal.withColumns({"t": F.row_number().over(order).cast("double"), "m": F.when(F.count(d).over(near) >= 5, F.avg(d).over(near))})
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = m.withColumn("y", F.log(F.coalesce("m", F.first("m", ignorenulls=True).over(whole))))
    return filled.groupBy(*KEY).agg(F.regr_slope("y", "t").alias("slope"))
