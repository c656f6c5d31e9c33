"""Panel preparation: taxonomy, ragged-edge trim, dense daily series, campaign shares.

Every table carries ``run_id``, so that a score, a backtest's origins and a scenario's two runs are
partitions of one plan and no driver loop visits them one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import scalars as S
from ..functions.stage import cut

SEGMENT = ["run_id", "segment_key", "platform", "campaign_type"]
CAMPAIGN = [*SEGMENT, "campaign_uid", "campaign_id"]


def with_run(panel: DataFrame, run_id: str = "score") -> DataFrame:
    return panel if "run_id" in panel.columns else panel.withColumn("run_id", F.lit(run_id))


def as_of(panel: DataFrame, origins: DataFrame) -> DataFrame:
    """The panel as each run saw it: ``origins`` (run_id, origin) is a short table, joined by range."""
    return panel.drop("run_id").join(F.broadcast(origins), F.col("date") <= F.col("origin")).drop("origin")


def add_taxonomy(panel: DataFrame) -> DataFrame:
    panel = panel.withColumns({
        "campaign_type": S.campaign_type(F.col("channel_type_raw"), F.col("campaign_name")),
        "brand_intent": S.brand_intent(F.col("campaign_name")),
    })
    return panel.withColumns({
        "segment_key": F.concat_ws("::", "platform", "campaign_type"), "campaign_uid": F.concat_ws("::", "platform", "campaign_id"),
    })


def _active() -> Column:
    return (F.col("spend") > 0) | (F.col("revenue") > 0)


def with_active(panel: DataFrame) -> DataFrame:
    """``panel`` with ``active``: whether a row has spend or revenue, or one of the rows that it sums had."""
    return panel if "active" in panel.columns else panel.withColumn("active", _active())


def active_series(panel: DataFrame) -> DataFrame:
    """Per run and date with activity: active series, and their median over the last 28 such dates (null before 7)."""
    counts = with_active(panel).where("active").groupBy("run_id", "date").agg(F.count_distinct("platform", "campaign_id").alias("n"))
    frame = "over (partition by run_id order by date rows between 27 preceding and current row)"
    return counts.withColumn("typical", F.expr(f"case when count(n) {frame} >= 7 then percentile(n, 0.5) {frame} end"))


def trim_edge(panel: DataFrame) -> DataFrame:
    """(run_id, cutoff, origin, dropped): of the last 3 active dates, those before the first complete one from the end go.

    A date is incomplete with fewer than half the typical series. ``cutoff`` is the first date
    dropped, null if none is; ``origin`` the last date left.
    """
    return edges(active_series(panel), panel.groupBy("run_id", "date").count().drop("count"))


def edges(active: DataFrame, dates: DataFrame) -> DataFrame:
    """``trim_edge`` from the active series of each run and date, and each run's dates."""
    latest = Window.partitionBy("run_id").orderBy(F.desc("date"))
    last = active.withColumn("k", F.row_number().over(latest)).where("k <= 3")
    bad = F.coalesce(F.col("n") < 0.5 * F.col("typical"), F.lit(False)).cast("int")
    unbroken = F.min(bad).over(latest.rowsBetween(Window.unboundedPreceding, 0))
    gone = last.withColumn("gone", unbroken).groupBy("run_id").agg(
        F.min(F.when(F.col("gone") == 1, F.col("date"))).alias("cutoff"), F.sum("gone").alias("dropped")
    )
    kept = dates.join(gone, "run_id", "left").where("cutoff is null or date < cutoff")
    return kept.groupBy("run_id").agg(F.max("cutoff").alias("cutoff"), F.max("date").alias("origin"), F.coalesce(F.max("dropped"), F.lit(0)).alias("dropped"))


def daily(panel: DataFrame, keys: list[str]) -> DataFrame:
    return panel.groupBy(*keys, "date").agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("double").alias(m) for m in config.METRICS])


def dense(series: DataFrame, keys: list[str], origins: DataFrame) -> DataFrame:
    """Every day from a key's first active date (else its first) to the run's origin; gaps are 0.

    One shuffle by key and one sorted pass: a row makes the days up to the next row's, so that only
    gaps are exploded and no grid is joined.
    """
    by = Window.partitionBy(*keys)
    placed = series.join(F.broadcast(origins.select("run_id", "origin")), "run_id").withColumns({
        "start": F.coalesce(F.min(F.when(_active(), F.col("date"))).over(by), F.min("date").over(by)), "next": F.lead("date").over(by.orderBy("date")),
    })
    days = F.sequence("date", F.least(F.coalesce(F.date_sub("next", 1), F.col("origin")), F.col("origin")))
    filled = placed.where("start <= date and date <= origin").withColumn("day", F.explode(days))
    own = F.col("day") == F.col("date")
    return filled.select(*keys, F.col("day").alias("date"), *[F.when(own, F.coalesce(m, F.lit(0.0))).otherwise(0.0).alias(m) for m in config.METRICS])


def campaign_meta(days: DataFrame, names: DataFrame, origins: DataFrame) -> DataFrame:
    """A row for each campaign uid of ``days`` (``daily`` sums, no grid): totals, sums of the last 90 days, shares of its segment with their fallback.

    A campaign's days run from its first active one (else its first) to the origin; those before hold
    no spend or revenue. Segments' totals are partial sums first, and come back as a table with a row a
    run and segment, which platforms and types bound; no segment's campaigns meet in one task.
    """
    c = days.join(F.broadcast(origins.select("run_id", "origin")), "run_id").where("date <= origin")
    # In order of date, so that sums are the same to the last digit however the days arrive.
    c = c.repartition(*CAMPAIGN).sortWithinPartitions(*CAMPAIGN, "date")
    recent = F.col("date") > F.date_sub("origin", config.SHARE_WINDOW)
    total = c.groupBy(*CAMPAIGN).agg(
        F.sum("spend").alias("total_spend"), F.sum("revenue").alias("total_revenue"),
        F.coalesce(F.min(F.when(_active(), F.col("date"))), F.min("date")).alias("first_day"), F.max("origin").alias("last_day"),
        F.max(F.when(_active(), F.col("date"))).alias("last_active_day"),
        F.coalesce(F.sum(F.when(recent, F.col("spend"))), F.lit(0.0)).alias("recent_spend"),
        F.coalesce(F.sum(F.when(recent, F.col("revenue"))), F.lit(0.0)).alias("recent_revenue"),
    )
    total = total.withColumns({"n_days": (F.datediff("last_day", "first_day") + 1).cast("long"), "days_since_active": F.lit(0)})
    summed = ("total_revenue", "recent_revenue", "recent_spend")
    segments = total.groupBy("run_id", "segment_key").agg(*[F.sum(x).alias(f"all_{x}") for x in summed], F.count(F.lit(1)).alias("campaigns"))
    both = total.join(F.broadcast(segments), ["run_id", "segment_key"])
    share = lambda x: F.when(F.col(f"all_{x}") > 0, F.col(x) / F.col(f"all_{x}"))
    fallback = F.coalesce(share("total_revenue"), 1.0 / F.col("campaigns"))
    out = both.withColumns({"rev_share": F.coalesce(share("recent_revenue"), fallback), "spend_share": F.coalesce(share("recent_spend"), fallback)})
    return out.drop("campaigns", *[f"all_{x}" for x in summed]).join(names, ["run_id", "campaign_uid"], "left")


def top_campaigns(meta: DataFrame, n: int = config.MAX_CAMPAIGNS) -> DataFrame:
    best = Window.partitionBy("run_id", "segment_key").orderBy(F.desc("recent_revenue"), "campaign_uid")
    return meta.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


TABLES = ("panel", "origins", "segment_daily", "campaign_daily", "meta")


@dataclass
class Prepared:
    """What the later steps read, all keyed by run_id."""

    panel: DataFrame
    origins: DataFrame
    segment_daily: DataFrame
    campaign_daily: DataFrame
    meta: DataFrame
    profiles: DataFrame | None = None

    def series(self, segment_key: str) -> DataFrame:
        """One segment's days, in order."""
        return self.segment_daily.where(F.col("segment_key") == segment_key).orderBy("run_id", "date")

    def save(self, path: str) -> None:
        """The features artifact: a Parquet table for each field."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Prepared:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def prepare(panel: DataFrame) -> Prepared:
    """Sums come before names are classified and before the dense grid. A campaign with several names has the latest, and is one campaign."""
    panel = with_active(with_run(panel).where("date is not null"))
    keys = ["run_id", "platform", "campaign_id", "campaign_name", "channel_type_raw", "date"]
    # Days of campaigns from here on, however many rows the source has for them.
    days = panel.groupBy(*keys).agg(F.bool_or("active").alias("active"), *[F.sum(m).alias(m) for m in config.METRICS])
    panel = cut(add_taxonomy(days), "panel")
    origins = cut(trim_edge(panel), "origins")
    edge = F.broadcast(origins.select("run_id", "cutoff"))
    panel = panel.join(edge, "run_id").where("cutoff is null or date < cutoff").drop("cutoff")
    segments = cut(dense(daily(panel, SEGMENT), SEGMENT, origins), "segments")
    days = daily(panel, CAMPAIGN)
    return Prepared(panel, origins, segments, dense(days, CAMPAIGN, origins), campaign_meta(days, _names(panel), origins))


def replay(p: Prepared, runs: DataFrame) -> Prepared:
    """``p`` as each of ``runs`` (run_id, origin) saw it.

    Days are summed and active series counted once, and only these short tables are repeated for each run.
    """
    active = cut(active_series(p.panel), "active")
    dates = p.panel.select("date").distinct()
    origins = cut(edges(as_of(active, runs), as_of(dates, runs)), "origins")
    edge = F.broadcast(origins.select("run_id", F.col("origin").alias("last")))
    kept = lambda df: df.drop("run_id").join(edge, F.col("date") <= F.col("last")).drop("last")
    segments = cut(dense(kept(daily(p.panel, SEGMENT)), SEGMENT, origins), "segments")
    panel = kept(p.panel)
    campaigns = dense(kept(daily(p.panel, CAMPAIGN)), CAMPAIGN, origins)
    return Prepared(panel, origins, segments, campaigns, campaign_meta(campaigns, _names(panel), origins))


def _names(panel: DataFrame) -> DataFrame:
    return panel.groupBy("run_id", "campaign_uid").agg(F.max_by("campaign_name", F.struct("date", "campaign_name")).alias("campaign_name"))
