"""Frozen priors and the segment models built on them; both are tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.stage import cut
from . import decompose, response, seasonality
from .prepare import Prepared

VERSION = 1


@dataclass
class Model:
    """Priors by scope (segment key, type or ``*``), elasticities likewise, and interval scales."""

    seasonal: DataFrame
    elasticity: DataFrame
    scales: DataFrame | None = None

    def save(self, path: str) -> None:
        spark = self.seasonal.sparkSession
        self.seasonal.write.mode("overwrite").parquet(f"{path}/seasonal")
        self.elasticity.write.mode("overwrite").parquet(f"{path}/elasticity")
        empty = spark.createDataFrame([], "level string, horizon int, scale double")
        (self.scales if self.scales is not None else empty).write.mode("overwrite").parquet(f"{path}/scales")
        spark.createDataFrame([(VERSION,)], "version int").write.mode("overwrite").parquet(f"{path}/version")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        found = spark.read.parquet(f"{path}/version").first()[0]
        if found != VERSION:
            raise ValueError(f"model version {found}, not {VERSION}")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return Model(read("seasonal"), read("elasticity"), read("scales"))


def own_profiles(p: Prepared) -> DataFrame:
    """Every segment's own profiles, computed once for each ``Prepared``."""
    if p.profiles is None:
        p.profiles = cut(seasonality.profiles(seasonality.long_metrics(p.segment_daily)), "profiles")
    return p.profiles


def _revenue(p: Prepared) -> DataFrame:
    return p.segment_daily.groupBy("run_id", "segment_key", "campaign_type").agg(F.sum("revenue").alias("total"), F.count(F.lit(1)).alias("n_days"))


def fit_priors(p: Prepared) -> Model:
    """Profiles and elasticities of every segment, pooled by revenue for its type and over all.

    A type's beta is the revenue-weighted mean of its segments', the global one their median.
    """
    own = own_profiles(p)
    weights = _revenue(p).select("run_id", "segment_key", F.greatest("total", F.lit(1.0)).alias("weight"))
    own_rows = own.select("run_id", F.col("segment_key").alias("scope"), "metric", "kind", "slot", "factor")
    kind = F.split("segment_key", "::", 2)[1]
    typed = seasonality.pool(own, weights, kind).select(own_rows.columns)
    every = seasonality.pool(own, weights, F.lit("*")).select(own_rows.columns)
    fits = cut(response.fit_elasticity(p.segment_daily), "elasticities")
    columns = ["run_id", "scope", "beta", "scale", "n", "r2", "spend_ref", "revenue_ref"]
    rows = fits.withColumn("scope", F.col("segment_key")).select(columns)
    none = [F.lit(None).cast("double").alias(c) for c in ("scale", "r2", "spend_ref", "revenue_ref")]
    pooled = fits.join(weights, ["run_id", "segment_key"]).withColumn("scope", kind)
    by_type = pooled.groupBy("run_id", "scope").agg((F.sum(F.col("beta") * F.col("weight")) / F.sum("weight")).alias("beta"), F.sum("n").alias("n"))
    overall = fits.groupBy("run_id").agg(F.median("beta").alias("beta"), F.sum("n").alias("n")).withColumn("scope", F.lit("*"))
    order = ["run_id", "scope", "beta", none[0], "n", *none[1:]]
    return Model(cut(own_rows.union(typed).union(every), "seasonal"), rows.union(by_type.select(*order)).union(overall.select(*order)))


def prior_for(keys: DataFrame, table: DataFrame, columns: list[str], on: list[str] | None = None) -> DataFrame:
    """``keys`` (with segment_key) and the ``table`` rows of the first scope that has any: segment, type, all."""
    on = on or []
    scopes = F.array(F.struct(F.lit(0).alias("rank"), F.col("segment_key").alias("scope")), F.struct(F.lit(1).alias("rank"), F.split("segment_key", "::", 2)[1].alias("scope")), F.struct(F.lit(2).alias("rank"), F.lit("*").alias("scope")))
    tried = keys.select("*", F.inline(scopes)).join(table.select("scope", *on, *columns), ["scope", *on])
    first = F.struct("rank", *columns)
    found = tried.groupBy(*keys.columns).agg(F.min_by(first, "rank").alias("best"))
    return found.select(*keys.columns, *[F.col(f"best.{c}").alias(c) for c in columns])


def build_segments(p: Prepared, priors: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, profile, betas): each segment's own profile blended with its prior, and its decompositions."""
    series = seasonality.long_metrics(p.segment_daily)
    own = own_profiles(p)
    slots = own.select("run_id", "segment_key", "metric", "kind", "slot")
    seasonal = priors.seasonal.drop("run_id")
    prior = prior_for(slots, seasonal, ["factor"], ["metric", "kind", "slot"])
    profile = cut(seasonality.blend(own, prior), "blended")
    parts = decompose.decompose(seasonality.factor_for_dates(series, profile))
    names = p.segment_daily.select("run_id", "segment_key", "platform", "campaign_type").distinct()
    models = cut(parts.join(names, ["run_id", "segment_key"]).withColumn("draw_id", F.col("run_id")), "models")
    betas = prior_for(p.segment_daily.select("run_id", "segment_key").distinct(), priors.elasticity.drop("run_id"), ["beta"])
    return models, profile, betas
