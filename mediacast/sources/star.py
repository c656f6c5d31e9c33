"""The canonical daily panel from the star-schema tables, and a short one from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S

#: p_type -> (native type of google and bing, name token)
TYPES = {
    "ECONOMY": ("SEARCH", "Search"), "SMALL": ("SHOPPING", "Shopping"), "MEDIUM": ("PERFORMANCE_MAX", "Pmax"),
    "PROMO": ("DISPLAY", "Remarketing"), "STANDARD": ("VIDEO", "Prospecting"), "LARGE": ("DEMAND_GEN", "Campaign"),
}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a campaign and day: its line items' sums, their number, and whether one of them has spend or revenue.

    Lines are summed by the short columns that they are joined with; names and types are made of what is
    left. Money is whole ten-thousandths until it is summed, so sums don't depend on their order.
    """
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    region = read("nation", "n_nationkey", "n_regionkey").join(read("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    platform = F.when(F.col("r_name") == "AMERICA", "google").when(F.col("r_name") == "EUROPE", "meta").otherwise("bing")
    supplier = read("supplier", "s_suppkey", "s_nationkey").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", platform.alias("platform"))
    part = read("part", "p_partkey", "p_brand", "p_type")
    orders = read("orders", "o_orderkey", F.to_date("o_orderdate").alias("date"))
    line = read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    rows = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    price, tax, discount = S.hundredths(F.col("l_extendedprice"), 12), S.hundredths(F.col("l_tax"), 4), S.hundredths(F.col("l_discount"), 4)
    rows = rows.select(
        "date", "platform", "p_brand", "p_type", (price * tax).alias("spend"), (price * (100 - discount)).alias("revenue"),
        F.col("l_quantity").alias("clicks"), (F.col("l_quantity") * 50).alias("impressions"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("conversions"),
    )
    active = F.bool_or((F.col("spend") > 0) | (F.col("revenue") > 0)).alias("active")
    money = [S.whole_sum(F.col(m), 4).alias(m) for m in ("spend", "revenue")]
    counts = [F.sum(m).alias(m) for m in ("clicks", "impressions", "conversions")]
    days = rows.groupBy("date", "platform", "p_brand", "p_type").agg(F.count(F.lit(1)).alias("n_rows"), active, *money, *counts)
    mapped = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for p, v in TYPES.items() for x in (p, v[k])]), F.col("p_type"))
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    token = F.when(number % 3 == 0, "TM").when(number % 3 == 1, "NTM").otherwise("Generic")
    return days.select(
        "date", "platform",
        F.concat_ws("-", "p_brand", "p_type").alias("campaign_id"),
        F.concat_ws("_", mapped(1), token, F.lit("Campaign"), number.cast("string")).alias("campaign_name"),
        F.when(F.col("platform") != "meta", mapped(0)).alias("channel_type_raw"),
        *config.METRICS, F.lit(None).cast("double").alias("budget_raw"), "n_rows", "active",
    )


def short_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days from ``events``: views, clicks with their value as spend, purchases as revenue."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type", "value")
    money = lambda kind: F.when(F.col("event_type") == kind, F.col("value").cast("decimal(12,4)")).otherwise(F.lit(0).cast("decimal(12,4)"))
    one = lambda kind: (F.col("event_type") == kind).cast("double")
    platform = F.element_at(F.array(F.lit("google"), F.lit("meta"), F.lit("bing")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(
        F.to_date("ts").alias("date"), platform.alias("platform"),
        F.concat(F.lit("e"), (F.col("user_id") % 7).cast("string")).alias("campaign_id"),
        F.concat(F.lit("Search_TM_Campaign_"), (F.col("user_id") % 7).cast("string")).alias("campaign_name"),
        F.lit("SEARCH").alias("channel_type_raw"),
        money("click").alias("spend"), money("purchase").alias("revenue"), one("click").alias("clicks"), one("view").alias("impressions"),
        one("purchase").alias("conversions"), F.lit(None).cast("double").alias("budget_raw"),
    )
