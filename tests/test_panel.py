"""The panel's sums of line items: exact, before names are made, and the same as SQL's."""

import datetime as dt
import random
import shutil
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from mediacast import queries
from mediacast.functions import scalars as S
from mediacast.operators import prepare
from mediacast.sources import star


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """sf0.001 with repeated lines, and prices that are negative, of more than two places (without ties, which DuckDB rounds in binary), or cancel each other."""
    folder = tmp_path_factory.mktemp("odd")
    for name in ("region", "nation", "supplier", "part", "orders"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", folder)
    line = "'/root/testdata/sf0.001/lineitem.parquet'"
    price = "case l_orderkey % 7 when 0 then -l_extendedprice when 1 then l_extendedprice / 3 when 2 then 0.146 when 3 then 1.0049 else l_extendedprice end"
    rows = f"select * replace ({price} as l_extendedprice) from {line}"
    duckdb.sql(f"copy ({rows} union all {rows} where l_orderkey % 3 = 0 union all select * replace (-l_extendedprice as l_extendedprice) from ({rows}) where l_orderkey % 11 = 4) to '{folder}/lineitem.parquet'")
    return str(folder)


def test_hundredths_round_as_the_cast_does(spark):
    rng = random.Random(5)
    values = [0.145, 1.005, 2.675, -0.145, -0.0, 0.0, 0.07, 9999999999.99, -9999999999.99, 1e-9, None, 1 / 3]
    values += [rng.randrange(-(10**7), 10**7) / rng.choice((100, 1000, 300)) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.hundredths(F.col("x"), 12).alias("h"), F.col("x").cast("decimal(12,2)").alias("d"))
    assert all((r.h is None and r.d is None) or Decimal(r.h) == r.d * 100 for r in rows.collect())


def test_whole_sums_do_not_overflow(spark):
    rows = spark.createDataFrame([(9 * 10**18,), (9 * 10**18,), (9 * 10**18,), (-1,), (None,)], "x long")
    assert rows.agg(S.whole_sum(F.col("x"), 4).alias("s")).first().s == Decimal(27 * 10**18 - 1).scaleb(-4)
    assert rows.where("x is null").agg(S.whole_sum(F.col("x"), 4).alias("s")).first().s is None


def test_lines_are_summed_before_they_are_named(spark, odd):
    panel = star.panel(spark, odd)
    assert panel.groupBy("date", "platform", "campaign_id").count().where("count > 1").count() == 0
    # Names are made of the sums or above them, not of what is summed.
    plan = panel._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sums = next(k for k, line in enumerate(plan) if "Aggregate" in line)
    assert any("regexp_extract" in line for line in plan[: sums + 1]) and not any("regexp_extract" in line for line in plan[sums + 1 :])


def test_names_are_classified_once_a_day(spark, odd, monkeypatch):
    seen = []
    real = prepare.add_taxonomy
    monkeypatch.setattr(prepare, "add_taxonomy", lambda panel: seen.append(panel) or real(panel))
    events = spark.createDataFrame([(dt.date(2024, 1, 1 + k % 3), "google", "c", "Search_TM", "SEARCH", 1.0, 2.0, 1.0, 1.0, 1.0, None) for k in range(300)], (
        "date date, platform string, campaign_id string, campaign_name string, channel_type_raw string, spend double, revenue double, clicks double, impressions double, conversions double, budget_raw double"
    ))
    prepare.prepare(events)
    assert [df.count() for df in seen] == [3]


@pytest.mark.parametrize("name", ["panel_canonical", "panel_taxonomy", "brand_mix", "active_series_per_day", "ragged_edge_trim"])
def test_odd_lines_equal_sql(spark, odd, name):
    con = duckdb.connect()
    for table in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        con.sql(f"create view {table} as select * from '{odd}/{table}.parquet'")
    found = queries.queries()[name](spark, odd)
    want = con.sql(queries.oracle_sql()[name])
    order = [found.columns.index(c) for c in want.columns]
    text = lambda rows: sorted(str(tuple(round(x, 3) if isinstance(x, float) else x for x in r)) for r in rows)
    assert text(tuple(r[i] for i in order) for r in found.collect()) == text(want.fetchall())


def test_prepared_days_are_active_if_one_of_their_lines_is(spark, odd):
    p = prepare.prepare(star.panel(spark, odd))
    con = duckdb.connect()
    for table in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        con.sql(f"create view {table} as select * from '{odd}/{table}.parquet'")
    cutoff = p.origins.first().origin
    want = {r[0]: r[1] for r in con.sql(queries.oracle_sql()["active_series_per_day"]).fetchall() if r[0] <= cutoff}
    assert {r.date: r.n for r in prepare.active_series(p.panel).collect()} == want
