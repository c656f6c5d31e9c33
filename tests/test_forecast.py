"""Scalars, ingest, preparation and invariants of the forecast."""

import csv
import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacast import cli, config, queries
from mediacast.functions import scalars as S
from mediacast.functions import stage
from mediacast.operators import budget, hierarchy, insights, model, prepare, reports, response, simulate
from mediacast.plans import score as plans
from mediacast.sources import exports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "name", "want"),
    [
        ("PERFORMANCE_MAX", "Pmax_NTM_Campaign_01", "Performance Max"), (None, "Prospecting_DPA_Campaign_02", "Social - Prospecting"),
        (None, "Remarketing_Brand_Campaign_01", "Social - Remarketing"), ("Search", "Search_TM_Campaign_02", "Search"),
        ("performance max", "x", "Performance Max"), (None, None, "Other"), ("?", "showcase", "Other"),
    ],
)
def test_campaign_type(spark, raw, name, want):
    assert one(spark, S.campaign_type(F.lit(raw).cast("string"), F.lit(name).cast("string"))) == want


def test_brand_and_roas(spark):
    assert one(spark, S.brand_intent(F.lit("Search_TM_Campaign_02"))) == "Brand"
    assert one(spark, S.brand_intent(F.lit("Pmax_NTM_Campaign_01"))) == "Non-Brand"
    roas = lambda r, s: one(spark, S.roas(F.lit(r), F.lit(s)))
    assert (roas(0.0, 0.0), roas(10.0, 2.0), roas(10.0, 0.0)) == (0.0, 5.0, None)


def test_calendar(spark):
    name = lambda d: one(spark, S.event_name(F.lit(d).cast("date")))
    assert [name(d) for d in ("2024-11-29", "2024-12-02", "2024-12-10", "2024-12-31", "2025-01-15", "2025-01-16")] == [
        "black_friday_week", "cyber_week", "december_ramp", "christmas_lull", "january_hangover", "",
    ]
    assert one(spark, S.us_holiday(F.lit("2024-05-27").cast("date"))) and not one(spark, S.us_holiday(F.lit("2024-05-28").cast("date")))


def test_ingest_of_dirty_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        ",CampaignId,TimePeriod,CampaignName,CampaignType,Spend,Revenue,Clicks,Impressions,Conversions,DailyBudget\n"
        "0,123.0,2024-01-01,Search_TM_1,Search,10.5,NA,3,30,1,5\n1,,01/02/2024,,Shopping,-4,\"1,234\",12d,None,,\n2,5,not a date,x,Search,1,1,1,1,1,1\n"
    )
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "google.TSV").write_text(
        "campaign_id\tsegments_date\tcampaign_name\tcampaign_advertising_channel_type\tmetrics_cost_micros\tmetrics_conversions_value\n"
        "123456789012345678\t2024-01-01\tPmax_NTM\tPERFORMANCE_MAX\t2500000\t7\n"
    )
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    rows = sorted(exports.load(spark, str(tmp_path)).collect(), key=lambda r: (r.platform, r.campaign_id))
    assert [(r.platform, r.campaign_id, r.spend, r.revenue, r.clicks) for r in rows] == [
        ("bing", "123", 10.5, 0.0, 3.0), ("bing", "unknown", 0.0, 0.0, 0.0), ("google", "123456789012345678", 2.5, 7.0, 0.0),
    ]
    assert rows[1].campaign_name == "Unnamed Campaign" and rows[1].date == dt.date(2024, 1, 2)
    with pytest.raises(FileNotFoundError):
        exports.load(spark, str(tmp_path / "none"))


@pytest.fixture(scope="module")
def panel(spark):
    day = dt.date(2023, 1, 1)
    rows = []
    for k in range(200):
        for platform, kind, share in (("google", "Search", 1.0), ("meta", None, 0.5), ("bing", "Shopping", 0.0)):
            spend = share * (10 + k % 7)
            rows.append((day + dt.timedelta(k), platform, "c1", "Remarketing_1", kind, spend, 3 * spend ** 0.7 if spend else float(k == 0), 1.0, 1.0, 1.0, None))
    schema = "date date, platform string, campaign_id string, campaign_name string, channel_type_raw string, spend double, revenue double, clicks double, impressions double, conversions double, budget_raw double"
    return spark.createDataFrame(rows, schema)


def test_forecast_is_coherent(spark, panel):
    p = prepare.prepare(panel)
    priors = model.fit_priors(p)
    cfg = config.Forecast(n_sims=40, horizons=(30,))
    found = plans.score(p, priors, cfg).predictions.collect()
    assert {r.level for r in found} == set(config.LEVELS)
    money = [r for r in found if r.metric != "roas"]
    assert all(0 <= r.p05 <= r.p10 <= r.p25 <= r.p50 <= r.p75 <= r.p90 <= r.p95 for r in money)
    mean = lambda level: sum(r["mean"] for r in found if r.level == level and r.metric == "revenue")
    assert mean("channel") == pytest.approx(mean("aggregate")) and mean("campaign") == pytest.approx(mean("aggregate"))
    idle = [r for r in found if r.channel == "bing" and r.metric == "roas" and r.level == "campaign_type"]
    assert idle and all(r.p50 is not None for r in idle)


def test_untouched_channels_cancel(spark, panel):
    p = prepare.prepare(panel)
    first, second = plans.what_if(p, model.fit_priors(p), budget.Scenario(30, channels={"meta": 400.0}), config.Forecast(n_sims=10, horizons=(30,)))
    d = {r.channel: r for r in budget.deltas(first.summary, second.summary).where("level = 'channel'").collect()}
    assert d["google"].d_revenue == 0 and d["google"].d_spend == 0 and d["meta"].d_revenue > 0


def test_draws_do_not_depend_on_partitions(spark):
    keys = spark.createDataFrame([("score", f"s{k}") for k in range(5)], "run_id string, segment_key string")
    cfg = config.Forecast(n_sims=80)
    a, b = (sorted(map(tuple, simulate.segment_normals(keys.repartition(n), cfg, "check", 10).collect())) for n in (1, 7))
    z = np.array([r[4] for r in a])
    assert a == b and len(a) == 4000 and abs(z.mean()) < 0.06 and abs((z * z).mean() - 1) < 0.1


def test_calibration_keeps_the_median(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(1, 12)], "x double")
    y = sorted(r.y for r in rows.select(hierarchy.conformal(F.col("x"), F.lit(6.0), F.lit(1.5)).alias("y")).collect())
    assert y[5] == pytest.approx(6.0) and y[-1] > 11


def test_model_round_trip(spark, panel, tmp_path):
    priors = model.fit_priors(prepare.prepare(panel))
    priors.save(str(tmp_path / "m"))
    assert model.Model.load(spark, str(tmp_path / "m")).elasticity.count() == priors.elasticity.count()


def test_registered_forecasts_are_calibrated_and_take_all_draws(monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def stop(*args):
        seen.append([x for x in args if x == "trained" or isinstance(x, config.Forecast)])
        raise Stop

    monkeypatch.setattr(queries, "_panel", lambda *a: None)
    monkeypatch.setattr(prepare, "prepare", lambda panel: prepare.Prepared(*[None] * len(prepare.Prepared.__dataclass_fields__)))
    monkeypatch.setattr(model, "fit_priors", lambda p: None)
    monkeypatch.setattr(model, "build_segments", lambda p, priors: (None, None, None))
    monkeypatch.setattr(plans, "train", lambda panel, cfg: "trained" if cfg.n_sims == 1500 else None)
    for owner, name in ((plans, "score"), (plans, "what_if"), (plans, "calibrate"), (simulate, "simulate")):
        monkeypatch.setattr(owner, name, stop)
    found = queries.queries()
    for name, draws, trained in [
        *((x, 4000, True) for x in ("prediction_table", "prediction_table_short", "channel_summary", "roas_watch", "outlook", "budget_deltas")),
        ("cumulative_fan", 4000, False), ("mc_periods", 4000, False), ("backtest_metrics", 1500, False), ("conformal_scales", 1500, False),
    ]:
        with pytest.raises(Stop):
            found[name](None, "")
        *priors, cfg = seen[-1]
        assert (name, cfg.n_sims, priors == ["trained"]) == (name, draws, trained)


def _exports(folder):
    """Two platforms' exports of 260 days."""
    day = lambda k: (dt.date(2024, 1, 1) + dt.timedelta(k)).isoformat()
    meta = "".join(f"m1,{day(k)},{20 + k % 5},3,30,{60 + k % 7},,Remarketing_TM_1\n" for k in range(260))
    (folder / "meta.csv").write_text("campaign_id,date_start,spend,clicks,impressions,conversion,daily_budget,campaign_name,cpc,cpm,ctr\n" + meta.replace("\n", ",1,1,1\n"))
    for part in range(2):
        rows = "".join(f"g{part},{day(k)},Search_NTM_{part},SEARCH,{1e7 + k},{30 + k % 3}\n" for k in range(260))
        head = "campaign_id,segments_date,campaign_name,campaign_advertising_channel_type,metrics_cost_micros,metrics_conversions_value\n"
        (folder / f"google{part}.csv").write_text(head + rows)


def test_command_line(spark, tmp_path, monkeypatch):
    """Train, predict and brief from exports: one CSV in the fixed column order, a summary, and the briefing's two files."""
    monkeypatch.setenv("MEDIACAST_SIMS", "60")
    data = tmp_path / "data"
    data.mkdir()
    _exports(data)
    model_dir, out = str(tmp_path / "model"), str(tmp_path / "out" / "predictions.csv")
    monkeypatch.setattr(cli, "SparkSession", type("Own", (), {"builder": type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: spark})()}))
    assert cli.main(["train", str(data), model_dir]) == 0
    assert cli.main(["run", str(data), model_dir, out]) == 0
    rows = list(csv.DictReader(open(out)))
    assert list(rows[0]) == config.PREDICTION_COLUMNS and {r["level"] for r in rows} == set(config.LEVELS)
    summary = json.loads((tmp_path / "out" / "forecast_summary.json").read_text())
    assert list(summary["headline"]) == ["30d", "60d", "90d"] and summary["headline"]["30d"]["revenue_p50"] > 0
    assert cli.main(["briefing", out + ".features", model_dir, str(tmp_path / "brief")]) == 0
    text, found = (tmp_path / "brief.md").read_text(), json.loads((tmp_path / "brief.json").read_text())
    assert [x for x in ("Outlook", "Drivers", "Channels", "Movers", "Actions", "Data") if f"## {x}" in text] == "Outlook Drivers Channels Movers Actions Data".split()
    for r in found["outlook"]:
        if r["season"] is not None:
            assert (1 + r["season"]) * (1 + r["trend"]) * (1 + r["spend_and_mix"]) == pytest.approx(1 + r["total"])
    p = prepare.Prepared.load(spark, out + ".features")
    assert p.series("google::Search").count() == p.segment_daily.where("segment_key = 'google::Search'").count() > 200
    result = plans.score(p, model.Model.load(spark, model_dir), config.Forecast(n_sims=10, horizons=(30,)))
    assert result.group("channel", "google").count() == 10


def test_uploads_and_headers_that_differ_in_case(spark):
    head = b"campaign_id,date_start,spend,Spend,clicks,impressions,conversion,cpc,cpm,ctr\n"
    panel = exports.from_bytes(spark, {"meta.csv": head + b"1,2024-01-01,5,7,1,1,9,1,1,1\n"})
    assert [(r.platform, r.spend, r.revenue) for r in panel.collect()] == [("meta", 5.0, 9.0)]


def test_opportunities_need_a_known_return(spark):
    rows = [("score", "a", 1, 3.0), ("score", "b", 2, 2.0), ("score", "c", 3, 1.0), ("score", "d", 4, None)]
    ranked = spark.createDataFrame(rows, "run_id string, segment_key string, place int, marginal_roas double")
    found = sorted((r.action, r.segment_key) for r in insights.opportunities(ranked).collect())
    assert found == [("review", "b"), ("review", "c"), ("scale_up", "a"), ("scale_up", "b"), ("scale_up", "c")]


def test_replay_equals_preparing_each_run(spark, panel):
    p = prepare.prepare(panel)
    runs = spark.createDataFrame([("x", dt.date(2023, 4, 1)), ("y", dt.date(2023, 6, 1))], "run_id string, origin date")
    a, b = prepare.replay(p, runs), prepare.prepare(prepare.as_of(p.panel.drop("campaign_type", "brand_intent", "segment_key", "campaign_uid").withColumn("budget_raw", F.lit(None).cast("double")), runs))
    for name in ("origins", "segment_daily", "meta"):
        one, other = (getattr(x, name) for x in (a, b))
        assert sorted(map(str, one.select(*other.columns).collect())) == sorted(map(str, other.collect()))


def test_draws_depend_on_names_alone():
    z = simulate.normals(1, "s", ("a", "b"), np.arange(4000)[:, None], np.arange(3)[None, :])
    assert (z[10:20] == simulate.normals(1, "s", ("a", "b"), np.arange(10, 20)[:, None], np.arange(3)[None, :])).all()
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs(np.corrcoef(z.T) - np.eye(3)).max() < 0.06
    walk = simulate.walks(config.Forecast(), "score", np.arange(50), 90)
    assert np.abs(walk.mean(axis=1)).max() < 1e-12


def test_broken_files_go_to_quarantine(spark, tmp_path):
    """A file cut short after its checksum was written breaks while it is read; one line too long makes a file malformed."""
    _exports(tmp_path)
    good = sorted(map(str, exports.load(spark, str(tmp_path)).collect()))
    head = "campaign_id,segments_date,campaign_name,campaign_advertising_channel_type,metrics_cost_micros,metrics_conversions_value\n"
    rows = "".join(f"g9,2024-01-{1 + k % 28:02d},Search_NTM_9,SEARCH,{1e7 + k},{30 + k % 3}\n" for k in range(2000))
    stage.write_text(spark, str(tmp_path / "sub dir" / "cut.csv"), head + rows)
    with open(tmp_path / "sub dir" / "cut.csv", "r+b") as f:
        f.truncate(40_000)
    (tmp_path / "long.csv").write_text(head + 'g8,2024-01-01,"Search, all",SEARCH,1,1\ng8,2024-01-01,x,SEARCH,1,1,7\n')
    (tmp_path / "open.csv").write_text(head + 'g7,2024-01-01,"Search,SEARCH,1,1\n')
    (tmp_path / "quoted.csv").write_text(head + 'g6,2024-01-01,"Search, ""all""",SEARCH,1,1\n')
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    (tmp_path / "void.csv").write_text("")
    panel, quarantine = exports.load_checked(spark, str(tmp_path))
    found = {r.file.rsplit("/", 1)[-1]: r.reason for r in quarantine.collect()}
    assert found.keys() == {"cut.csv", "long.csv", "open.csv", "other.csv", "void.csv"}
    assert found["cut.csv"].startswith("unreadable") and found["long.csv"] == "1 malformed lines" and found["other.csv"] == "unknown format"
    kept = [r for r in panel.collect() if r.campaign_id != "g6"]
    assert sorted(map(str, kept)) == good and panel.count() == len(good) + 1


def test_files_are_replaced_whole(spark, tmp_path, monkeypatch):
    text, table = str(tmp_path / "a.json"), str(tmp_path / "b.csv")
    for k in (1, 2):
        stage.write_text(spark, text, f"version {k}")
        stage.write_csv(spark.range(k), table)
    whole = {p.name: p.read_bytes() for p in tmp_path.iterdir() if not p.name.startswith(".")}
    assert whole == {"a.json": b"version 2", "b.csv": b"id\n0\n1\n"}

    def fails(*args):
        raise OSError("lost")

    monkeypatch.setattr(stage, "publish", fails)
    for write in (lambda: stage.write_text(spark, text, "half"), lambda: stage.write_csv(spark.range(9), table)):
        with pytest.raises(OSError, match="lost"):
            write()
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir() if not p.name.startswith(".")} == whole


def test_a_summary_that_fails_stops_nothing(spark, tmp_path, monkeypatch, caplog):
    done = []
    monkeypatch.setattr(cli.prepare.Prepared, "load", classmethod(lambda *a: None))
    monkeypatch.setattr(cli.model.Model, "load", staticmethod(lambda *a: None))
    monkeypatch.setattr(plans, "score", lambda *a: type("R", (), {"predictions": None})())
    monkeypatch.setattr(plans, "write_predictions", lambda found, path: done.append(path))
    monkeypatch.setattr(plans, "headline", lambda found: 1 / 0)
    assert cli.predict(spark, "p", "m", str(tmp_path / "x.csv")) is not None
    assert done == [str(tmp_path / "x.csv")] and "no forecast_summary.json" in caplog.text


def _exchanges(df):
    plan = df._jdf.queryExecution().sparkPlan().toString() and df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "Broadcast" not in line for line in plan.splitlines()), plan


def test_plans_of_preparation(spark, panel):
    """A grid takes one shuffle, shares no window over a segment's campaigns, the robust fit one exchange."""
    p = prepare.prepare(panel)
    days = stage.cut(prepare.daily(p.panel, prepare.CAMPAIGN), "days")
    n, plan = _exchanges(prepare.dense(days, prepare.CAMPAIGN, p.origins))
    assert n == 1 and "SortMergeJoin" not in plan
    assert "Window" not in _exchanges(prepare.campaign_meta(days, prepare._names(p.panel), p.origins))[1]
    assert _exchanges(response.fit_elasticity(p.segment_daily))[0] == 1


def test_gaps_are_filled(spark):
    day = lambda k: dt.date(2024, 1, k)
    rows = [("r", "a", day(1), 0.0, 0.0), ("r", "a", day(3), 2.0, None), ("r", "a", day(6), 0.0, 5.0), ("r", "a", day(12), 1.0, 1.0), ("r", "b", day(2), 0.0, 0.0), ("r", "c", day(11), 1.0, 1.0)]
    series = spark.createDataFrame(rows, "run_id string, segment_key string, date date, spend double, revenue double").withColumns({m: F.lit(1.0) for m in ("clicks", "impressions", "conversions")})
    origins = spark.createDataFrame([("r", day(8))], "run_id string, origin date")
    found = sorted((r.segment_key, r.date.day, r.spend, r.revenue, r.clicks) for r in prepare.dense(series, ["run_id", "segment_key"], origins).collect())
    a = [("a", 3, 2.0, 0.0, 1.0), ("a", 4, 0.0, 0.0, 0.0), ("a", 5, 0.0, 0.0, 0.0), ("a", 6, 0.0, 5.0, 1.0), ("a", 7, 0.0, 0.0, 0.0), ("a", 8, 0.0, 0.0, 0.0)]
    assert found == a + [("b", k, 0.0, 0.0, float(k == 2)) for k in range(2, 9)]


def test_robust_fit_by_hand(spark):
    """A power law with outliers comes back; too few days, equal spends and idle segments have defined results."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        spend = float(np.exp(rng.normal(3, 1)))
        rows.append(("r", "law", spend, 5 * spend**0.6 * (40.0 if k % 20 == 0 else float(np.exp(rng.normal(0, 0.01))))))
    rows += [("r", "few", 2.0, 3.0)] * 9 + [("r", "flat", 4.0, 8.0)] * 12 + [("r", "idle", 0.0, 3.0)] * 20
    fits = {r.segment_key: r for r in response.fit_elasticity(spark.createDataFrame(rows, "run_id string, segment_key string, spend double, revenue double")).collect()}
    assert abs(fits["law"].beta - 0.6) < 0.01 and abs(fits["law"].scale - 5) < 0.2 and fits["law"].n == 57 and fits["law"].r2 > 0.99
    assert (fits["few"].beta, fits["few"].scale, fits["few"].n) == (config.BETA_DEFAULT, None, 9)
    assert (fits["idle"].beta, fits["idle"].n, fits["idle"].spend_ref) == (config.BETA_DEFAULT, 0, 0.0)
    flat = np.log(8) / (np.log(4) ** 2 + 1)
    assert fits["flat"].beta == pytest.approx(min(max(flat * np.log(4), 0.15), 1.05)) and fits["flat"].r2 == 0


def test_order_statistics_are_exact(spark):
    """Heavy tails, ties, one value, two values; any number of ranges."""
    rng = np.random.default_rng(8)
    groups = {"tail": np.exp(rng.normal(0, 4, 3001)), "ties": rng.integers(0, 4, 1000).astype(float), "one": np.array([2.5]), "two": np.array([-1.0, 7.0]), "same": np.full(50, 3.0)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, x double").repartition(5)
    for bins in (1, 7, 256):
        found = {r.k: r for r in hierarchy.order_statistics(rows, ["k"], (0.05, 0.5, 0.9), bins).collect()}
        for k, v in groups.items():
            v = np.sort(v)
            assert found[k].n == len(v) and found[k]["mean"] == pytest.approx(v.mean())
            ranks = {min(int(q * (len(v) - 1)) + d, len(v) - 1) for q in (0.05, 0.5, 0.9) for d in (0, 1)}
            assert found[k].found == {r: v[r] for r in ranks}


def test_summary_of_draws(spark):
    rng = np.random.default_rng(9)
    draws = np.exp(rng.normal(0, 1, 500)) * (rng.random(500) > 0.1)
    rows = [("r", "aggregate", "blended", "all", "all", "all", 30, k, float(x), 0.0, None) for k, x in enumerate(draws)]
    nodes = spark.createDataFrame(rows, "run_id string, level string, channel string, campaign_type string, campaign_id string, campaign_name string, horizon int, sim int, revenue double, spend double, roas double")
    scales = spark.createDataFrame([("aggregate", 30, 1.5)], "level string, horizon int, scale double")
    found = {r.metric: r for r in hierarchy.summarise(nodes, scales).collect()}
    middle = np.median(draws)
    y = middle * np.where(draws > 0, draws / middle, 1e-9) ** 1.5
    assert [found["revenue"][f"p{round(100 * q):02d}"] for q in config.QUANTILES] == pytest.approx(np.quantile(y, config.QUANTILES).tolist())
    assert found["revenue"]["mean"] == pytest.approx(draws.mean()) and found["revenue"]["std"] == pytest.approx(y.std())
    assert found["spend"].p95 == 0 and found["roas"].p50 is None and found["roas"]["mean"] is None
    assert "Arrow" not in _exchanges(hierarchy.summarise(nodes, scales))[1]


def _work(plan=None):
    one = {"level": 100.0, "level_log_sigma": 0.1, "growth_annual": 0.1, "growth_sigma": 0.1, "resid_block": [0.8, 1.2] * 10}
    days = max(config.HORIZONS)
    return {
        "first": 0, "draw_id": "score", "segment_key": "s", "beta": 0.6, "spend_model": one, "revenue_model": one | {"level": 300.0},
        "spend_season": [1.0] * days, "revenue_season": [1.0] * days, "spend_path": [100.0] * days, "plan": plan,
    }


def test_no_spend_is_neutral_or_ends_revenue():
    idle = _work([0.0] * 45 + [100.0] * 45)
    (_, neutral, spend), (_, strict, _) = (simulate.paths(idle, config.Forecast(n_sims=20, zero_spend=z)) for z in ("neutral", "strict"))
    assert (spend[:, :45] == 0).all() and (neutral[:, :45] > 0).all() and (strict[:, :45] == 0).all()
    assert (neutral[:, 45:] == strict[:, 45:]).all() and (neutral[:, 45:] > 0).all()


def test_an_anchor_that_is_drawn_is_one_path_for_all_simulations():
    (_, a, spend_a), (_, b, spend_b) = (simulate.paths(_work(), config.Forecast(n_sims=30, anchor=x)) for x in ("expected", "draw"))
    ratio = (a / b) ** (1 / 0.6)
    days = np.arange(1, 91)
    months = (1 - 0.9 ** (days / 30)) / 0.1
    z, g = (simulate.normals(config.SEED, f"spend-{x}", ("score", "s"), np.array([-1]))[0] for x in ("level", "growth"))
    drawn = 100 * np.exp(0.1 * z) * (1 + np.clip(0.1 + 0.1 * g, -0.6, 0.9)) ** (months / 12)
    assert (spend_a == spend_b).all() and ratio == pytest.approx(np.tile(drawn / 100, (30, 1)))


def test_tables_of_the_dashboard(spark):
    values = {v: 0.0 for v in reports.VALUES}
    row = lambda level, channel, c, metric, p50, **more: {
        **dict.fromkeys(config.PREDICTION_COLUMNS, "x"), "run_id": "r", "level": level, "channel": channel, "campaign_type": "t", "campaign_id": c, "campaign_name": c,
        "metric": metric, "horizon_days": 30, **values, "p50": p50, **more,
    }
    rows = [row("campaign", "g", f"c{k}", "revenue", float(k // 2)) for k in range(8)] + [row("campaign", "g", f"c{k}", "roas", 9.0 - k) for k in range(7)]
    rows += [row("campaign", "g", "none", "revenue", None), row("campaign", "g", "later", "revenue", 99.0, horizon_days=60)]
    rows += [row("campaign_type", c, "all", "revenue", 5.0, p95=float("nan")) for c in ("g", "blended")]
    schema = ", ".join(f"{c} {'int' if c == 'horizon_days' else 'double' if c in values else 'string'}" for c in ["run_id", *config.PREDICTION_COLUMNS])
    table = spark.createDataFrame([tuple(r[c] for c in ["run_id", *config.PREDICTION_COLUMNS]) for r in rows], schema).repartition(4)
    found = sorted((r.place, r.campaign_id, r.p50, r.roas) for r in reports.largest(table, "campaign", 30, 4).collect())
    assert found == [(1, "c6", 3.0, 3.0), (2, "c7", 3.0, None), (3, "c4", 2.0, 5.0), (4, "c5", 2.0, 4.0)]
    last = sorted((r.place, r.campaign_id) for r in reports.largest(table, "campaign", 30, 99).collect())[-1]
    assert last == (9, "none") and [r.channel for r in reports.largest(table, "campaign_type", 30, 9).collect()] == ["g"]
    whole = {(r.level, r.metric): (r.rows, r.nulls, r.idle) for r in reports.completeness(table).collect()}
    assert whole == {("campaign", "revenue"): (10, 1, 2), ("campaign", "roas"): (7, 0, 0), ("campaign_type", "revenue"): (2, 2, 0)}
    steps = spark.createDataFrame([("r", 30, 0.1, None, -0.05)], "run_id string, horizon int, season double, trend double, spend_and_mix double")
    assert [(r.place, r.effect, round(r.change, 9), round(r.reached, 9)) for r in reports.waterfall(steps).orderBy("place").collect()] == [
        (1, "season", 10.0, 10.0), (2, "trend", 0.0, 10.0), (3, "spend_and_mix", -5.0, 5.0),
    ]


def test_env_file_fills_what_the_environment_lacks(tmp_path, monkeypatch):
    monkeypatch.setenv("MEDIACAST_LOG", "ERROR")
    monkeypatch.setenv("MEDIACAST_SIMS", "1")
    monkeypatch.delenv("MEDIACAST_SIMS")
    (tmp_path / ".env").write_text("# a comment\n\nno value\nexport MEDIACAST_SIMS = '77'\nMEDIACAST_LOG=DEBUG\n")
    cli.read_env(str(tmp_path / ".env"))
    cli.read_env(str(tmp_path / "none"))
    assert cli.settings().n_sims == 77 and cli.os.environ["MEDIACAST_LOG"] == "ERROR"


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
