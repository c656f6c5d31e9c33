"""DuckDB SQL that draws what the simulation draws: the same counter-based generator, in whole numbers modulo 2^64."""

from __future__ import annotations

from . import config
from .oracles import _EVENT, _FOURTH, _MULT, AHEAD, BASE, CAMP, ELASTIC, META, SEASONED, SEG
from .operators.reports import EFFECTS
from .operators.simulate import GOLDEN, MIX_A, MIX_B, SIGMA

#: A return that some channels of the tables are below.
WATCHED = 28.0
_ALL = "18446744073709551616::UHUGEINT"


def _uniform(source: str, name: str, text: str, *counters: str) -> str:
    """``source`` with ``name``: uniform in (0, 1) from the MD5 of a stream's ``text`` and its counters."""
    # The text is often shared by many rows, so DuckDB hashes it once for each of a dictionary's entries.
    sql = f"(SELECT *, ('0x' || substr(md5({text}), 1, 16))::UBIGINT::UHUGEINT AS x FROM {source})"
    for c in counters:
        sql = f"(SELECT * REPLACE ((x + (({c}) + 1)::UHUGEINT * {GOLDEN}::UHUGEINT) % {_ALL} AS x) FROM {sql})"
        for shift, factor in ((30, MIX_A), (27, MIX_B)):
            sql = f"(SELECT * REPLACE ((xor(x::UBIGINT, x::UBIGINT >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_ALL} AS x) FROM {sql})"
        sql = f"(SELECT * REPLACE (xor(x::UBIGINT, x::UBIGINT >> 31)::UHUGEINT AS x) FROM {sql})"
    return f"(SELECT * EXCLUDE (x), ((x::UBIGINT >> 11)::DOUBLE + 0.5) / 9007199254740992.0 AS {name} FROM {sql})"


def normal(source: str, name: str, stream: str, names: str, *counters: str, seed: int = config.SEED) -> str:
    """``source`` with a standard normal ``name``; ``stream`` and ``names`` are SQL texts."""
    both = source
    for end, u in (("-r", "u1"), ("-a", "u2")):
        both = _uniform(both, u, f"'{seed}|' || {stream} || '{end}|' || {names}", *counters)
    return f"(SELECT * EXCLUDE (u1, u2), sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) AS {name} FROM {both})"


def _clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


SEGMENT_KEYS = f"{BASE}{SEG}, keys AS (SELECT DISTINCT segment_key FROM seg)"


def shocks(n_sims: int, days: int = 90) -> str:
    """CTEs ending in ``shock`` (sim, day, shock)."""
    grid = f"(SELECT sim, day FROM range(0, {n_sims}) a(sim), range(1, {days + 1}) b(day))"
    return f""",
steps AS (SELECT sim, day, z * ({SIGMA} / sqrt(30.0)) AS z FROM {normal(grid, "z", "'macro'", "'score'", "sim", "day")}),
walks AS (SELECT sim, day, sum(z) OVER (PARTITION BY sim ORDER BY day) AS walk FROM steps),
shock AS (SELECT sim, day, walk - avg(walk) OVER (PARTITION BY sim) AS shock FROM walks)"""


def paths(n_sims: int, days: int = 90, plan: str | None = None) -> str:
    """CTEs after ``models``, ``week``, ``dow``, ``ahead``, ``base`` and ``fit``, ending in ``paths`` (segment_key, sim, day, revenue, spend).

    ``plan``: a table (segment_key, day, plan) of spend that replaces the free paths.
    """
    names = "'score|' || segment_key"
    grid = f"(SELECT segment_key, metric, level, level_log_sigma, growth_annual, growth_sigma, sim FROM models, range(0, {n_sims}) r(sim))"
    drawn = normal(normal(grid, "zl", "metric || '-level'", names, "sim"), "zg", "metric || '-growth'", names, "sim")
    weeks = f"(SELECT segment_key, metric, size, sim, week FROM blocks, range(0, {n_sims}) r(sim), range(0, {-(-days // 7)}) w(week) WHERE size > 1)"
    starts = _uniform(weeks, "u", f"'{config.SEED}|' || metric || '-block|' || {names}", "sim", "week")
    free = "coalesce(s.drawn * (1 + 0.5 * (s.block - 1)), 0)"
    if plan:
        noise = normal(f"(SELECT segment_key, day, plan, sim FROM {plan}, range(0, {n_sims}) r(sim))", "z", "'execution'", names, "sim", "day")
        planned = f", planned AS (SELECT segment_key, day, sim, plan * exp(z * 0.03) AS spend FROM {noise})"
        spend, joined = "greatest(n.spend, 0)", "JOIN planned n ON n.segment_key = r.segment_key AND n.sim = r.sim AND n.day = r.day"
    else:
        planned, spend, joined = "", f"greatest({free}, 0)", ""
    return f"""{shocks(n_sims, days)},
held AS (SELECT segment_key, metric, list(CASE WHEN sparse OR n_days < 10 THEN NULL ELSE value / (season * level) END ORDER BY date) AS block, any_value(sparse OR n_days < 10) AS short
    FROM ranked JOIN models USING (segment_key, metric) WHERE back <= 120 GROUP BY ALL),
blocks AS (SELECT segment_key, metric, CASE WHEN short THEN [1.0] ELSE block END AS block, CASE WHEN short THEN 1 ELSE len(block) END AS size FROM held),
starts AS (SELECT segment_key, metric, sim, week, floor(u * size)::BIGINT AS start FROM {starts}),
factors AS (SELECT *, level * exp(zl * level_log_sigma) AS l, {_clip("growth_annual + zg * growth_sigma", -0.6, 0.9)} AS g FROM {drawn}),
seasons AS (SELECT a.segment_key, a.metric, a.day, coalesce(w.factor * d.factor, 1.0) AS season FROM ahead a CROSS JOIN edge
    LEFT JOIN week w ON w.segment_key = a.segment_key AND w.metric = a.metric AND w.slot = weekofyear(origin + a.day::INT)
    LEFT JOIN dow d ON d.segment_key = a.segment_key AND d.metric = a.metric AND d.slot = isodow(origin + a.day::INT) - 1 WHERE a.day <= {days}),
drawn AS (SELECT f.segment_key, f.metric, f.sim, s.day, l * {_MULT.format(g="g", d="s.day")} * s.season AS drawn,
        CASE WHEN b.size > 1 THEN b.block[1 + (t.start + (s.day - 1) % 7) % b.size] ELSE b.block[1] END AS block
    FROM factors f JOIN seasons s USING (segment_key, metric) JOIN blocks b USING (segment_key, metric)
    LEFT JOIN starts t ON t.segment_key = f.segment_key AND t.metric = f.metric AND t.sim = f.sim AND t.week = (s.day - 1) // 7){planned},
spent AS (SELECT r.segment_key, r.sim, r.day, r.drawn * r.block AS free, {spend} AS spend
    FROM drawn r JOIN drawn s ON s.metric = 'spend' AND s.segment_key = r.segment_key AND s.sim = r.sim AND s.day = r.day {joined} WHERE r.metric = 'revenue'),
paths AS (SELECT p.segment_key, p.sim, p.day, p.spend, greatest(free * CASE WHEN p.spend > 0 THEN pow(p.spend / base, beta) ELSE 1.0 END * exp(shock), 0) AS revenue
    FROM spent p JOIN base b ON b.segment_key = p.segment_key AND b.day = p.day JOIN fit ON fit.segment_key = p.segment_key JOIN shock h ON h.sim = p.sim AND h.day = p.day)"""


def periods(horizons: tuple[int, ...] = config.HORIZONS, source: str = "paths", name: str = "periods") -> str:
    spans = ", ".join(f"({h})" for h in horizons)
    return f""",
{name} AS (SELECT segment_key, split_part(segment_key, '::', 1) AS platform, split_part(segment_key, '::', 2) AS campaign_type, sim, h AS horizon, sum(revenue) AS revenue, sum(spend) AS spend
    FROM {source} JOIN (VALUES {spans}) v(h) ON day <= h GROUP BY ALL)"""


def nodes(source: str = "periods", name: str = "nodes") -> str:
    return f""",
{name}_rolled AS (SELECT platform, campaign_type, sim, horizon, sum(revenue) AS revenue, sum(spend) AS spend, grouping(platform) AS gp, grouping(campaign_type) AS gt, count(DISTINCT platform) AS c
    FROM {source} GROUP BY GROUPING SETS ((sim, horizon), (sim, horizon, platform), (sim, horizon, platform, campaign_type), (sim, horizon, campaign_type))),
{name} AS (SELECT CASE WHEN gp = 1 AND gt = 1 THEN 'aggregate' WHEN gt = 1 THEN 'channel' ELSE 'campaign_type' END AS level, CASE WHEN gp = 1 THEN 'blended' ELSE platform END AS channel,
    CASE WHEN gt = 1 THEN 'all' ELSE campaign_type END AS campaign_type, sim, horizon, revenue, spend, CASE WHEN spend > 0 THEN revenue / spend WHEN revenue <= 0 THEN 0 END AS roas
    FROM {name}_rolled WHERE NOT (gp = 1 AND gt = 0 AND c <= 1))"""


_Q = ", ".join(f"quantile_cont(y, {q}) AS p{round(100 * q):02d}" for q in config.QUANTILES)
_VALUES = ["mean", "std", *[f"p{round(100 * q):02d}" for q in config.QUANTILES]]


def summary(scales: dict[tuple[str | None, int], float], source: str = "nodes", name: str = "summary") -> str:
    """CTEs ending in ``summary``; ``scales`` by level (None: any other) and horizon."""
    own = " ".join(f"WHEN level = '{level}' AND horizon = {h} THEN {s}" for (level, h), s in scales.items() if level)
    every = " ".join(f"WHEN horizon = {h} THEN {s}" for (level, h), s in scales.items() if not level)
    scale = f"CASE {own} {every} ELSE 1.0 END" if own or every else "1.0"
    return f""",
{name}_own AS (SELECT * FROM {source} UNION ALL SELECT * REPLACE ('campaign' AS level) FROM {source} WHERE level = 'campaign_type' AND channel <> 'blended'),
{name}_long AS (SELECT level, channel, campaign_type, horizon, {scale} AS k, unnest(['revenue', 'spend', 'roas']) AS metric, unnest([revenue, spend, roas]) AS x FROM {name}_own),
{name}_mid AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY level, channel, campaign_type, horizon, metric) AS mid FROM {name}_long WHERE x IS NOT NULL),
{name}_y AS (SELECT *, CASE WHEN k = 1 OR NOT mid > 0 THEN greatest(x, 0) ELSE mid * pow(CASE WHEN x > 0 THEN x / mid ELSE 1e-9 END, k) END AS y FROM {name}_mid),
{name} AS (SELECT level, channel, campaign_type, horizon, metric, avg(x) AS mean, stddev_pop(y) AS std, {_Q} FROM {name}_y GROUP BY ALL)"""


def _rounded(columns: list[str], places: int = 2) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


MODELS = f"{BASE}{SEG}{SEASONED}{AHEAD}{ELASTIC}"


def _predictions(n_sims: int, scales: dict, values: str = _rounded(_VALUES)) -> str:
    shared = ", ".join(f"CASE WHEN metric = 'roas' AND ws <= 0 AND wr <= 0 THEN 0.0 ELSE {v} * CASE metric WHEN 'revenue' THEN wr WHEN 'spend' THEN ws ELSE CASE WHEN ws > 0 THEN wr / ws END END END AS {v}" for v in _VALUES)
    whole = ", ".join(_VALUES)
    return f"""{MODELS}{CAMP}{META}{paths(n_sims)}{periods()}{nodes()}{summary(scales)},
        top AS (SELECT *, row_number() OVER (PARTITION BY segment_key ORDER BY recent_revenue DESC, campaign_uid) AS place FROM meta QUALIFY place <= {config.MAX_CAMPAIGNS}),
        shares AS (SELECT split_part(segment_key, '::', 1) AS channel, split_part(segment_key, '::', 2) AS campaign_type, split_part(campaign_uid, '::', 2) AS campaign_id, campaign_name,
            coalesce(rev_share, 0) AS wr, coalesce(spend_share, rev_share, 0) AS ws FROM top),
        whole AS (SELECT level, channel, campaign_type, 'all' AS campaign_id, 'all' AS campaign_name, horizon, metric, {whole} FROM summary WHERE level <> 'campaign'
            UNION ALL SELECT level, channel, campaign_type, campaign_id, campaign_name, horizon, metric, {shared} FROM summary JOIN shares USING (channel, campaign_type) WHERE level = 'campaign')
        SELECT origin::VARCHAR AS forecast_origin, horizon::INT AS horizon_days, (origin + 1)::VARCHAR AS period_start, (origin + horizon::INT)::VARCHAR AS period_end, level, channel, campaign_type, campaign_id,
            campaign_name, metric, CASE WHEN metric = 'roas' THEN 'ratio' ELSE 'USD' END AS currency, {values} FROM whole, edge"""


def _largest(n_sims: int, scales: dict, level: str, k: int) -> str:
    names = "channel, campaign_type, campaign_id, campaign_name"
    of = ", ".join(f"max({c}) FILTER (WHERE metric = 'revenue') AS {c}" for c in ("p10", "p50", "p90"))
    return f"""(SELECT *, row_number() OVER (ORDER BY p50 DESC NULLS LAST, {names})::INT AS place
        FROM (SELECT {names}, {of}, max(p50) FILTER (WHERE metric = 'roas') AS roas FROM ({_predictions(n_sims, scales, ", ".join(_VALUES))})
            WHERE level = '{level}' AND channel <> 'blended' AND horizon_days = 30 GROUP BY ALL) QUALIFY place <= {k})"""


def _deltas(n_sims: int, horizon: int) -> str:
    """Both runs with planned spend and the same draws; the channel ``meta`` gets a budget of 5000."""
    over = f"sum(CASE WHEN day <= {horizon} THEN base END) OVER (PARTITION BY platform)"
    scale = _clip(f"CASE WHEN platform = 'meta' THEN 5000.0 / {over} ELSE 1.0 END", 0.0, 10.0)
    runs = []
    for name, plan in (("base", "SELECT segment_key, day, base AS plan FROM base"), ("new", f"SELECT segment_key, day, base * ({scale}) AS plan FROM base")):
        medians = ", ".join(f"max(p50) FILTER (WHERE metric = '{m}') AS {name}_{m}" for m in ("revenue", "spend"))
        inner = f"{MODELS}, plans AS ({plan}){paths(n_sims, horizon, 'plans')}{periods((horizon,))}{nodes()}{summary({})}"
        runs.append(f"(WITH {inner.removeprefix('WITH ')} SELECT level, channel, campaign_type, horizon, {medians} FROM summary WHERE level <> 'campaign' GROUP BY ALL)")
    return f"""SELECT level, channel, campaign_type, horizon::INT AS horizon, {_rounded(["base_revenue", "base_spend", "new_revenue", "new_spend"])}, round(new_revenue - base_revenue, 2) + 0.0 AS d_revenue,
        round(new_spend - base_spend, 2) + 0.0 AS d_spend, round(CASE WHEN abs(new_spend - base_spend) > 1e-6 THEN (new_revenue - base_revenue) / (new_spend - base_spend) END, 4) AS incremental_roas
        FROM {runs[0]} a JOIN {runs[1]} b USING (level, channel, campaign_type, horizon)"""


_TRAILING = """,
latest AS (SELECT h AS horizon, coalesce(platform, 'blended') AS channel, sum(revenue)::DOUBLE AS trailing_revenue, sum(revenue)::DOUBLE / sum(spend)::DOUBLE AS trailing_roas
    FROM kept, edge, (VALUES (30), (60), (90)) v(h) WHERE date > origin - h GROUP BY GROUPING SETS ((h), (h, platform)))"""


def _channels(n_sims: int) -> str:
    return f"""{MODELS}{paths(n_sims)}{periods()}{nodes()}{_TRAILING},
        found AS (SELECT channel, quantile_cont(revenue, 0.5) AS p50, quantile_cont(roas, 0.5) AS roas FROM nodes WHERE level = 'channel' AND horizon = 30 GROUP BY 1),
        summary AS (SELECT found.*, trailing_revenue, trailing_roas, CASE WHEN trailing_revenue > 0 THEN p50 / trailing_revenue - 1 END AS change
            FROM found LEFT JOIN latest ON latest.channel = found.channel AND latest.horizon = 30)"""


def _outlook(n_sims: int, columns: str = "") -> str:
    """The outlook, or ``columns`` of its unrounded rows."""
    labels = ", ".join(f"max(CASE WHEN e = '{e}' THEN '{label}' END)" for e, _, label in config.EVENTS)
    told = f"""horizon::INT AS horizon, {_rounded(["p10", "p50", "p90", "roas", "spend", "trailing_revenue", "trailing_roas"])},
            {_rounded(["total", "season", "trend", "interval_width", "spend_and_mix"], 5)}, events"""
    change = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} - 1 END"
    return f"""{MODELS}{paths(n_sims)}{periods()}{nodes()}{_TRAILING},
        total AS (SELECT horizon, quantile_cont(revenue, 0.1) AS p10, quantile_cont(revenue, 0.5) AS p50, quantile_cont(revenue, 0.9) AS p90, quantile_cont(roas, 0.5) AS roas, quantile_cont(spend, 0.5) AS spend
            FROM nodes WHERE level = 'aggregate' GROUP BY 1),
        spans AS (SELECT m.segment_key, greatest(level, 0) AS weight, growth_annual, level, h AS horizon, k AS day, (origin + k::INT)::DATE AS date
            FROM models m CROSS JOIN (VALUES (30), (60), (90)) v(h) CROSS JOIN range(-89, 91) r(k) CROSS JOIN edge WHERE metric = 'revenue' AND k BETWEEN 1 - h AND h),
        lit AS (SELECT s.*, coalesce(w.factor * d.factor, 1.0) AS season, {_MULT.format(g="growth_annual", d="greatest(day, 0)")} AS mult FROM spans s
            LEFT JOIN week w ON w.segment_key = s.segment_key AND w.metric = 'revenue' AND w.slot = weekofyear(s.date)
            LEFT JOIN dow d ON d.segment_key = s.segment_key AND d.metric = 'revenue' AND d.slot = isodow(s.date) - 1),
        drivers AS (SELECT horizon, sum(weight * season) FILTER (WHERE day >= 1) / sum(weight) FILTER (WHERE day >= 1) AS next, sum(weight * season) FILTER (WHERE day < 1) / sum(weight) FILTER (WHERE day < 1) AS last,
            sum(mult * level) FILTER (WHERE day >= 1 AND level > 0) / sum(level) FILTER (WHERE day >= 1 AND level > 0) - 1 AS trend FROM lit GROUP BY 1),
        ahead_days AS (SELECT h AS horizon, (origin + k::INT)::DATE AS date FROM edge, (VALUES (30), (60), (90)) v(h), range(1, 91) r(k) WHERE k <= h),
        named AS (SELECT horizon, {_EVENT} AS e FROM (SELECT *, {_FOURTH.format(y='year(date)')}::DATE AS t FROM ahead_days)),
        events AS (SELECT horizon, concat_ws(', ', {labels}) AS events FROM named GROUP BY 1),
        whole AS (SELECT horizon, p10, p50, p90, roas, spend, trailing_revenue, trailing_roas, {change("p50", "trailing_revenue")} AS total, {change("next", "last")} AS season, trend, {change("p90", "p10")} AS interval_width, events
            FROM total JOIN drivers USING (horizon) JOIN events USING (horizon) LEFT JOIN latest USING (horizon) WHERE channel = 'blended')
        SELECT {columns or told} FROM (SELECT *, exp(ln(1 + total) - ln(1 + season) - ln(1 + trend)) - 1 AS spend_and_mix FROM whole)"""


def _waterfall(n_sims: int) -> str:
    """Each step is the running sum less the one before."""
    upto = [f"100 * ({' + '.join(f'coalesce({e}, 0)' for e in EFFECTS[:k])})" for k in range(1, len(EFFECTS) + 1)]
    steps = "horizon, " + ", ".join(f"{x} AS r{k}" for k, x in enumerate(upto, 1))
    parts = " UNION ALL ".join(f"SELECT horizon, {k} AS place, '{e}' AS effect, r{k} - {f'r{k - 1}' if k > 1 else 0} AS change, r{k} AS reached FROM found" for k, e in enumerate(EFFECTS, 1))
    return f"WITH found AS MATERIALIZED ({_outlook(n_sims, steps)}) SELECT horizon::INT AS horizon, place::INT AS place, effect, {_rounded(['change', 'reached'], 3)} FROM ({parts})"


def oracles(n_sims: int, scales: dict) -> dict[str, str]:
    fan = ", ".join(f"quantile_cont(cum, {q / 100}) AS cum_rev_p{q}" for q in (10, 50, 90))
    return {
        "rng_normals_md5": f"{SEGMENT_KEYS} SELECT segment_key, sim::INT AS sim, day::INT AS day, round(z, 8) AS z FROM "
        + normal(f"(SELECT segment_key, sim, day FROM keys, range(0, {n_sims}) a(sim), range(1, 11) b(day))", "z", "'check'", "'score|' || segment_key", "sim", "day"),
        "macro_shock_md5": f"WITH none AS (SELECT 1){shocks(n_sims)} SELECT sim::INT AS sim, day::INT AS day, round(shock, 8) AS shock FROM shock",
        "mc_periods_few": f"{MODELS}{paths(n_sims)}{periods()} SELECT segment_key, sim::INT AS sim, horizon::INT AS horizon, {_rounded(['revenue', 'spend'])} FROM periods",
        "cumulative_fan_few": f"{MODELS}{paths(n_sims)}, sums AS (SELECT sim, day, sum(revenue) AS r FROM paths GROUP BY ALL), cums AS (SELECT sim, day, sum(r) OVER (PARTITION BY sim ORDER BY day) AS cum FROM sums), "
        f"fan AS (SELECT day, {fan} FROM cums GROUP BY day) SELECT day::INT AS day, {_rounded(['cum_rev_p10', 'cum_rev_p50', 'cum_rev_p90'])} FROM fan",
        "prediction_table_few": _predictions(n_sims, scales),
        "budget_deltas_few": _deltas(n_sims, 30),
        "channel_summary_few": f"{_channels(n_sims)} SELECT channel, {_rounded(['p50', 'roas', 'trailing_revenue', 'trailing_roas'])}, round(change, 5) AS change FROM summary",
        "roas_watch_few": f"{_channels(n_sims)} SELECT channel, round(roas, 2) AS roas FROM summary WHERE roas < {WATCHED}",
        "outlook_few": _outlook(n_sims),
        "top_campaigns_few": f"SELECT place, channel, campaign_type, campaign_id, campaign_name, {_rounded(['p10', 'p50', 'p90', 'roas'])} FROM {_largest(n_sims, scales, 'campaign', 15)}",
        "top_types_few": f"SELECT place, channel, campaign_type, round(p50, 2) AS p50 FROM {_largest(n_sims, scales, 'campaign_type', 10)}",
        "waterfall_few": _waterfall(n_sims),
        "completeness_few": f"""SELECT level, metric, count(*) AS rows, sum({' + '.join(f'({c} IS NULL)::BIGINT' for c in config.PREDICTION_COLUMNS)})::BIGINT AS nulls,
            sum(coalesce({' AND '.join(f'{v} = 0' for v in _VALUES)}, false)::BIGINT)::BIGINT AS idle FROM ({_predictions(n_sims, scales, ", ".join(_VALUES))}) GROUP BY ALL""",
        "residual_blocks": f"""{MODELS}, held AS (SELECT segment_key, metric, sparse OR n_days < 10 AS short, row_number() OVER (PARTITION BY segment_key, metric ORDER BY date) - 1 AS place, value / (season * level) AS residual
                FROM ranked JOIN models USING (segment_key, metric) WHERE back <= 120)
            SELECT segment_key, metric, place::INT AS place, round(CASE WHEN short THEN 1.0 ELSE residual END, 5) AS residual FROM held WHERE NOT short OR place = 0""",
        "elasticity_priors": f"""{BASE}{SEG}{ELASTIC}, weights AS (SELECT segment_key, greatest(sum(revenue), 1.0) AS w FROM seg GROUP BY 1)
            SELECT split_part(segment_key, '::', 2) AS scope, round((sum(beta * w) / sum(w))::DOUBLE, 6) AS beta, sum(n)::BIGINT AS n FROM fit JOIN weights USING (segment_key) GROUP BY 1
            UNION ALL SELECT '*', round(median(beta)::DOUBLE, 6), sum(n)::BIGINT FROM fit""",
    }
