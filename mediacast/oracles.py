"""DuckDB SQL for the queries that SQL can follow, on the same Parquet tables."""

from __future__ import annotations

_CASES = " ".join(
    f"WHEN '{t}' THEN '{v}'"
    for t, v in (("ECONOMY", "SEARCH"), ("SMALL", "SHOPPING"), ("MEDIUM", "PERFORMANCE_MAX"), ("PROMO", "DISPLAY"), ("STANDARD", "VIDEO"), ("LARGE", "DEMAND_GEN"))
)
_TOKENS = " ".join(
    f"WHEN '{t}' THEN '{v}'"
    for t, v in (("ECONOMY", "Search"), ("SMALL", "Shopping"), ("MEDIUM", "Pmax"), ("PROMO", "Remarketing"), ("STANDARD", "Prospecting"), ("LARGE", "Campaign"))
)
_PLATFORM = "CASE r_name WHEN 'AMERICA' THEN 'google' WHEN 'EUROPE' THEN 'meta' ELSE 'bing' END"
PANEL = f"""
panel AS (
    SELECT CAST(o_orderdate AS DATE) AS date, {_PLATFORM} AS platform, p_brand || '-' || p_type AS campaign_id,
        (CASE p_type {_TOKENS} END) || '_' || (['TM', 'NTM', 'Generic'])[CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 3 + 1]
            || '_Campaign_' || regexp_extract(p_brand, '[0-9]+') AS campaign_name,
        CASE WHEN {_PLATFORM} <> 'meta' THEN CASE p_type {_CASES} END END AS channel_type_raw,
        CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS spend,
        CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS revenue,
        l_quantity AS clicks, l_quantity * 50 AS impressions, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END::DOUBLE AS conversions
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
SHORT = """
panel AS (
    SELECT CAST(ts AS DATE) AS date, (['google', 'meta', 'bing'])[user_id % 3 + 1] AS platform, 'e' || (user_id % 7) AS campaign_id,
        'Search_TM_Campaign_' || (user_id % 7) AS campaign_name, 'SEARCH' AS channel_type_raw,
        CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(12,4)) ELSE 0 END AS spend,
        CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,4)) ELSE 0 END AS revenue,
        (event_type = 'click')::DOUBLE AS clicks, (event_type = 'view')::DOUBLE AS impressions, (event_type = 'purchase')::DOUBLE AS conversions
    FROM events
)"""
TYPED = """,
typed AS (
    SELECT *, CASE
            WHEN channel_type_raw IS NOT NULL THEN CASE channel_type_raw WHEN 'SEARCH' THEN 'Search' WHEN 'SHOPPING' THEN 'Shopping'
                WHEN 'PERFORMANCE_MAX' THEN 'Performance Max' WHEN 'DISPLAY' THEN 'Display' WHEN 'VIDEO' THEN 'Video' WHEN 'DEMAND_GEN' THEN 'Demand Gen' END
            WHEN campaign_name LIKE 'Pmax%' THEN 'Performance Max' WHEN campaign_name LIKE 'Shopping%' THEN 'Shopping'
            WHEN campaign_name LIKE 'Remarketing%' THEN 'Social - Remarketing' WHEN campaign_name LIKE 'Prospecting%' THEN 'Social - Prospecting'
            WHEN campaign_name LIKE '%Generic%' THEN 'Social - Generic' WHEN campaign_name LIKE 'Search%' THEN 'Search' ELSE 'Other' END AS campaign_type,
        CASE WHEN campaign_name LIKE '%\\_NTM\\_%' ESCAPE '\\' OR campaign_name LIKE '%Generic%' OR campaign_name LIKE 'Prospecting%' THEN 'Non-Brand'
            WHEN campaign_name LIKE '%\\_TM\\_%' ESCAPE '\\' THEN 'Brand' ELSE 'Unknown' END AS brand_intent
    FROM panel
), keyed AS (SELECT *, platform || '::' || campaign_type AS segment_key, platform || '::' || campaign_id AS campaign_uid FROM typed)"""
TRIM = """,
active AS (SELECT date, count(DISTINCT platform || '|' || campaign_id) AS n FROM panel WHERE spend > 0 OR revenue > 0 GROUP BY date),
typical AS (
    SELECT date, n, CASE WHEN count(*) OVER w >= 7 THEN quantile_cont(n, 0.5) OVER w END AS typical
    FROM active WINDOW w AS (ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)
), tail AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM typical QUALIFY k <= 3),
gone AS (SELECT date FROM tail t WHERE NOT EXISTS (SELECT 1 FROM tail u WHERE u.k <= t.k AND NOT coalesce(u.n < 0.5 * u.typical, false))),
edge AS (SELECT (SELECT min(date) FROM gone) AS cutoff, (SELECT max(date) FROM panel WHERE date < coalesce((SELECT min(date) FROM gone), DATE '9999-01-01')) AS origin,
    (SELECT count(*) FROM gone) AS dropped),
kept AS (SELECT keyed.* FROM keyed, edge WHERE date <= origin)"""
_SUMS = "coalesce(sum(spend), 0)::DOUBLE AS spend, coalesce(sum(revenue), 0)::DOUBLE AS revenue, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(conversions) AS conversions"


def _dense(name: str, keys: str) -> str:
    fill = ", ".join(f"coalesce({m}, 0) AS {m}" for m in "spend revenue clicks impressions conversions".split())
    return f""",
{name}_sum AS (SELECT {keys}, date, {_SUMS} FROM kept GROUP BY ALL),
{name}_first AS (SELECT {keys}, coalesce(min(date) FILTER (WHERE spend > 0 OR revenue > 0), min(date)) AS start FROM {name}_sum GROUP BY ALL),
{name}_grid AS (SELECT {keys}, unnest(generate_series(start, origin, INTERVAL 1 DAY))::DATE AS date FROM {name}_first, edge WHERE start <= origin),
{name} AS (SELECT {keys}, date, {fill} FROM {name}_grid LEFT JOIN {name}_sum USING ({keys}, date))"""


SEG = _dense("seg", "segment_key, platform, campaign_type")
CAMP = _dense("camp", "segment_key, platform, campaign_type, campaign_uid, campaign_id")
BASE = f"WITH {PANEL}{TYPED}{TRIM}"
META = """,
names AS (SELECT campaign_uid, arg_max(campaign_name, (date, campaign_name)) AS campaign_name FROM kept GROUP BY 1),
totals AS (
    SELECT campaign_uid, segment_key, sum(spend) AS total_spend, sum(revenue) AS total_revenue, count(DISTINCT date) AS n_days, min(date) AS first_day,
        max(date) AS last_day, max(date) FILTER (WHERE spend > 0 OR revenue > 0) AS last_active_day,
        coalesce(sum(spend) FILTER (WHERE date > origin - 90), 0) AS recent_spend, coalesce(sum(revenue) FILTER (WHERE date > origin - 90), 0) AS recent_revenue,
        any_value(origin) AS origin
    FROM camp, edge GROUP BY 1, 2
), meta AS (
    SELECT *, coalesce(CASE WHEN sum(recent_revenue) OVER s > 0 THEN recent_revenue / sum(recent_revenue) OVER s END, fallback) AS rev_share,
        coalesce(CASE WHEN sum(recent_spend) OVER s > 0 THEN recent_spend / sum(recent_spend) OVER s END, fallback) AS spend_share
    FROM (SELECT *, coalesce(CASE WHEN sum(total_revenue) OVER s > 0 THEN total_revenue / sum(total_revenue) OVER s END, 1.0 / count(*) OVER s) AS fallback
        FROM totals WINDOW s AS (PARTITION BY segment_key)) JOIN names USING (campaign_uid)
    WINDOW s AS (PARTITION BY segment_key)
)"""
_DAYS = "WITH days AS (SELECT unnest(generate_series(DATE '2018-01-01', DATE '2027-12-31', INTERVAL 1 DAY))::DATE AS date)"
#: The fourth Thursday of November.
_FOURTH = "(make_date({y}, 11, 1) + CAST((11 - isodow(make_date({y}, 11, 1))) % 7 AS INT) + 21)"
_EVENT = (
    "CASE WHEN date BETWEEN t - 1 AND t + 2 THEN 'black_friday_week' WHEN date BETWEEN t + 4 AND t + 8 THEN 'cyber_week'"
    " WHEN month(date) = 12 AND day(date) <= 23 THEN 'december_ramp' WHEN month(date) = 12 THEN 'christmas_lull'"
    " WHEN month(date) = 1 AND day(date) <= 15 THEN 'january_hangover' ELSE '' END"
)
_DATED = f"{_DAYS}, dated AS (SELECT date, {_FOURTH.format(y='year(date)')}::DATE AS t FROM days), named AS (SELECT date, t, {_EVENT} AS e FROM dated)"
LONG = """,
long AS (SELECT segment_key, 'revenue' AS metric, date, greatest(revenue, 0) AS value FROM seg
    UNION ALL SELECT segment_key, 'spend', date, greatest(spend, 0) FROM seg)"""
_K = "segment_key, metric"
PROFILE = f"""{LONG},
mean0 AS (
    SELECT *, avg(value) OVER a AS m, count(*) OVER a AS c, avg(CASE WHEN value > 0 THEN value END) OVER s AS g, count(*) OVER s AS n, sum(value) OVER s AS total
    FROM long WINDOW a AS (PARTITION BY {_K} ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING), s AS (PARTITION BY {_K})
), mean1 AS (SELECT {_K}, date, value, CASE WHEN c >= 90 AND m > 0 THEN m ELSE g END AS ma FROM mean0 WHERE n >= 14 AND total > 0),
keys AS (SELECT DISTINCT {_K} FROM long),
week0 AS (SELECT {_K}, weekofyear(date) AS slot, avg(value / ma) AS f FROM mean1 WHERE value / ma > 0 GROUP BY ALL),
week1 AS (SELECT keys.*, i AS slot, coalesce(f, 1.0) AS f FROM keys CROSS JOIN range(1, 54) r(i) LEFT JOIN week0 ON week0.segment_key = keys.segment_key AND week0.metric = keys.metric AND week0.slot = i),
week2 AS (SELECT a.segment_key, a.metric, a.slot, sum(b.f) / 5 AS f FROM week1 a JOIN week1 b ON a.segment_key = b.segment_key AND a.metric = b.metric
    AND ((b.slot - a.slot + 106) % 53 <= 2 OR (a.slot - b.slot + 106) % 53 <= 2) GROUP BY ALL),
week AS (SELECT {_K}, slot, f / exp(avg(ln(f)) OVER (PARTITION BY {_K})) AS factor FROM week2),
dow0 AS (SELECT {_K}, isodow(date) - 1 AS slot, avg(value / (ma * factor)) AS f FROM mean1 JOIN week USING ({_K}) WHERE week.slot = weekofyear(date) AND value > 0 GROUP BY ALL),
dow1 AS (SELECT keys.*, i AS slot, coalesce(f, 1.0) AS f FROM keys CROSS JOIN range(0, 7) r(i) LEFT JOIN dow0 ON dow0.segment_key = keys.segment_key AND dow0.metric = keys.metric AND dow0.slot = i),
dow AS (SELECT {_K}, slot, f / exp(avg(ln(f)) OVER (PARTITION BY {_K})) AS factor FROM dow1)"""


def _clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


def _trimmed(condition: str) -> str:
    """Winsorised mean of the numbers that meet a condition, from rows with their quantiles."""
    return f"avg(least(greatest(value, lo), hi)) FILTER (WHERE {condition})"


FLAT = f"""{LONG},
placed AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY date DESC) AS back, row_number() OVER (PARTITION BY {_K} ORDER BY date) AS t, count(*) OVER (PARTITION BY {_K}) AS n, max(date) OVER (PARTITION BY {_K}) AS last_day FROM long),
part AS (SELECT *, 'recent' AS part FROM placed WHERE back <= 56 UNION ALL SELECT *, 'all' FROM placed UNION ALL SELECT *, 'year' FROM placed WHERE date BETWEEN last_day - 393 AND last_day - 337),
bounds AS (SELECT {_K}, part, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM part GROUP BY ALL),
means AS (SELECT {_K}, part, avg(least(greatest(value, lo), hi)) AS w FROM part JOIN bounds USING ({_K}, part) GROUP BY ALL),
wide AS (SELECT {_K}, max(w) FILTER (WHERE part = 'recent') AS recent, max(w) FILTER (WHERE part = 'all') AS every, coalesce(max(w) FILTER (WHERE part = 'year'), 0) AS prior FROM means GROUP BY ALL),
stats AS (SELECT {_K}, count(*) AS n_days, count(*) FILTER (WHERE value > 0) AS n_positive, avg(value) AS mean_value, sum(value) AS total FROM long GROUP BY ALL),
lev AS (SELECT *, n_days < 28 OR n_positive < 8 OR total <= 0 AS sparse, CASE WHEN n_days < 28 OR n_positive < 8 OR total <= 0 THEN every WHEN recent > 0 THEN recent ELSE greatest(every, 1e-6) END AS level FROM stats JOIN wide USING ({_K})),
spread AS (SELECT {_K}, count(*) AS c, stddev_pop(ln(value / level)) AS s FROM placed JOIN lev USING ({_K}) WHERE back <= 56 AND value > 0 AND level > 0 GROUP BY ALL),
smooth AS (SELECT {_K}, t, CASE WHEN count(*) OVER w >= 5 THEN avg(greatest(value, 1e-9)) OVER w END AS m FROM placed WINDOW w AS (PARTITION BY {_K} ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
line AS (SELECT {_K}, regr_slope(ln(coalesce(m, f)), t) AS slope FROM smooth JOIN (SELECT {_K}, m AS f FROM smooth WHERE t = 5) USING ({_K}) GROUP BY ALL)"""
ELASTIC = """,
u AS (SELECT segment_key, spend, revenue, ln(spend) AS x, ln(revenue) AS y FROM seg WHERE spend > 0 AND revenue > 0),
l1 AS (SELECT segment_key, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS days, median(spend) AS spend_ref, median(revenue) AS revenue_ref FROM u GROUP BY 1),
e AS (SELECT u.*, y - i - s * x AS e FROM u JOIN l1 USING (segment_key)),
o AS (SELECT e.*, abs(e - m) AS off FROM e JOIN (SELECT segment_key, median(e) AS m FROM e GROUP BY 1) USING (segment_key)),
n AS (SELECT o.*, mad <= 0 OR off <= 3 * 1.4826 * mad AS near FROM o JOIN (SELECT segment_key, median(off) AS mad FROM o GROUP BY 1) USING (segment_key)),
f AS (SELECT *, sum(near::INT) OVER (PARTITION BY segment_key) >= 5 AS enough FROM n),
l2 AS (SELECT segment_key, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r2, count(*) AS n FROM f WHERE near OR NOT enough GROUP BY 1),
fit AS (SELECT k.segment_key, coalesce(days, 0) >= 10 AS known, CASE WHEN days >= 10 THEN least(greatest(l2.s, 0.15), 1.05) ELSE 0.65 END AS beta,
    CASE WHEN days >= 10 THEN exp(l2.i) END AS scale, CASE WHEN days >= 10 THEN l2.n ELSE coalesce(days, 0) END AS n, CASE WHEN days >= 10 THEN r2 ELSE 0.0 END AS r2,
    coalesce(spend_ref, 0) AS spend_ref, coalesce(revenue_ref, 0) AS revenue_ref
    FROM (SELECT DISTINCT segment_key FROM seg) k LEFT JOIN l1 USING (segment_key) LEFT JOIN l2 USING (segment_key))"""
_MULT = _clip("pow(1 + {g}, (1 - pow(0.9, {d} / 30.0)) / (1 - 0.9) / 12.0)", 0.4, 2.5)
NODES = """,
monthly AS (SELECT platform, campaign_type, year(date) * 12 + month(date) AS sim, sum(revenue) AS revenue, sum(spend) AS spend FROM seg GROUP BY ALL),
rolled AS (SELECT platform, campaign_type, sim, sum(revenue) AS revenue, sum(spend) AS spend, grouping(platform) AS gp, grouping(campaign_type) AS gt, count(DISTINCT platform) AS c
    FROM monthly GROUP BY GROUPING SETS ((sim), (sim, platform), (sim, platform, campaign_type), (sim, campaign_type))),
nodes AS (SELECT CASE WHEN gp = 1 AND gt = 1 THEN 'aggregate' WHEN gt = 1 THEN 'channel' ELSE 'campaign_type' END AS level, CASE WHEN gp = 1 THEN 'blended' ELSE platform END AS channel,
    CASE WHEN gt = 1 THEN 'all' ELSE campaign_type END AS campaign_type, sim, revenue, spend, CASE WHEN spend > 0 THEN revenue / spend WHEN revenue <= 0 THEN 0 END AS roas
    FROM rolled WHERE NOT (gp = 1 AND gt = 0 AND c <= 1))"""
ORIGINS = """,
starts AS (SELECT origin - 90 - 30 * k::INT AS day0 FROM edge, range(0, 8) r(k), (SELECT min(date) AS first FROM kept) WHERE (origin - 90 - 30 * k::INT) - first >= 180)"""

_dense_columns = "segment_key, date, round(spend, 4) AS spend, round(revenue, 4) AS revenue, clicks, impressions, conversions"
_flat_select = f"""
SELECT {_K}, round(level, 4) AS level, round(CASE WHEN sparse THEN 0.5 ELSE {_clip("sig / sqrt(greatest(least(n_days, 56) / 5.0, 1.0))", 0.02, 0.6)} END, 4) AS level_log_sigma,
    round(CASE WHEN yearly THEN {_clip("recent / prior - 1", -0.5, 0.8)} WHEN sloped THEN {_clip("(exp(365.0 * slope) - 1) * least(n_days / 400.0, 1.0)", -0.4, 0.6)} ELSE 0 END, 4) AS growth_annual,
    round(CASE WHEN yearly THEN 0.15 WHEN sloped OR sparse THEN 0.25 ELSE 0.2 END, 4)::DOUBLE AS growth_sigma, round(sig, 4) AS resid_log_sigma, round(mean_value, 4) AS mean_value,
    n_days::INT AS n_days, n_positive::INT AS n_positive, sparse
FROM (SELECT lev.*, (CASE WHEN sparse THEN 0.7 WHEN c >= 5 THEN {_clip("s", 0.05, 2.0)} ELSE 0.5 END)::DOUBLE AS sig, slope,
        NOT sparse AND n_days >= 400 AND prior > 0 AND recent > 0 AS yearly, NOT sparse AND n_days >= 120 AS sloped
    FROM lev LEFT JOIN spread USING ({_K}) LEFT JOIN line USING ({_K}))"""

SEASONED = f"""{PROFILE},
profile AS (SELECT {_K}, 'week' AS kind, slot, factor FROM week UNION ALL SELECT {_K}, 'dow', slot, factor FROM dow),
seasoned AS (SELECT l.*, coalesce(w.factor * d.factor, 1.0) AS season, value / coalesce(w.factor * d.factor, 1.0) AS d FROM long l
    LEFT JOIN week w ON w.segment_key = l.segment_key AND w.metric = l.metric AND w.slot = weekofyear(date)
    LEFT JOIN dow d ON d.segment_key = l.segment_key AND d.metric = l.metric AND d.slot = isodow(date) - 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY date DESC) AS back, row_number() OVER (PARTITION BY {_K} ORDER BY date) AS t, max(date) OVER (PARTITION BY {_K}) AS last_day FROM seasoned),
piece AS (SELECT {_K}, d AS x, 'recent' AS piece FROM ranked WHERE back <= 56 UNION ALL SELECT {_K}, d, 'every' FROM ranked
    UNION ALL SELECT {_K}, value, 'raw' FROM ranked UNION ALL SELECT {_K}, d, 'year' FROM ranked WHERE date BETWEEN last_day - 393 AND last_day - 337),
ends AS (SELECT {_K}, piece, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM piece GROUP BY ALL),
trimmed AS (SELECT {_K}, piece, avg(least(greatest(x, lo), hi)) AS w FROM piece JOIN ends USING ({_K}, piece) GROUP BY ALL),
flatter AS (SELECT {_K}, max(w) FILTER (WHERE piece = 'recent') AS recent, max(w) FILTER (WHERE piece = 'every') AS every, max(w) FILTER (WHERE piece = 'raw') AS raw,
    coalesce(max(w) FILTER (WHERE piece = 'year'), 0) AS prior FROM trimmed GROUP BY ALL),
sizes AS (SELECT {_K}, count(*) AS n_days, count(*) FILTER (WHERE value > 0) AS n_positive, avg(value) AS mean_value, sum(value) AS total FROM long GROUP BY ALL),
levels AS (SELECT *, n_days < 28 OR n_positive < 8 OR total <= 0 AS sparse,
    CASE WHEN n_days < 28 OR n_positive < 8 OR total <= 0 THEN raw WHEN recent > 0 THEN recent ELSE greatest(every, 1e-6) END AS level FROM sizes JOIN flatter USING ({_K})),
wide_logs AS (SELECT {_K}, count(*) AS c, stddev_pop(ln(d / level)) AS s FROM ranked JOIN levels USING ({_K}) WHERE back <= 56 AND d > 0 AND level > 0 GROUP BY ALL),
moving AS (SELECT {_K}, t, CASE WHEN count(*) OVER w >= 5 THEN avg(greatest(d, 1e-9)) OVER w END AS m FROM ranked WINDOW w AS (PARTITION BY {_K} ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
lines AS (SELECT {_K}, regr_slope(ln(coalesce(m, f)), t) AS slope FROM moving JOIN (SELECT {_K}, m AS f FROM moving WHERE t = 5) USING ({_K}) GROUP BY ALL),
parts AS (SELECT levels.*, (CASE WHEN sparse THEN 0.7 WHEN c >= 5 THEN {_clip("s", 0.05, 2.0)} ELSE 0.5 END)::DOUBLE AS sig, slope,
    NOT sparse AND n_days >= 400 AND prior > 0 AND recent > 0 AS yearly, NOT sparse AND n_days >= 120 AS sloped
    FROM levels LEFT JOIN wide_logs USING ({_K}) LEFT JOIN lines USING ({_K})),
models AS (SELECT {_K}, level, CASE WHEN sparse THEN 0.5 ELSE {_clip("sig / sqrt(greatest(least(n_days, 56) / 5.0, 1.0))", 0.02, 0.6)} END AS level_log_sigma,
    CASE WHEN yearly THEN {_clip("recent / prior - 1", -0.5, 0.8)} WHEN sloped THEN {_clip("(exp(365.0 * slope) - 1) * least(n_days / 400.0, 1.0)", -0.4, 0.6)} ELSE 0 END AS growth_annual,
    CASE WHEN yearly THEN 0.15 WHEN sloped OR sparse THEN 0.25 ELSE 0.2 END AS growth_sigma, sig AS resid_log_sigma, mean_value, n_days, n_positive, sparse FROM parts)"""
PRIORS = f"""{PROFILE},
profile AS (SELECT {_K}, 'week' AS kind, slot, factor FROM week UNION ALL SELECT {_K}, 'dow', slot, factor FROM dow),
weights AS (SELECT segment_key, greatest(sum(revenue), 1.0) AS w FROM seg GROUP BY 1),
scoped AS (SELECT split_part(segment_key, '::', 2) AS scope, metric, kind, slot, factor, w FROM profile JOIN weights USING (segment_key)
    UNION ALL SELECT '*', metric, kind, slot, factor, w FROM profile JOIN weights USING (segment_key)),
pooled AS (SELECT scope, metric, kind, slot, exp(sum(w * ln(factor)) / sum(w)) AS f FROM scoped GROUP BY ALL)"""
#: The expected path of each metric over the next 90 days, and segments' spend plans.
AHEAD = f""",
ahead AS (SELECT m.{_K.replace(", ", ", m.")}, day, level * {_MULT.format(g="growth_annual", d="day")} * coalesce(w.factor * d.factor, 1.0) AS path
    FROM models m CROSS JOIN range(1, 91) r(day) CROSS JOIN edge
    LEFT JOIN week w ON w.segment_key = m.segment_key AND w.metric = m.metric AND w.slot = weekofyear(origin + day::INT)
    LEFT JOIN dow d ON d.segment_key = m.segment_key AND d.metric = m.metric AND d.slot = isodow(origin + day::INT) - 1),
base AS (SELECT segment_key, split_part(segment_key, '::', 1) AS platform, day, greatest(path, 1e-9) AS base FROM ahead WHERE metric = 'spend')"""
RANKED = """,
mean_spend AS (SELECT segment_key, avg(base) AS spend FROM base WHERE day <= 30 GROUP BY 1),
returns AS (SELECT segment_key, spend, CASE WHEN spend > 0 AND scale IS NOT NULL THEN scale * beta * pow(spend, beta - 1) END AS marginal_roas FROM mean_spend JOIN fit USING (segment_key)),
placed_returns AS (SELECT *, row_number() OVER (ORDER BY marginal_roas DESC NULLS LAST, segment_key) AS place FROM returns)"""


def _budget(horizon: int, scale: str) -> str:
    """Window spend of a plan: ``scale`` is an expression over ``whole``, ``by_platform`` and ``by_segment`` sums of the window."""
    over = f"sum(CASE WHEN day <= {horizon} THEN base END) OVER"
    return f"""{BASE}{SEG}{SEASONED}{AHEAD},
        sums AS (SELECT *, {over} () AS whole, {over} (PARTITION BY platform) AS by_platform, {over} (PARTITION BY segment_key) AS by_segment FROM base)
        SELECT platform, round(sum(base), 4) AS baseline_spend, round(sum(base * {_clip(scale, 0.0, 10.0)}), 4) AS planned_spend FROM sums WHERE day <= {horizon} GROUP BY 1"""


#: Monday number n of a month, by its first day.
_MONDAY = "({first} + CAST((8 - isodow({first})) % 7 AS INT) + 7 * ({n} - 1))"
_nth = lambda month, n: _MONDAY.format(first=f"make_date(y, {month}, 1)", n=n)
HOLIDAYS = f"""{_DAYS},
years AS (SELECT y::INT AS y FROM range(2017, 2029) r(y)),
fixed AS (SELECT make_date(y, m, d) AS h FROM years, (VALUES (1, 1, 0), (7, 4, 0), (11, 11, 0), (12, 25, 0), (6, 19, 2021)) v(m, d, since) WHERE y >= since),
found AS (SELECT h FROM fixed UNION SELECT CASE isodow(h) WHEN 6 THEN h - 1 WHEN 7 THEN h + 1 ELSE h END FROM fixed
    UNION SELECT {_nth(1, 3)} FROM years UNION SELECT {_nth(2, 3)} FROM years UNION SELECT {_MONDAY.format(first="make_date(y, 5, 25)", n=1)} FROM years
    UNION SELECT {_nth(9, 1)} FROM years UNION SELECT {_nth(10, 2)} FROM years UNION SELECT {_FOURTH.format(y="y")} FROM years)
SELECT date FROM days WHERE date IN (SELECT h::DATE FROM found)"""

ORACLES = {
    "panel_canonical": f"WITH {PANEL} SELECT platform, campaign_id, campaign_name, channel_type_raw, count(*) AS n_rows, round(sum(spend)::DOUBLE, 4) AS spend, round(sum(revenue)::DOUBLE, 4) AS revenue, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(conversions) AS conversions FROM panel GROUP BY ALL",
    "panel_taxonomy": f"WITH {PANEL}{TYPED} SELECT platform, channel_type_raw, campaign_name, campaign_type, brand_intent, segment_key, campaign_uid, count(*) AS n_rows FROM keyed GROUP BY ALL",
    "brand_mix": f"WITH {PANEL}{TYPED} SELECT platform, brand_intent, round(sum(spend)::DOUBLE, 4) AS spend, round(sum(revenue)::DOUBLE, 4) AS revenue FROM keyed GROUP BY ALL",
    "active_series_per_day": f"{BASE} SELECT date, n, typical FROM typical",
    "ragged_edge_trim": f"{BASE} SELECT cutoff, origin, dropped FROM edge",
    "segment_daily_dense": f"{BASE}{SEG} SELECT {_dense_columns} FROM seg",
    "segment_daily_dense_short": f"WITH {SHORT}{TYPED}{TRIM}{SEG} SELECT {_dense_columns} FROM seg",
    "campaign_daily_dense": f"{BASE}{CAMP} SELECT campaign_uid, date_trunc('month', date)::DATE AS month, count(*) AS days, round(sum(spend), 4) AS spend, round(sum(revenue), 4) AS revenue FROM camp GROUP BY ALL",
    "campaign_meta_shares": f"{BASE}{CAMP}{META} SELECT campaign_uid, segment_key, campaign_name, round(total_spend, 4) AS total_spend, round(total_revenue, 4) AS total_revenue, n_days, first_day, last_day, last_active_day, round(recent_spend, 4) AS recent_spend, round(recent_revenue, 4) AS recent_revenue, round(rev_share, 6) AS rev_share, round(spend_share, 6) AS spend_share, origin - last_day AS days_since_active FROM meta",
    "top_campaigns_per_segment": f"{BASE}{CAMP}{META} SELECT segment_key, row_number() OVER (PARTITION BY segment_key ORDER BY recent_revenue DESC, campaign_uid) AS place, campaign_uid, round(recent_revenue, 4) AS recent_revenue FROM meta QUALIFY place <= 5",
    "calendar_events": f"{_DATED} SELECT date, e AS event_name, (CASE e WHEN 'black_friday_week' THEN 1.8 WHEN 'cyber_week' THEN 1.6 WHEN 'december_ramp' THEN 1.35 WHEN 'christmas_lull' THEN 0.6 WHEN 'january_hangover' THEN 0.85 ELSE 1.0 END)::DOUBLE AS event_uplift_prior, e = 'black_friday_week' AS black_friday_week, e = 'cyber_week' AS cyber_week, e = 'december_ramp' AS december_ramp, e = 'christmas_lull' AS christmas_lull, e = 'january_hangover' AS january_hangover FROM named",
    "calendar_frame": f"{_DATED} SELECT date, month(date)::INT AS month, (isodow(date) - 1)::INT AS dow, dayofyear(date)::INT AS doy, weekofyear(date)::INT AS iso_week, year(date)::INT AS year, t AS thanksgiving FROM named",
    "window_events": f"{_DATED}, long_days AS (SELECT s.date AS start, e FROM days s JOIN named ON named.date BETWEEN s.date AND s.date + 89 WHERE day(s.date) = 1 AND s.date <= DATE '2027-10-01' UNION ALL SELECT s.date, CASE WHEN d BETWEEN t - 1 AND t + 2 THEN 'black_friday_week' WHEN d BETWEEN t + 4 AND t + 8 THEN 'cyber_week' WHEN month(d) = 12 AND day(d) <= 23 THEN 'december_ramp' WHEN month(d) = 12 THEN 'christmas_lull' WHEN month(d) = 1 AND day(d) <= 15 THEN 'january_hangover' ELSE '' END FROM (SELECT date, unnest(generate_series(date, date + 89, INTERVAL 1 DAY))::DATE AS d FROM days WHERE day(date) = 1 AND date > DATE '2027-10-01') s, LATERAL (SELECT {_FOURTH.format(y='year(s.d)')}::DATE AS t)) SELECT start, concat_ws(', ', CASE WHEN bool_or(e = 'black_friday_week') THEN 'Black Friday' END, CASE WHEN bool_or(e = 'cyber_week') THEN 'Cyber Monday week' END, CASE WHEN bool_or(e = 'december_ramp') THEN 'December gift-buying ramp' END, CASE WHEN bool_or(e = 'christmas_lull') THEN 'post-Christmas lull' END, CASE WHEN bool_or(e = 'january_hangover') THEN 'January slowdown' END) AS events FROM long_days GROUP BY start",
    "seasonal_week_profile": f"{BASE}{SEG}{PROFILE} SELECT {_K}, slot::INT AS slot, round(factor, 6) AS factor FROM week",
    "seasonal_dow_profile": f"{BASE}{SEG}{PROFILE} SELECT {_K}, slot::INT AS slot, round(factor, 6) AS factor FROM dow",
    "decomposition_flat": f"{BASE}{SEG}{FLAT}{_flat_select}",
    "decomposition_flat_short": f"WITH {SHORT}{TYPED}{TRIM}{SEG}{FLAT}{_flat_select}",
    "elasticity_fit": f"{BASE}{SEG}{ELASTIC} SELECT segment_key, round(beta, 4)::DOUBLE AS beta, round(scale, 4) AS scale, n, round(r2, 4) AS r2, round(spend_ref, 4) AS spend_ref, round(revenue_ref, 4) AS revenue_ref FROM fit",
    "response_curve": f"{BASE}{SEG}{ELASTIC} SELECT segment_key, round(s, 3) AS spend, round(scale * pow(s, beta - 1) * s, 3) AS revenue, round(scale * pow(s, beta - 1), 3) AS average_roas, round(scale * beta * pow(s, beta - 1), 3) AS marginal_roas FROM (SELECT *, greatest(0.2 * spend_ref, 1.0) + (3 * spend_ref + 1 - greatest(0.2 * spend_ref, 1.0)) * k / 39 AS s FROM fit, range(0, 40) r(k))",
    "growth_multiplier_table": f"SELECT day::DOUBLE AS day, (g / 10.0)::DOUBLE AS growth, round({_MULT.format(g='(g / 10.0)', d='day')}, 6) AS multiplier FROM range(1, 366) a(day), range(-6, 10) b(g)",
    "response_multiplier_table": "WITH v(x) AS (VALUES (-1.0::DOUBLE), (0.0), (1.0), (50.0), (100.0), (200.0), (1000.0)), b(beta) AS (VALUES (0.15::DOUBLE), (0.65), (1.05)), g AS (SELECT s.x AS spend, d.x AS base, beta, CASE WHEN d.x > 0 AND s.x > 0 THEN pow(s.x / d.x, beta) ELSE 1.0 END AS m FROM v s, v d, b) SELECT spend, base, beta, round(m, 6) AS multiplier, round(CASE WHEN base > 0 AND spend <= 0 THEN 0.0 ELSE m END, 6) AS strict FROM g",
    "hierarchy_rollup": f"{BASE}{SEG}{NODES} SELECT level, channel, campaign_type, sim::INT AS sim, round(revenue, 4) AS revenue, round(spend, 4) AS spend, round(roas, 4) AS roas FROM nodes",
    "conformal_summary": f"""{BASE}{SEG}{NODES}, m AS (SELECT level, channel, 'revenue' AS metric, revenue AS x FROM nodes UNION ALL SELECT level, channel, 'spend', spend FROM nodes UNION ALL SELECT level, channel, 'roas', roas FROM nodes),
        c AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY level, channel, metric) AS mid, CASE WHEN level = 'channel' THEN 1.4 ELSE 1.2 END AS k FROM m WHERE level IN ('aggregate', 'channel') AND x IS NOT NULL),
        y AS (SELECT *, CASE WHEN mid > 0 THEN mid * pow(CASE WHEN x > 0 THEN x / mid ELSE 1e-9 END, k) ELSE greatest(x, 0) END AS y FROM c)
        SELECT level, channel, metric, round(avg(x), 3) AS mean, round(stddev_pop(y), 3) AS std, """
    + ", ".join(f"round(quantile_cont(y, {q / 100}), 3) AS p{q:02d}" for q in (5, 10, 25, 50, 75, 90, 95))
    + " FROM y GROUP BY ALL",
    "backtest_origins": f"{BASE}{ORIGINS} SELECT day0::DATE AS origin FROM starts",
    "backtest_actual_windows": f"{BASE}{ORIGINS}, w AS (SELECT day0::DATE AS origin, h AS horizon, platform, revenue FROM starts JOIN (VALUES (30), (60), (90)) v(h) ON true JOIN kept ON date > day0 AND date <= day0 + h) SELECT origin, horizon, CASE WHEN platform IS NULL THEN 'aggregate' ELSE 'channel' END AS level, coalesce(platform, 'blended') AS channel, round(sum(revenue)::DOUBLE, 4) AS actual FROM w GROUP BY GROUPING SETS ((origin, horizon), (origin, horizon, platform))",
    "trailing_actuals": f"{BASE} SELECT coalesce(platform, 'blended') AS channel, round(sum(revenue)::DOUBLE, 4) AS revenue, round(sum(spend)::DOUBLE, 4) AS spend, round(sum(revenue)::DOUBLE / sum(spend)::DOUBLE, 4) AS roas FROM kept, edge WHERE date > origin - 30 GROUP BY GROUPING SETS ((), (platform))",
    "trailing_roas_watch": f"{BASE} SELECT coalesce(platform, 'blended') AS channel FROM kept, edge WHERE date > origin - 30 GROUP BY GROUPING SETS ((), (platform)) HAVING sum(revenue)::DOUBLE / sum(spend)::DOUBLE < 25",
    "us_holidays": HOLIDAYS,
    "pooled_prior": f"{BASE}{SEG}{PRIORS} SELECT scope, metric, kind, slot::INT AS slot, round(f / exp(avg(ln(f)) OVER (PARTITION BY scope, metric, kind)), 5) AS factor FROM pooled",
    # The prior of a segment that the model was fitted on is its own profile, and so is the blend.
    "blended_profile": f"{BASE}{SEG}{SEASONED} SELECT {_K}, kind, slot::INT AS slot, round(factor, 5) AS factor FROM profile",
    "decomposition": f"{BASE}{SEG}{SEASONED} SELECT {_K}, round(level, 4) AS level, round(level_log_sigma, 4) AS level_log_sigma, round(growth_annual, 4)::DOUBLE AS growth_annual, round(growth_sigma, 4)::DOUBLE AS growth_sigma, round(resid_log_sigma, 4) AS resid_log_sigma, round(mean_value, 4) AS mean_value, (CASE WHEN sparse OR n_days < 10 THEN 1 ELSE least(n_days, 120) END)::INT AS block, n_days::INT AS n_days, n_positive::INT AS n_positive, sparse FROM models",
    "movers": f"{BASE}{SEG}{SEASONED}, up AS (SELECT segment_key, growth_annual, level, 'growing' AS direction, row_number() OVER (ORDER BY growth_annual DESC, segment_key) AS place FROM models WHERE metric = 'revenue' AND level > 0 AND growth_annual > 0.05), down AS (SELECT segment_key, growth_annual, level, 'declining' AS direction, row_number() OVER (ORDER BY growth_annual, segment_key) AS place FROM models WHERE metric = 'revenue' AND level > 0 AND growth_annual < -0.05) SELECT segment_key, round(growth_annual, 4)::DOUBLE AS growth_annual, round(level, 4) AS level, direction, place::INT AS place FROM (SELECT * FROM up UNION ALL SELECT * FROM down) WHERE place <= 4",
    "expected_spend_path": f"{BASE}{SEG}{SEASONED}{AHEAD} SELECT segment_key, day::INT AS day, round(path, 3) AS path FROM ahead WHERE metric = 'spend'",
    "marginal_roas_rank": f"{BASE}{SEG}{SEASONED}{AHEAD}{ELASTIC}{RANKED} SELECT segment_key, place::INT AS place, round(spend, 4) AS spend, round(marginal_roas, 4) AS marginal_roas FROM placed_returns",
    "opportunities": f"{BASE}{SEG}{SEASONED}{AHEAD}{ELASTIC}{RANKED}, known AS (SELECT *, row_number() OVER (ORDER BY place DESC) AS from_end FROM placed_returns WHERE marginal_roas IS NOT NULL) SELECT 'scale_up' AS action, place::INT AS place, segment_key FROM known WHERE place <= 3 UNION ALL SELECT 'review', place::INT, segment_key FROM known WHERE from_end <= 2",
    "budget_multiplier": _budget(30, "1.3"),
    "budget_channel": _budget(30, "CASE WHEN platform = 'meta' THEN 5000.0 / by_platform ELSE 1.0 END"),
    "budget_total": _budget(60, "20000.0 / whole"),
    "budget_segment": _budget(30, "CASE WHEN segment_key = 'google::Search' THEN 900.0 / by_segment ELSE 1.0 END"),
    "seasonal_index": f"""{BASE}{SEG}{SEASONED},
        spans AS (SELECT m.segment_key, greatest(level, 0) AS weight, growth_annual, level, h AS horizon, k AS day, (origin + k::INT)::DATE AS date
            FROM models m CROSS JOIN (VALUES (30), (60), (90)) v(h) CROSS JOIN range(-89, 91) r(k) CROSS JOIN edge WHERE metric = 'revenue' AND k BETWEEN 1 - h AND h),
        lit AS (SELECT s.*, coalesce(w.factor * d.factor, 1.0) AS season, {_MULT.format(g="growth_annual", d="greatest(day, 0)")} AS mult FROM spans s
            LEFT JOIN week w ON w.segment_key = s.segment_key AND w.metric = 'revenue' AND w.slot = weekofyear(s.date)
            LEFT JOIN dow d ON d.segment_key = s.segment_key AND d.metric = 'revenue' AND d.slot = isodow(s.date) - 1)
        SELECT horizon, round(sum(weight * season) FILTER (WHERE day >= 1) / sum(weight) FILTER (WHERE day >= 1), 5) AS season_next,
            round(sum(weight * season) FILTER (WHERE day < 1) / sum(weight) FILTER (WHERE day < 1), 5) AS season_last,
            round(sum(mult * level) FILTER (WHERE day >= 1 AND level > 0) / sum(level) FILTER (WHERE day >= 1 AND level > 0), 5) AS growth
        FROM lit GROUP BY horizon""",
}
