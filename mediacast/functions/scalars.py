"""Column functions: campaign taxonomy, guarded ratios, calendar and response curves. All JVM-side."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def matches(name: Column, *patterns: str) -> Column:
    """Whether one of the patterns occurs in the name, in any case."""
    return name.rlike("(?i)" + "|".join(patterns))


def _chosen(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def hundredths(x: Column, precision: int) -> Column:
    """A double as hundredths, rounded as a cast to decimal(precision, 2) rounds, which goes by way of text.

    A double that equals whole hundredths needs no cast: no two numbers of so few digits are the same double.
    """
    near = F.rint(x * 100)
    exact = (F.abs(near) < float(10**precision)) & (near / 100 == x)
    return F.when(exact, near.cast("long")).otherwise((x.cast(f"decimal({precision},2)") * 100).cast("long"))


def whole_sum(units: Column, places: int) -> Column:
    """The sum of whole units of ``places`` decimal places as a decimal; upper and lower bits are summed apart, so that it can't overflow."""
    high, low = F.sum(F.shiftright(units, 30)), F.sum(units.bitwiseAND((1 << 30) - 1))
    whole = high.cast("decimal(19,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low.cast("decimal(19,0)")
    return (whole * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(27,{places})")


def campaign_type(raw: Column, name: Column) -> Column:
    """Native type if it is known, as written or in upper case with underscores; else the first name rule that matches."""
    trimmed = F.trim(raw)
    known = F.create_map(*[F.lit(x) for pair in config.NATIVE_TYPES.items() for x in pair])
    normal = F.replace(F.upper(trimmed), F.lit(" "), F.lit("_"))
    named = _chosen([(matches(F.coalesce(name, F.lit("")), p), F.lit(t)) for p, t in config.NAME_TYPES], F.lit("Other"))
    return F.coalesce(F.try_element_at(known, trimmed), F.try_element_at(known, normal), named)


def brand_intent(name: Column) -> Column:
    name = F.coalesce(name, F.lit(""))
    return F.when(matches(name, *config.NON_BRAND), "Non-Brand").when(matches(name, *config.BRAND), "Brand").otherwise("Unknown")


def roas(revenue: Column, spend: Column) -> Column:
    """Revenue over spend; 0 where neither is positive, null where only spend isn't."""
    return F.when(spend > 0, revenue / spend).when((spend <= 0) & (revenue <= 0), F.lit(0.0))


def nth_weekday(year: Column, month: int, day: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), day), 7 * (n - 1))


def thanksgiving(year: Column) -> Column:
    return nth_weekday(year, 11, "THU", 4)


def event_name(date: Column) -> Column:
    """The first of the year-end windows that holds the date, or the empty string."""
    t = thanksgiving(F.year(date))
    month, day = F.month(date), F.dayofmonth(date)
    windows = [
        (date >= F.date_sub(t, 1)) & (date <= F.date_add(t, 2)),
        (date >= F.date_add(t, 4)) & (date <= F.date_add(t, 8)),
        (month == 12) & (day <= 23),
        (month == 12) & (day >= 24),
        (month == 1) & (day <= 15),
    ]
    return _chosen([(w, F.lit(e[0])) for w, e in zip(windows, config.EVENTS, strict=True)], F.lit(""))


def event_uplift(name: Column) -> Column:
    return _chosen([(name == e, F.lit(u)) for e, u, _ in config.EVENTS], F.lit(1.0))


def us_holiday(date: Column) -> Column:
    """Whether the date is a US federal holiday by its rule, or the weekday that observes it."""
    def observed(month: int, day: int, year: Column) -> Column:
        d = F.make_date(year, F.lit(month), F.lit(day))
        return (date == d) | (date == F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)))

    y = F.year(date)
    fixed = observed(1, 1, y) | observed(1, 1, y + 1) | observed(7, 4, y) | observed(11, 11, y) | observed(12, 25, y)
    fixed = fixed | ((y >= 2021) & observed(6, 19, y))
    last_monday = F.next_day(F.date_sub(F.make_date(y, F.lit(6), F.lit(1)), 8), "MON")
    moving = [nth_weekday(y, 1, "MON", 3), nth_weekday(y, 2, "MON", 3), last_monday, nth_weekday(y, 9, "MON", 1), nth_weekday(y, 10, "MON", 2), thanksgiving(y)]
    for d in moving:
        fixed = fixed | (date == d)
    return F.coalesce(fixed, F.lit(False))


def growth_multiplier(days: Column, annual: Column) -> Column:
    """Damped growth after so many days: months' increments shrink by a constant factor; clipped to [0.4, 2.5]."""
    months = (1 - F.pow(F.lit(config.DAMPING), days / 30.0)) / (1 - config.DAMPING)
    return F.least(F.greatest(F.pow(1 + annual, months / 12.0), F.lit(0.4)), F.lit(2.5))


def response_multiplier(spend: Column, base: Column, beta: Column, strict_zero: bool = False) -> Column:
    """(spend / base) ** beta, and 1 where that isn't defined. ``strict_zero``: no spend, no revenue."""
    ratio = F.when(base > 0, spend / base)
    out = F.when(ratio > 0, F.pow(ratio, beta)).otherwise(F.lit(1.0))
    return F.when((base > 0) & (spend <= 0), F.lit(0.0)).otherwise(out) if strict_zero else out


def marginal_roas(spend: Column, scale: Column, beta: Column) -> Column:
    return F.when((spend > 0) & scale.isNotNull(), scale * beta * F.pow(spend, beta - 1))


def average_roas(spend: Column, scale: Column, beta: Column) -> Column:
    return F.when((spend > 0) & scale.isNotNull(), scale * F.pow(spend, beta - 1))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def pooling_weight(n: Column) -> Column:
    return n / (n + config.POOL_K)
