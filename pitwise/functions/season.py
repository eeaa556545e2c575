"""Calendar encoders (X1-X4) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from pitwise.functions.timecols import DAY_US, floor_days, micros

# Seasonal peak months per business category.
SEASONAL_PEAKS = {
    "retail": [11, 12],
    "apparel": [3, 4, 9, 10],
    "b2b": [3, 6, 9, 12],
}
UNKNOWN_CATEGORY_PEAK_DAYS = 180
SHOP_PEAK_MONTH = 12
SHOP_PEAK_DAY = 15

SEASON_COLS = [
    "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos",
    "week_of_month_sin", "week_of_month_cos", "days_to_peak",
    "days_to_peak_sin", "days_to_peak_cos", "is_peak_month", "is_weekend",
    "quarter",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cyclic_encode(value, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*value/period."""
    angle = F.lit(2.0 * math.pi) * _c(value).cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def days_to_peak(ts, category) -> Column:
    """Cyclic month distance to the nearest peak month of the category, x30.

    Unknown category -> 180."""
    m = F.month(_c(ts))
    cat = _c(category)
    expr = F.lit(UNKNOWN_CATEGORY_PEAK_DAYS)
    for name, peaks in SEASONAL_PEAKS.items():
        dists = []
        for p in peaks:
            d = F.abs(m - F.lit(p))
            dists.append(F.least(d, F.lit(12) - d) * F.lit(30))
        expr = F.when(cat == F.lit(name), F.least(F.lit(365), *dists)).otherwise(expr)
    return expr


def is_peak_month(ts, category) -> Column:
    m = F.month(_c(ts))
    cat = _c(category)
    expr = F.lit(0)
    for name, peaks in SEASONAL_PEAKS.items():
        expr = F.when(cat == F.lit(name), m.isin(*peaks).cast("int")).otherwise(expr)
    return expr


def _r(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def season_core(ts, category, rounded: bool = False) -> dict[str, Column]:
    """The 12 seasonality columns of the scenario rows (sin/cos rounded
    to 6 places when ``rounded``)."""
    t = _c(ts)
    d6 = 6 if rounded else None
    month = F.month(t)
    dow = F.weekday(t)                      # Monday = 0
    wom = F.least(F.floor((F.dayofmonth(t) - 1) / 7), F.lit(3))
    peak = days_to_peak(t, category)
    ms, mc = cyclic_encode(month, 12)
    ds, dc = cyclic_encode(dow, 7)
    ws, wc = cyclic_encode(wom, 4)
    ps, pc = cyclic_encode(peak, 182)
    return {
        "month_sin": _r(ms, d6), "month_cos": _r(mc, d6),
        "day_of_week_sin": _r(ds, d6), "day_of_week_cos": _r(dc, d6),
        "week_of_month_sin": _r(ws, d6), "week_of_month_cos": _r(wc, d6),
        "days_to_peak": peak.cast("int"),
        "days_to_peak_sin": _r(ps, d6), "days_to_peak_cos": _r(pc, d6),
        "is_peak_month": is_peak_month(t, category),
        "is_weekend": (dow >= 5).cast("int"),
        "quarter": F.quarter(t),
    }


def shop_days_to_peak(ts) -> Column:
    """X4 helper: abs(floor days from Dec 15 of the same year); the floor is
    taken before abs (Dec 14 12:00 -> 1)."""
    t = _c(ts)
    peak = F.make_timestamp_ntz(F.year(t), F.lit(SHOP_PEAK_MONTH), F.lit(SHOP_PEAK_DAY),
                                F.lit(0), F.lit(0), F.lit(0))
    return F.abs(floor_days(micros(t) - micros(peak)))


def season_shop(ts) -> dict[str, Column]:
    """The order-export variant (week period 5, peak Dec 15, no rounding)."""
    t = _c(ts)
    month = F.month(t)
    dow = F.weekday(t)
    wom = F.floor((F.dayofmonth(t) - 1) / 7) + 1
    peak = shop_days_to_peak(t)
    ms, mc = cyclic_encode(month, 12)
    ds, dc = cyclic_encode(dow, 7)
    ws, wc = cyclic_encode(wom, 5)
    ps, pc = cyclic_encode(peak, 365)
    return {
        "month_sin": ms, "month_cos": mc,
        "day_of_week_sin": ds, "day_of_week_cos": dc,
        "week_of_month_sin": ws, "week_of_month_cos": wc,
        "days_to_peak": peak,
        "days_to_peak_sin": ps, "days_to_peak_cos": pc,
        "is_peak_month": (month == SHOP_PEAK_MONTH).cast("int"),
        "is_weekend": (dow >= 5).cast("int"),
        "quarter": F.quarter(t),
    }


__all__ = ["cyclic_encode", "days_to_peak", "is_peak_month", "season_core",
           "season_shop", "shop_days_to_peak", "SEASON_COLS", "SEASONAL_PEAKS", "DAY_US"]
