"""Time helpers (P1-P4) as column expressions.

All times are naive (``timestamp_ntz``) and interpreted as UTC. Arithmetic
happens on integer microseconds so boundaries are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_US = 86_400_000_000
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since epoch of a naive timestamp (time-zone independent)."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), _c(ts))


def from_micros(m) -> Column:
    """Inverse of :func:`micros`; returns ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", _c(m), F.expr(EPOCH_NTZ))


def floor_div(a, b: int) -> Column:
    """Exact integer floor division by a positive constant (also for a < 0).

    ``a - pmod(a, b)`` is an exact multiple of ``b``, so the division is exact.
    """
    a = _c(a)
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def floor_days(delta_us) -> Column:
    """Python ``timedelta.days`` of a microsecond delta: floors, also below 0."""
    return floor_div(delta_us, DAY_US)


def parse_ts(text) -> Column:
    """ISO-8601 text -> naive timestamp; malformed text raises (ANSI)."""
    return F.to_timestamp_ntz(_c(text))


def utc_normalize(text) -> Column:
    """Text with or without an offset -> naive UTC timestamp.

    Offsets are honoured; text without an offset is taken as UTC (session
    time zone is UTC)."""
    return from_micros(F.unix_micros(_c(text).cast("timestamp")))


def coerce_ts(text) -> Column:
    """Lenient parse, anything unparseable -> NULL."""
    return _c(text).try_cast("timestamp_ntz")


def coerce_num(x, default: float = 0.0) -> Column:
    """``to_numeric(errors='coerce').fillna(default)``; NaN also -> default."""
    v = _c(x).try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(v)


def iso_text(ts) -> Column:
    """``datetime.isoformat()`` text of a naive timestamp."""
    t = _c(ts)
    return F.when(F.date_format(t, "SSSSSS") == "000000",
                  F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))

