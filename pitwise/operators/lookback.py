"""Point-in-time lookback features for scenarios.

One pass computes everything: each commit becomes one row of additive
contributions and (optionally) a cash / inventory point; each scenario becomes
one row that asks. A single :func:`offset_scan` over both returns, per scenario
at time b, the sums over all commits before b, b-7d, b-30d and b-90d, the latest
points before b and the first points at or after each b-w. A window [b-w, b) is
then ``sum(b) - sum(b-w)``; nothing is re-scanned per window and no (scenario,
commit) pair is ever materialised.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pitwise.functions import exactsum
from pitwise.functions.payload import field, parse_payload
from pitwise.functions.timecols import DAY_US, floor_days, floor_div, micros
from pitwise.operators.scan import key_sizes, offset_scan, point

# Lookback windows (days), decay half-life (days).
WINDOWS = (7, 30, 90)
HALF_LIFE_DAYS = 30

# Decayed counts are sums of exp(lambda (t - anchor)), the anchor being the start of the
# period of PERIOD_DAYS that t lies in. A weight is between 1 and 16 and is summed as two
# whole numbers, so sums do not depend on their order and dates may be any. No window is
# longer than a period, so it meets at most one even and one odd period; the two are
# summed apart, and each has one anchor in a window.
PERIOD_DAYS = 4 * HALF_LIFE_DAYS
_HIGH, _LOW = 2.0 ** 20, 2.0 ** 32
LAMBDA_PER_US = math.log(2) / (HALF_LIFE_DAYS * DAY_US)

ROLL_COLS = [
    "order_count", "revenue_total", "revenue_per_day", "cancel_rate", "blocked_rate",
    "restock_count", "price_change_count", "avg_price_change_pct", "latest_cash_balance",
    "cash_trend", "inventory_trend", "weighted_order_count",
]
HIST_COLS = ["n_prior", "hist_avg_price_change", "n_past_price_changes", "avg_restock",
             "history_depth_days"]

COUNTS = ["n_all", "n_order", "n_cancel", "n_blocked", "n_restock", "n_price", "n_price_valid", "n_rs_valid", "n_cash", "n_inv"]
AMOUNTS = ["rev", "price_sum", "rs_sum"]
DECAYED = ["even_h", "even_l", "odd_h", "odd_l"]
SUMS = COUNTS + DECAYED + [part for x in AMOUNTS for part in exactsum.names(x)]
POINTS = ["cash_pt", "inv_pt"]

#: What each rolling column (A1-A12) is made of; nothing else needs to be in the plan.
NEEDS = {
    "order_count": ["n_order"], "revenue_total": exactsum.names("rev"), "revenue_per_day": exactsum.names("rev"),
    "cancel_rate": ["n_cancel", "n_order"], "blocked_rate": ["n_blocked", "n_order"], "restock_count": ["n_restock"],
    "price_change_count": ["n_price"], "avg_price_change_pct": ["n_price", *exactsum.names("price_sum")],
    "latest_cash_balance": ["n_cash", "cash_pt"], "cash_trend": ["n_cash", "cash_pt"],
    "inventory_trend": ["n_inv", "inv_pt"], "weighted_order_count": DECAYED,
}


def with_seq(commits: DataFrame) -> DataFrame:
    """Commits with their order within one instant: ``seq``, or the commit id where the source has none."""
    return commits if "seq" in commits.columns else commits.withColumn("seq", F.col("commit_id"))


def commit_events(commits: DataFrame) -> DataFrame:
    """The commit columns the lookback needs: key, t (micros), seq, type, payload."""
    return with_seq(commits).select(F.col("business_id"), micros(F.col("timestamp")).alias("t"),
                          F.col("seq"), F.col("event_type"), F.col("payload"))


def decayed(t: Column, when: Column) -> list[Column]:
    """The DECAYED columns of a row at time ``t`` (micros): its weight in its period, in two parts; NULL elsewhere."""
    period = floor_div(t, PERIOD_DAYS * DAY_US)
    weight = F.exp((t - period * F.lit(PERIOD_DAYS * DAY_US)).cast("double") * F.lit(LAMBDA_PER_US)) * F.lit(_HIGH)
    high = F.rint(weight)
    parts = [high.cast("long"), F.rint((weight - high) * F.lit(_LOW)).cast("long")]
    odd = F.pmod(period, F.lit(2))
    return [F.when(when & (odd == q), x).alias(f"{name}_{k}")
            for q, name in enumerate(("even", "odd")) for k, x in zip("hl", parts, strict=True)]


def decayed_total(b: Column, value) -> Column:
    """The decayed count at ``b`` of a window's sums; ``value`` gives the sum of a DECAYED column in the window."""
    period = floor_div(b, PERIOD_DAYS * DAY_US)
    out = []
    for q, name in enumerate(("even", "odd")):
        own = F.when(F.pmod(period, F.lit(2)) == q, period).otherwise(period - 1)
        age = (b - own * F.lit(PERIOD_DAYS * DAY_US)).cast("double")
        weight = value(f"{name}_h").cast("double") / F.lit(_HIGH) + value(f"{name}_l").cast("double") / F.lit(_HIGH * _LOW)
        out.append(weight * F.exp(-age * F.lit(LAMBDA_PER_US)))
    return out[0] + out[1]


def add_contributions(c: DataFrame) -> DataFrame:
    """Adds the contribution columns to rows of commits; scenarios (``_asks``) get NULLs. Row-local: parses each payload once."""
    c = c.withColumn("_p", parse_payload(F.col("payload")))
    p = F.col("_p")
    is_ev = ~F.col("_asks")
    et = F.when(is_ev, F.col("event_type"))
    is_order = et == "ORDER_RECEIVED"
    is_ful = et == "ORDER_FULFILLED"
    is_price = et == "PRICE_CHANGE"
    is_rs = et == "INVENTORY_RESTOCK"
    is_ledger = et == "LEDGER_ENTRY"
    valid = p.isNotNull()
    inv_after = field(p, "inventory_after", -1.0)
    is_inv = is_ledger | (is_ful & (inv_after >= 0))

    def flag(cond: Column) -> Column:
        return cond.cast("long")

    c = c.select(
        *[x for x in c.columns if x not in ("_p", "event_type", "payload")],
        F.when(is_ev, F.lit(1).cast("long")).alias("n_all"),
        flag(is_order).alias("n_order"),
        flag(et == "ORDER_CANCELLED").alias("n_cancel"),
        flag(et == "FULFILLMENT_BLOCKED").alias("n_blocked"),
        flag(et.isin("INVENTORY_RESTOCK", "SUPPLIER_PO_CREATED")).alias("n_restock"),
        flag(is_price).alias("n_price"),
        flag(is_price & valid).alias("n_price_valid"),
        flag(is_rs & valid).alias("n_rs_valid"),
        flag(is_ledger).alias("n_cash"),
        flag(is_inv).alias("n_inv"),
        # an invalid payload counts 0 among the rolling changes, so one sum serves the history rule too
        F.when(is_order, field(p, "revenue", 0.0)).alias("rev"),
        F.when(is_price, field(p, "pct_change", 0.0)).alias("price_sum"),
        F.when(is_rs, field(p, "quantity_added", 0.0)).alias("rs_sum"),
        *decayed(F.col("t"), is_order),
        point("t", ["seq"], field(p, "cash_balance", 0.0), is_ledger).alias("cash_pt"),
        point("t", ["seq"],
              F.when(is_ledger, field(p, "inventory_units", 0.0)).otherwise(inv_after),
              is_inv).alias("inv_pt"),
        F.when(is_ev, F.col("t")).alias("ev_t"),
    )
    return exactsum.split(c, *AMOUNTS)


def lookback_raw(commits: DataFrame, scenarios: DataFrame, windows=WINDOWS, counted: DataFrame | None = None,
                 needs: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Per scenario (branch_id): sums and points at b and at each b - w (of ``needs``: all of SUMS and POINTS by default).

    Columns: branch_id, b, ``{sum}@{w}`` for w in (0, *windows),
    ``last_cash``, ``last_inv`` (latest points before b),
    ``first_cash@w`` / ``first_inv@w`` (first points at or after b - w),
    ``first_t`` (the business's first commit time, if before b). Commits without a time count nowhere.
    ``carry``: further columns of ``scenarios`` that are returned.
    ``counted``: rows whose business_id tells how many scenarios a key has, where ``scenarios`` itself is costly to count.
    """
    if max(windows) > PERIOD_DAYS:
        raise ValueError(f"windows may not be longer than {PERIOD_DAYS} days")
    ev = commit_events(commits).where("t IS NOT NULL").withColumn("_asks", F.lit(False))
    b = micros(F.col("committed_at"))
    carry = carry or []
    asks = scenarios.select("branch_id", "business_id", b.alias("b"), b.alias("t"), F.lit(True).alias("_asks"), *carry)
    sizes = key_sizes(ev.select("business_id").unionByName((asks if counted is None else counted).select("business_id")), "business_id")
    both = ev.unionByName(asks, allowMissingColumns=True)
    at = {0: 0} | {w: -w * DAY_US for w in windows}

    sums, points = ([x for x in every if needs is None or x in needs] for every in (SUMS, POINTS))

    def scan(rows: DataFrame, periods: int) -> DataFrame:
        found = offset_scan(rows, "business_id", "t", at, ids=["branch_id"], sums=sums, lasts=points, firsts=points,
                            periods=periods).where("_asks")
        return found.selectExpr(
            "branch_id", "b", *carry, *[f"`{x}@{w}`" for w in at for x in sums],
            *[f"`first_{x}@{w}` AS `first_{x[:-3]}@{w}`" for w in windows for x in points],
            *[f"`{x}@0` AS last_{x[:-3]}" for x in points], "least(first_ev_t, b) AS first_t")

    first_t = "min(ev_t) OVER (PARTITION BY business_id) AS first_ev_t"
    # Row-local work (payload parsing) after the exchange runs in every shuffle partition, not only in the scan tasks, and
    # after the sort, which so holds narrow rows.
    cold = sizes.part(both, hot=False).repartition("business_id").sortWithinPartitions("business_id", "t")
    cold = add_contributions(cold).select("*", F.expr(first_t))
    out = scan(cold, 0)
    if sizes.hot is not None:
        hot = add_contributions(sizes.part(both, hot=True))
        starts = hot.groupBy(F.col("business_id").alias("_b")).agg(F.min("ev_t").alias("first_ev_t"))
        hot = hot.join(starts, F.col("business_id").eqNullSafe(F.col("_b"))).drop("_b")
        out = out.unionByName(scan(hot, sizes.periods()))
    return out


def _d(c: Column) -> Column:
    return c.cast("double")


def _trend(last: Column, first: Column, n: Column) -> Column:
    span = F.greatest(floor_days(last.getField("t") - first.getField("t")), F.lit(1))
    return F.when(n >= 2, (last.getField("v") - first.getField("v")) / span).otherwise(F.lit(0.0))


def rolling_columns(raw: DataFrame, windows=WINDOWS, rounded: bool = False, only: list[str] | None = None) -> dict[str, Column]:
    """A1-A12 per window from :func:`lookback_raw` output (before A14); ``only`` some of ROLL_COLS."""
    out: dict[str, Column] = {}

    def r(c: Column, k: int) -> Column:
        return F.round(c, k) if rounded else c

    for w in windows:
        def part(x: str, w=w) -> str:
            return f"(`{x}@0` - `{x}@{w}`)"

        def win(x: str) -> Column:
            return F.expr(part(x))

        def revenue() -> Column:
            return exactsum.total("rev", part)

        def trend(x: str, n: str, w=w) -> Column:
            return _trend(F.col(f"last_{x}"), F.col(f"first_{x}@{w}"), win(n))

        rules = {
            "order_count": lambda: win("n_order"),
            "revenue_total": lambda: r(revenue(), 2),
            "revenue_per_day": lambda w=w: r(revenue() / F.lit(float(w)), 4),
            "cancel_rate": lambda: r(F.least(win("n_cancel") / F.greatest(win("n_order"), F.lit(1)), F.lit(1.0)), 4),
            "blocked_rate": lambda: r(win("n_blocked") / F.greatest(win("n_order") + win("n_blocked"), F.lit(1)), 4),
            "restock_count": lambda: win("n_restock"),
            "price_change_count": lambda: win("n_price"),
            "avg_price_change_pct": lambda: r(
                F.when(win("n_price") > 0, exactsum.total("price_sum", part) / win("n_price")).otherwise(F.lit(0.0)), 4),
            "latest_cash_balance": lambda: r(F.when(win("n_cash") >= 1, F.col("last_cash").getField("v")).otherwise(F.lit(0.0)), 2),
            "cash_trend": lambda: r(trend("cash", "n_cash"), 4),
            "inventory_trend": lambda: r(trend("inv", "n_inv"), 4),
            "weighted_order_count": lambda: r(decayed_total(F.col("b"), win), 4),
        }
        out |= {f"w{w}_{c}": rules[c]() for c in only or ROLL_COLS}
    return out


def normalize_monetary(cols: dict[str, Column], windows=WINDOWS, base_window: int = 90,
                       rounded: bool = False) -> dict[str, Column]:
    """Revenue vs the w90 revenue-per-day baseline, cash vs the w90
    latest cash baseline (0 -> 1.0; a negative baseline leaves values as is)."""
    out = dict(cols)
    rev_base = cols[f"w{base_window}_revenue_per_day"]
    cash_base = cols[f"w{base_window}_latest_cash_balance"]
    rev_base = F.when(rev_base == 0, F.lit(1.0)).otherwise(rev_base)
    cash_base = F.when(cash_base == 0, F.lit(1.0)).otherwise(cash_base)

    def r(c):
        return F.round(c, 6) if rounded else c

    for w in windows:
        rt, rp = cols[f"w{w}_revenue_total"], cols[f"w{w}_revenue_per_day"]
        lc, ct = cols[f"w{w}_latest_cash_balance"], cols[f"w{w}_cash_trend"]
        out[f"w{w}_revenue_total"] = F.when(rev_base > 0, r(rt / (rev_base * F.lit(float(w))))).otherwise(rt)
        out[f"w{w}_revenue_per_day"] = F.when(rev_base > 0, r(rp / rev_base)).otherwise(rp)
        out[f"w{w}_latest_cash_balance"] = F.when(cash_base > 0, r(lc / cash_base)).otherwise(lc)
        out[f"w{w}_cash_trend"] = F.when(cash_base > 0, r(ct / cash_base)).otherwise(ct)
    return out


def history_columns(raw: DataFrame) -> dict[str, Column]:
    """A15-A19 (unbounded history strictly before b)."""
    n_prior = F.col("n_all@0")
    npv = F.col("n_price_valid@0")
    nrs = F.col("n_rs_valid@0")

    def all_of(x: str) -> str:
        return f"`{x}@0`"

    return {
        "n_prior": n_prior,
        "hist_avg_price_change": F.when(npv > 0, exactsum.total("price_sum", all_of) / npv).otherwise(F.lit(0.0)),
        "n_past_price_changes": npv,
        "avg_restock": F.when(nrs > 0, exactsum.total("rs_sum", all_of) / nrs),
        "history_depth_days": F.when(n_prior > 0, floor_days(F.col("b") - F.col("first_t")))
                               .otherwise(F.lit(0).cast("long")),
    }
