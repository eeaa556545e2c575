"""Queries for the scenario lookback family."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitwise.functions.timecols import from_micros, micros
from pitwise.operators.lookback import (NEEDS, ROLL_COLS, WINDOWS, history_columns, lookback_raw,
                                        normalize_monetary, rolling_columns)
from pitwise.plans.oracle_lookback import lookback_ctes, training_rows_sql
from pitwise.plans.oracle_views import with_views
from pitwise.plans.registry import query
from pitwise.plans.training import committed_with_outcome, dedup_outcomes, training_rows
from pitwise.sources import views as V


def _all_raw(spark, d, needs: list[str] | None = None) -> DataFrame:
    """Lookback prefix table for every scenario (all branches)."""
    b = V.branches(spark, d)
    return lookback_raw(V.commits(spark, d), b.select("branch_id", "business_id", "committed_at"), needs=needs)


def _roll_query(spark, d, feature: str) -> DataFrame:
    raw = _all_raw(spark, d, NEEDS[feature])
    cols = rolling_columns(raw, rounded=False, only=[feature])
    return raw.select("branch_id", *[cols[f"w{w}_{feature}"].alias(f"w{w}_{feature}") for w in WINDOWS])


def _roll_sql(feature: str) -> str:
    sel = ", ".join(f"r{w}.{feature} AS w{w}_{feature}" for w in WINDOWS)
    joins = " ".join(f"JOIN roll r{w} ON r{w}.branch_id = s.branch_id AND r{w}.w = {w}" for w in WINDOWS)
    return with_views(["pc", "branches"], f"SELECT s.branch_id, {sel} FROM branches s {joins}",
                      lookback_ctes("branches"))


_ROLL_KEYS = {
    "w_order_count": "order_count",
    "w_revenue_total": "revenue_total",
    "w_revenue_per_day": "revenue_per_day",
    "w_cancel_rate": "cancel_rate",
    "w_blocked_rate": "blocked_rate",
    "w_restock_count": "restock_count",
    "w_price_change_count": "price_change_count",
    "w_avg_price_change": "avg_price_change_pct",
    "w_latest_cash": "latest_cash_balance",
    "w_cash_trend": "cash_trend",
    "w_inventory_trend": "inventory_trend",
    "w_weighted_orders": "weighted_order_count",
}


def _register_roll(key: str, feature: str) -> None:
    @query(key, _roll_sql(feature))
    def _q(spark, d):
        return _roll_query(spark, d, feature)
    _q.__doc__ = f"A-family rolling column {feature} for w in 7/30/90, every scenario."


for _k, _f in _ROLL_KEYS.items():
    _register_roll(_k, _f)


@query("empty_window", with_views(
    ["pc", "branches"],
    "SELECT r.branch_id, " + ", ".join(f"r.{c} AS w7_{c}" for c in ROLL_COLS)
    + " FROM roll r WHERE r.w = 7 AND r.n_all = 0",
    lookback_ctes("branches")))
def empty_window(spark, d):
    """Scenarios whose 7-day window is empty -> all twelve values 0."""
    raw = _all_raw(spark, d)
    cols = rolling_columns(raw, rounded=False)
    return (raw.filter((F.col("n_all@0") - F.col("n_all@7")) == 0)
            .select("branch_id", *[cols[f"w7_{c}"].alias(f"w7_{c}") for c in ROLL_COLS]))


_NORM = ["revenue_total", "revenue_per_day", "latest_cash_balance", "cash_trend"]


@query("w_normalize", with_views(
    ["pc", "branches"],
    "SELECT s.branch_id, " + ", ".join(f"r{w}.{c} AS w{w}_{c}" for w in WINDOWS for c in _NORM)
    + " FROM branches s " + " ".join(
        f"JOIN rolln r{w} ON r{w}.branch_id = s.branch_id AND r{w}.w = {w}" for w in WINDOWS),
    lookback_ctes("branches")))
def w_normalize(spark, d):
    """Monetary columns normalised by the w90 baselines."""
    raw = _all_raw(spark, d)
    cols = normalize_monetary(rolling_columns(raw, rounded=False), rounded=False)
    return raw.select("branch_id", *[cols[f"w{w}_{c}"].alias(f"w{w}_{c}") for w in WINDOWS for c in _NORM])


def _hist_sql(cols: list[str], scen: str = "branches") -> str:
    return with_views(["pc", "sel" if scen == "sel" else "branches"],
                      f"SELECT h.branch_id, {', '.join('h.' + c for c in cols)} FROM histc h",
                      lookback_ctes(scen))


def _hist_query(spark, d, cols: list[str]) -> DataFrame:
    raw = _all_raw(spark, d)
    h = history_columns(raw)
    return raw.select("branch_id", *[h[c].alias(c) for c in cols])


for _k, _cols in {
    "n_prior": ["n_prior"],
    "hist_avg_price_change": ["hist_avg_price_change"],
    "n_past_price_changes": ["n_past_price_changes"],
    "avg_restock": ["avg_restock"],
    "history_depth": ["history_depth_days"],
}.items():
    def _mk(cols):
        def _q(spark, d):
            return _hist_query(spark, d, cols)
        return _q
    query(_k, _hist_sql(_cols))(_mk(_cols))


@query("prior_commits", _hist_sql(["n_prior"], "sel"))
def prior_commits(spark, d):
    """commits strictly before each committed scenario with an outcome."""
    sel = committed_with_outcome(V.branches(spark, d), V.outcomes(spark, d))
    raw = lookback_raw(V.commits(spark, d), sel.select("branch_id", "business_id", "committed_at"))
    return raw.select("branch_id", F.col("n_all@0").alias("n_prior"))


@query("window_bounds", with_views(
    ["pc", "branches"],
    "SELECT s.branch_id, " + ", ".join(
        f"s.committed_at - to_days({w}) AS w{w}_lo, r{w}.n_all AS w{w}_n_commits" for w in WINDOWS)
    + ", s.committed_at AS hi FROM branches s " + " ".join(
        f"JOIN roll r{w} ON r{w}.branch_id = s.branch_id AND r{w}.w = {w}" for w in WINDOWS),
    lookback_ctes("branches")))
def window_bounds(spark, d):
    """half-open [b - w, b) bounds and the commits inside each."""
    raw = _all_raw(spark, d)
    cols = []
    for w in WINDOWS:
        cols += [from_micros(F.col("b") - F.lit(w * 86_400_000_000)).alias(f"w{w}_lo"),
                 (F.col("n_all@0") - F.col(f"n_all@{w}")).alias(f"w{w}_n_commits")]
    return raw.select("branch_id", *cols, from_micros(F.col("b")).alias("hi"))


@query("asof_range_join", with_views(
    ["pc", "branches"], "SELECT branch_id, w, n_all AS n_commits, n_order AS n_orders FROM win",
    lookback_ctes("branches")))
def asof_range_join(spark, d):
    """Business equi + [b - w, b) interval join, x3 windows (long form)."""
    raw = _all_raw(spark, d)
    wide = F.array(*[F.struct(F.lit(w).alias("w"), (F.col("n_all@0") - F.col(f"n_all@{w}")).alias("n_commits"),
                              (F.col("n_order@0") - F.col(f"n_order@{w}")).alias("n_orders")) for w in WINDOWS])
    return raw.select("branch_id", F.inline(wide))


@query("commits_by_business", with_views(
    ["commits"], 'SELECT business_id, count(*) AS n_commits, min("timestamp") AS first_ts, '
                 'max("timestamp") AS last_ts FROM commits GROUP BY business_id'))
def commits_by_business(spark, d):
    """The business -> commits index, as per-business extent."""
    return (V.commits(spark, d).groupBy("business_id")
            .agg(F.count(F.lit(1)).alias("n_commits"), F.min("timestamp").alias("first_ts"),
                 F.max("timestamp").alias("last_ts")))


@query("committed_with_outcome", with_views(["sel"], "SELECT branch_id, business_id FROM sel"))
def committed_with_outcome_q(spark, d):
    """F1 + J3: status = committed AND an outcome exists."""
    return committed_with_outcome(V.branches(spark, d), V.outcomes(spark, d)).select(
        "branch_id", "business_id")


@query("outcome_join", with_views(
    ["outcomes"],
    "SELECT branch_id, outcome_id, inventory_delta, cashflow_delta, order_velocity_delta FROM "
    "(SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY seq DESC) AS rn FROM outcomes) "
    "WHERE rn = 1"))
def outcome_join(spark, d):
    """One outcome per branch, last one wins."""
    return dedup_outcomes(V.outcomes(spark, d)).select(
        "branch_id", "outcome_id", "inventory_delta", "cashflow_delta", "order_velocity_delta")


@query("min_history", with_views(
    ["pc", "sel"],
    "SELECT CASE WHEN n_prior >= 10 THEN 'kept' ELSE 'skipped' END AS status, count(*) AS n "
    "FROM histc GROUP BY 1", lookback_ctes("sel")))
def min_history(spark, d):
    """scenarios kept / skipped for fewer than 10 prior commits."""
    from pitwise.plans.training import skip_report
    return skip_report(V.commits(spark, d), V.branches(spark, d), V.outcomes(spark, d))


def t1(spark, d, rounded=False) -> DataFrame:
    return training_rows(V.commits(spark, d), V.branches(spark, d), V.outcomes(spark, d),
                         rounded=rounded)


@query("training_rows", training_rows_sql())
def training_rows_q(spark, d):
    """T1 flagship: 81-column training rows (full precision)."""
    return t1(spark, d)


def _over_t1(body: str) -> str:
    # Wrap the T1 oracle as a CTE named t1.
    return "WITH t1 AS (" + training_rows_sql() + ")\n" + body


@query("category_counts", _over_t1("SELECT category, count(*) AS n_rows FROM t1 GROUP BY category"))
def category_counts(spark, d):
    """Training rows per category."""
    return t1(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("category")


@query("dataset_profile", _over_t1(
    "SELECT count(*) AS n_rows, min(committed_at) AS min_committed_at, "
    "max(committed_at) AS max_committed_at, count(DISTINCT business_id) AS n_businesses FROM t1"))
def dataset_profile(spark, d):
    """Rows, date range and distinct businesses of the training set."""
    return t1(spark, d).agg(F.count(F.lit(1)).alias("n_rows"),
                            F.min("committed_at").alias("min_committed_at"),
                            F.max("committed_at").alias("max_committed_at"),
                            F.count_distinct("business_id").alias("n_businesses"))


__all__ = ["t1", "micros"]
