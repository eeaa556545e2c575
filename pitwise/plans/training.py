"""One leakage-free training row per committed scenario (81 columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitwise.functions.encode import BT_COLS, CAT_COLS, onehot_branch_type, onehot_category
from pitwise.functions.scenario import MAG_COLS, parse_params, scenario_magnitudes
from pitwise.functions.season import SEASON_COLS, season_core
from pitwise.functions.timecols import from_micros
from pitwise.operators.lookback import (ROLL_COLS, WINDOWS, history_columns, lookback_raw,
                                        normalize_monetary, rolling_columns)
from pitwise.sources.schemas import ID_COLS, LABELS

MIN_PRIOR_COMMITS = 10
HORIZON_DAYS = 14

DELTA_COLS = MAG_COLS + ["history_depth_days", "n_past_price_changes", "hist_avg_price_change"]
ROLLING_OUT = [f"w{w}_{c}" for w in WINDOWS for c in ROLL_COLS]
TRAINING_COLS = ID_COLS + ROLLING_OUT + SEASON_COLS + DELTA_COLS + CAT_COLS + BT_COLS + LABELS


def dedup_outcomes(outcomes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One outcome per branch; with duplicates the last one wins.

    "Last" is the largest ``order`` (default ``seq`` if present, else
    (recorded_at, outcome_id)). ``max_by`` is a partial aggregate, so the
    dedup pre-aggregates before its shuffle."""
    if order is None:
        order = ["seq"] if "seq" in outcomes.columns else ["recorded_at", "outcome_id"]
    cols = [c for c in outcomes.columns if c != "branch_id"]
    return (outcomes.groupBy("branch_id")
            .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_o"))
            .select("branch_id", "_o.*"))


def committed_with_outcome(branches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """F1 + J2 (+ J3): committed scenarios that have an outcome, with labels."""
    o = dedup_outcomes(outcomes)
    labels = {"label_inventory_delta": "inventory_delta", "label_cashflow_delta": "cashflow_delta",
              "label_order_velocity_delta": "order_velocity_delta"}
    values = {k: F.col(v).cast("double") for k, v in labels.items()}
    if "horizon_days" in o.columns:
        wrong = F.raise_error(F.concat(F.lit(f"an outcome's horizon is not {HORIZON_DAYS} days: "),
                                       F.col("horizon_days").cast("string"))).cast("double")
        values = {k: F.when(F.coalesce(F.col("horizon_days"), F.lit(HORIZON_DAYS)) != HORIZON_DAYS, wrong).otherwise(v)
                  for k, v in values.items()}
    o = o.select("branch_id", *[v.alias(k) for k, v in values.items()])
    b = branches.filter(F.col("status") == "committed").select(
        "branch_id", "business_id", "category", "branch_type", "branch_params", "committed_at")
    return b.join(o, "branch_id", "inner")


def scenario_feature_columns(raw: DataFrame, rounded: bool) -> dict[str, Column]:
    """Rolling (A1-A14), history (A15-A19) and scenario (X11-X18) columns."""
    roll = normalize_monetary(rolling_columns(raw, rounded=rounded), rounded=rounded)
    hist = history_columns(raw)
    mags = scenario_magnitudes("branch_type", parse_params("branch_params"),
                               hist["hist_avg_price_change"], hist["avg_restock"])

    def r4(c):
        return F.round(c, 4) if rounded else c

    delta = {k: r4(v) for k, v in mags.items()}
    delta["history_depth_days"] = hist["history_depth_days"]
    delta["n_past_price_changes"] = hist["n_past_price_changes"]
    delta["hist_avg_price_change"] = r4(hist["hist_avg_price_change"])
    return {**roll, **delta, "n_prior": hist["n_prior"]}


def training_rows(commits: DataFrame, branches: DataFrame, outcomes: DataFrame, *,
                  rounded: bool = True, min_prior: int = MIN_PRIOR_COMMITS,
                  keep_n_prior: bool = False) -> DataFrame:
    """T1 flagship. Columns in :data:`TRAINING_COLS` order.

    ``rounded=True`` rounds where the reference rounds; ``rounded=False``
    keeps full precision everywhere (used by the SQL cross-checks)."""
    sel = committed_with_outcome(branches, outcomes)
    # each scenario takes the rows of its branch_id along, so the wide sums need no join
    own = F.collect_list(F.struct(*sel.columns)).over(Window.partitionBy("branch_id"))
    asks = sel.select("branch_id", "business_id", "committed_at", own.alias("_own"))
    raw = lookback_raw(commits, asks, counted=branches, carry=["_own"])
    rows = raw.select(*[c for c in raw.columns if c not in ("branch_id", "_own")], F.inline("_own"))
    feats = scenario_feature_columns(rows, rounded)
    rows = rows.filter(feats["n_prior"] >= min_prior)
    season = season_core("committed_at", "category", rounded=rounded)
    cols = {**{c: F.col(c) for c in ID_COLS}, **feats, **season,
            **onehot_category("category"), **onehot_branch_type("branch_type"),
            **{c: F.col(c) for c in LABELS}}
    out = [cols[c].alias(c) for c in TRAINING_COLS]
    if keep_n_prior:
        out.append(cols["n_prior"].alias("n_prior"))
    return rows.select(*out)


def skip_report(commits: DataFrame, branches: DataFrame, outcomes: DataFrame,
                min_prior: int = MIN_PRIOR_COMMITS) -> DataFrame:
    """F4 / A21 side report: kept vs skipped scenarios (insufficient history)."""
    sel = committed_with_outcome(branches, outcomes)
    raw = lookback_raw(commits, sel.select("branch_id", "business_id", "committed_at"), counted=branches)
    return (raw.select(F.when(F.col("n_all@0") >= min_prior, "kept").otherwise("skipped").alias("status"))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


__all__ = ["training_rows", "committed_with_outcome", "dedup_outcomes", "TRAINING_COLS",
           "skip_report", "from_micros"]
