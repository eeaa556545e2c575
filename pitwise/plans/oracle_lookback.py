"""Oracle SQL for the scenario lookback family and T1.

Independent formulation: every window is a correlated range join of the
scenario with its business's commits (``ts < b AND ts >= b - w``), then
plain aggregates. No prefix sums, no probes.
"""

from __future__ import annotations

from pitwise.functions.encode import ALL_BRANCH_TYPES, CATEGORIES
from pitwise.functions.season import SEASONAL_PEAKS
from pitwise.plans.oracle_views import with_views

FD = "CAST(floor(({a} - {b}) / 86400000000.0) AS BIGINT)"


def _fd(a: str, b: str) -> str:
    return FD.format(a=f"epoch_us({a})", b=f"epoch_us({b})")


INV_PT = ("(c.event_type = 'LEDGER_ENTRY' OR (c.event_type = 'ORDER_FULFILLED' "
          "AND coalesce(c.f_inventory_after, -1) >= 0))")
INV_V = ("CASE WHEN c.event_type = 'LEDGER_ENTRY' THEN coalesce(c.f_inventory_units, 0) "
         "ELSE coalesce(c.f_inventory_after, -1) END")
LEDGER = "c.event_type = 'LEDGER_ENTRY'"
ORDER = "c.event_type = 'ORDER_RECEIVED'"


def lookback_ctes(scen: str) -> str:
    """CTEs ``win`` (per scenario x window aggregates), ``roll`` (A1-A12),
    ``base``/``rolln`` (A14) and ``hist`` (A15-A19) for scenario set ``scen``."""
    return f"""
W AS (SELECT * FROM (VALUES (7), (30), (90)) t(w)),
win AS (
  SELECT s.branch_id, W.w,
    count(c.seq) AS n_all,
    count(c.seq) FILTER (WHERE {ORDER}) AS n_order,
    CAST(coalesce(sum(CAST(coalesce(c.f_revenue, 0) AS DECIMAL(18,2))) FILTER (WHERE {ORDER}), 0) AS DOUBLE) AS rev,
    count(c.seq) FILTER (WHERE c.event_type = 'ORDER_CANCELLED') AS n_cancel,
    count(c.seq) FILTER (WHERE c.event_type = 'FULFILLMENT_BLOCKED') AS n_blocked,
    count(c.seq) FILTER (WHERE c.event_type IN ('INVENTORY_RESTOCK', 'SUPPLIER_PO_CREATED')) AS n_restock,
    count(c.seq) FILTER (WHERE c.event_type = 'PRICE_CHANGE') AS n_price,
    CAST(sum(CAST(coalesce(c.f_pct_change, 0) AS DECIMAL(24,8))) FILTER (WHERE c.event_type = 'PRICE_CHANGE') AS DOUBLE) AS price_sum,
    coalesce(sum(exp(-ln(2) * ((epoch_us(s.committed_at) - epoch_us(c.ts)) / 86400000000.0) / 30))
             FILTER (WHERE {ORDER}), 0) AS wsum,
    count(c.seq) FILTER (WHERE {LEDGER}) AS n_cash,
    arg_max(coalesce(c.f_cash_balance, 0), {{'t': c.ts, 's': c.seq}}) FILTER (WHERE {LEDGER}) AS last_cash,
    arg_min(coalesce(c.f_cash_balance, 0), {{'t': c.ts, 's': c.seq}}) FILTER (WHERE {LEDGER}) AS first_cash,
    max(c.ts) FILTER (WHERE {LEDGER}) AS last_cash_t,
    min(c.ts) FILTER (WHERE {LEDGER}) AS first_cash_t,
    count(c.seq) FILTER (WHERE {INV_PT}) AS n_inv,
    arg_max({INV_V}, {{'t': c.ts, 's': c.seq}}) FILTER (WHERE {INV_PT}) AS last_inv,
    arg_min({INV_V}, {{'t': c.ts, 's': c.seq}}) FILTER (WHERE {INV_PT}) AS first_inv,
    max(c.ts) FILTER (WHERE {INV_PT}) AS last_inv_t,
    min(c.ts) FILTER (WHERE {INV_PT}) AS first_inv_t
  FROM {scen} s CROSS JOIN W
  LEFT JOIN pc c ON c.business_id = s.business_id AND c.ts < s.committed_at
                AND c.ts >= s.committed_at - to_days(W.w)
  GROUP BY s.branch_id, W.w
),
roll AS (
  SELECT branch_id, w, n_all,
    n_order AS order_count,
    rev AS revenue_total,
    rev / w AS revenue_per_day,
    least(n_cancel / greatest(n_order, 1), 1.0) AS cancel_rate,
    n_blocked / greatest(n_order + n_blocked, 1) AS blocked_rate,
    n_restock AS restock_count,
    n_price AS price_change_count,
    CASE WHEN n_price > 0 THEN price_sum / n_price ELSE 0.0 END AS avg_price_change_pct,
    CASE WHEN n_cash >= 1 THEN last_cash ELSE 0.0 END AS latest_cash_balance,
    CASE WHEN n_cash >= 2 THEN (last_cash - first_cash) / greatest({_fd('last_cash_t', 'first_cash_t')}, 1)
         ELSE 0.0 END AS cash_trend,
    CASE WHEN n_inv >= 2 THEN (last_inv - first_inv) / greatest({_fd('last_inv_t', 'first_inv_t')}, 1)
         ELSE 0.0 END AS inventory_trend,
    wsum AS weighted_order_count
  FROM win
),
base AS (
  SELECT branch_id,
         CASE WHEN revenue_per_day = 0 THEN 1.0 ELSE revenue_per_day END AS rb,
         CASE WHEN latest_cash_balance = 0 THEN 1.0 ELSE latest_cash_balance END AS cb
  FROM roll WHERE w = 90
),
rolln AS (
  SELECT r.branch_id, r.w, r.order_count, r.cancel_rate, r.blocked_rate, r.restock_count,
         r.price_change_count, r.avg_price_change_pct, r.inventory_trend, r.weighted_order_count,
         CASE WHEN b.rb > 0 THEN r.revenue_total / (b.rb * r.w) ELSE r.revenue_total END AS revenue_total,
         CASE WHEN b.rb > 0 THEN r.revenue_per_day / b.rb ELSE r.revenue_per_day END AS revenue_per_day,
         CASE WHEN b.cb > 0 THEN r.latest_cash_balance / b.cb ELSE r.latest_cash_balance END AS latest_cash_balance,
         CASE WHEN b.cb > 0 THEN r.cash_trend / b.cb ELSE r.cash_trend END AS cash_trend
  FROM roll r JOIN base b ON r.branch_id = b.branch_id
),
hist AS (
  SELECT s.branch_id, count(c.seq) AS n_prior,
    count(c.seq) FILTER (WHERE c.event_type = 'PRICE_CHANGE' AND c.ok) AS n_pv,
    CAST(sum(CAST(coalesce(c.f_pct_change, 0) AS DECIMAL(24,8)))
         FILTER (WHERE c.event_type = 'PRICE_CHANGE' AND c.ok) AS DOUBLE) AS pv_sum,
    count(c.seq) FILTER (WHERE c.event_type = 'INVENTORY_RESTOCK' AND c.ok) AS n_rsv,
    CAST(sum(CAST(coalesce(c.f_quantity_added, 0) AS DECIMAL(24,8)))
         FILTER (WHERE c.event_type = 'INVENTORY_RESTOCK' AND c.ok) AS DOUBLE) AS rs_sum,
    min(c.ts) AS first_ts
  FROM {scen} s LEFT JOIN pc c ON c.business_id = s.business_id AND c.ts < s.committed_at
  GROUP BY s.branch_id
),
histc AS (
  SELECT h.branch_id, h.n_prior,
    CASE WHEN n_pv > 0 THEN pv_sum / n_pv ELSE 0.0 END AS hist_avg_price_change,
    n_pv AS n_past_price_changes,
    CASE WHEN n_rsv > 0 THEN rs_sum / n_rsv END AS avg_restock,
    CASE WHEN n_prior > 0 THEN {_fd('s.committed_at', 'h.first_ts')} ELSE 0 END AS history_depth_days
  FROM hist h JOIN {scen} s ON s.branch_id = h.branch_id
)
"""


ROLL = ["order_count", "revenue_total", "revenue_per_day", "cancel_rate", "blocked_rate",
        "restock_count", "price_change_count", "avg_price_change_pct", "latest_cash_balance",
        "cash_trend", "inventory_trend", "weighted_order_count"]


def _param(name: str) -> str:
    return (f"coalesce(CASE WHEN json_valid(s.branch_params) THEN "
            f"TRY_CAST(json_extract_string(s.branch_params, '$.{name}') AS DOUBLE) END, 0.0)")


def scenario_sql() -> dict[str, str]:
    """X11-X18 column expressions over ``s`` (scenario) and ``h`` (histc)."""
    bt = "s.branch_type"
    terms = ("CASE coalesce(CASE WHEN json_valid(s.branch_params) THEN "
             "json_extract_string(s.branch_params, '$.new_terms') END, 'NET30') "
             "WHEN 'NET15' THEN -15.0 WHEN 'NET30' THEN 0.0 WHEN 'NET45' THEN 15.0 "
             "WHEN 'NET60' THEN 30.0 ELSE 0.0 END")
    pct, qty, cpu = _param("pct_change"), _param("quantity"), _param("cost_per_unit")
    disc, mdown, cv = _param("discount_pct"), _param("markdown_pct"), _param("contract_value")
    skus, cc = _param("new_skus"), _param("cost_change_pct")
    avg_rs = f"coalesce(h.avg_restock, {qty})"
    return {
        "mag_price_change_pct": f"CASE WHEN {bt} IN ('price_increase', 'price_decrease') THEN abs({pct}) ELSE 0.0 END",
        "mag_restock_qty_norm": f"CASE WHEN {bt} = 'bulk_restock' THEN {qty} / 500.0 ELSE 0.0 END",
        "mag_restock_cost_norm": f"CASE WHEN {bt} = 'bulk_restock' THEN ({qty} * {cpu}) / 40000.0 ELSE 0.0 END",
        "mag_discount_pct": (f"CASE WHEN {bt} IN ('promo_event', 'volume_discount') THEN {disc} "
                             f"WHEN {bt} = 'markdown' THEN {mdown} ELSE 0.0 END"),
        "mag_contract_norm": f"CASE WHEN {bt} = 'contract_change' THEN {cv} / 100000.0 ELSE 0.0 END",
        "mag_new_skus": f"CASE WHEN {bt} = 'new_collection' THEN {skus} ELSE 0.0 END",
        "mag_terms_delta_days": f"CASE WHEN {bt} = 'net_terms_change' THEN abs({terms}) ELSE 0.0 END",
        "mag_supplier_cost_pct": f"CASE WHEN {bt} = 'supplier_change' THEN abs({cc}) ELSE 0.0 END",
        "deviation_from_norm": (
            f"CASE WHEN {bt} IN ('price_increase', 'price_decrease') THEN {pct} - h.hist_avg_price_change "
            f"WHEN {bt} = 'bulk_restock' THEN ({qty} - {avg_rs}) / greatest({avg_rs}, 1.0) "
            f"WHEN {bt} IN ('promo_event', 'volume_discount') THEN {disc} "
            f"WHEN {bt} = 'markdown' THEN {mdown} "
            f"WHEN {bt} = 'contract_change' THEN {cv} / 100000.0 "
            f"WHEN {bt} = 'new_collection' THEN {skus} "
            f"WHEN {bt} = 'supplier_change' THEN {cc} "
            f"WHEN {bt} = 'net_terms_change' THEN {terms} ELSE 0.0 END"),
    }


def season_sql(ts: str, cat: str) -> dict[str, str]:
    m = f"month({ts})"
    dow = f"(isodow({ts}) - 1)"
    wom = f"least((day({ts}) - 1) // 7, 3)"
    dist = []
    peak_case = "CASE " + " ".join(
        f"WHEN {cat} = '{c}' THEN least(365, " + ", ".join(
            f"least(abs({m} - {p}), 12 - abs({m} - {p})) * 30" for p in ps) + ")"
        for c, ps in SEASONAL_PEAKS.items()) + " ELSE 180 END"
    is_peak = "CASE " + " ".join(
        f"WHEN {cat} = '{c}' THEN CAST({m} IN ({', '.join(map(str, ps))}) AS INTEGER)"
        for c, ps in SEASONAL_PEAKS.items()) + " ELSE 0 END"
    del dist

    def sc(v, p):
        return (f"sin(2 * pi() * {v} / {p})", f"cos(2 * pi() * {v} / {p})")

    ms, mc = sc(m, 12.0)
    ds, dc = sc(dow, 7.0)
    ws, wc = sc(wom, 4.0)
    ps, pc = sc(f"({peak_case})", 182.0)
    return {
        "month_sin": ms, "month_cos": mc, "day_of_week_sin": ds, "day_of_week_cos": dc,
        "week_of_month_sin": ws, "week_of_month_cos": wc,
        "days_to_peak": f"CAST({peak_case} AS INTEGER)",
        "days_to_peak_sin": ps, "days_to_peak_cos": pc,
        "is_peak_month": is_peak,
        "is_weekend": f"CAST({dow} >= 5 AS INTEGER)",
        "quarter": f"CAST(quarter({ts}) AS INTEGER)",
    }


def training_rows_sql(min_prior: int = 10) -> str:
    cols = ["s.branch_id", "s.business_id", "s.category", "s.branch_type", "s.committed_at"]
    joins = []
    for w in (7, 30, 90):
        joins.append(f"JOIN rolln r{w} ON r{w}.branch_id = s.branch_id AND r{w}.w = {w}")
        cols += [f"r{w}.{c} AS w{w}_{c}" for c in ROLL]
    cols += [f"{v} AS {k}" for k, v in season_sql("s.committed_at", "s.category").items()]
    cols += [f"{v} AS {k}" for k, v in scenario_sql().items()]
    cols += ["h.history_depth_days", "h.n_past_price_changes", "h.hist_avg_price_change"]
    cols += [f"CAST(s.category = '{c}' AS INTEGER) AS cat_{c}" for c in CATEGORIES]
    cols += [f"CAST(s.branch_type = '{b}' AS INTEGER) AS bt_{b}" for b in ALL_BRANCH_TYPES]
    cols += ["s.label_inventory_delta", "s.label_cashflow_delta", "s.label_order_velocity_delta"]
    body = (f"SELECT {', '.join(cols)}\nFROM sel s\nJOIN histc h ON h.branch_id = s.branch_id\n"
            + "\n".join(joins) + f"\nWHERE h.n_prior >= {min_prior}")
    return with_views(["pc", "sel"], body, lookback_ctes("sel"))
