"""Oracle SQL for the order-export adapters (P7-P10, F5-F9, W1-W4, B*, T2, T3)."""

from __future__ import annotations

from pitwise.functions.encode import (ALL_BRANCH_TYPES, CATEGORIES, SHOP_CATEGORY_PATTERNS, TXN_APPAREL_KEYWORDS,
                                      TXN_B2B_KEYWORDS)
from pitwise.plans.oracle_views import with_views

TIE = "o1, o2, o3, o4, o5, o6"
KEY = "{'t': r.created_at, 'a': r.o1, 'b': r.o2, 'c': r.o3, 'd': r.o4, 'e': r.o5, 'f': r.o6}"


def fd(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0) AS BIGINT)"


# Normalised shop frames ("so") per source, with six tie columns o1..o6.
SO = {
    "shop": ("shop_orders", """
so AS (SELECT shop_id, created_at, total_price, cancelled_at, product_type,
              CAST(inventory_qty AS DOUBLE) AS inventory_qty, cash_balance,
              l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_quantity AS o4,
              l_extendedprice AS o5, CAST(NULL AS TIMESTAMP) AS o6
       FROM shop_orders WHERE shop_id IS NOT NULL AND created_at IS NOT NULL)"""),
    "retail": ("retail_txn", """
so AS (SELECT store_id AS shop_id, "date" AS created_at,
              coalesce(TRY_CAST(total_amount AS DOUBLE), 0.0) AS total_price,
              CAST(NULL AS TIMESTAMP) AS cancelled_at,
              coalesce(product_category, 'retail') AS product_type,
              coalesce(TRY_CAST(quantity AS DOUBLE), 0.0) AS inventory_qty,
              CAST(SUM(CAST(coalesce(TRY_CAST(total_amount AS DOUBLE), 0.0) AS DECIMAL(18,2))) OVER (
                   PARTITION BY store_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
                   l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                AS cash_balance,
              l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_quantity AS o4,
              l_extendedprice AS o5, l_shipdate AS o6
       FROM retail_txn WHERE store_id IS NOT NULL AND "date" IS NOT NULL)"""),
    "fashion": ("fashion_sales", """
so AS (SELECT "Customer_ID" AS shop_id, "Date" AS created_at,
              coalesce(TRY_CAST("Total_Sales" AS DOUBLE), 0.0) AS total_price,
              CASE WHEN coalesce(TRY_CAST("Returns" AS DOUBLE), 0.0) > 0 THEN "Date" END AS cancelled_at,
              coalesce("Product_Type", 'apparel') AS product_type,
              coalesce(TRY_CAST("Quantity" AS DOUBLE), 0.0) AS inventory_qty,
              CAST(SUM(CAST(coalesce(TRY_CAST("Total_Sales" AS DOUBLE), 0.0) AS DECIMAL(18,2))) OVER (
                   PARTITION BY "Customer_ID" ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
                   l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                AS cash_balance,
              l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_quantity AS o4,
              l_extendedprice AS o5, l_shipdate AS o6
       FROM fashion_sales WHERE "Customer_ID" IS NOT NULL AND "Date" IS NOT NULL)"""),
}


def map_category_sql(x: str) -> str:
    k = f"lower(trim({x}))"
    return "CASE " + " ".join(f"WHEN contains({k}, '{p}') THEN '{c}'" for p, c in SHOP_CATEGORY_PATTERNS) \
        + " ELSE 'retail' END"


def infer_category_sql(x: str) -> str:
    k = f"lower({x})"
    a = " OR ".join(f"contains({k}, '{w}')" for w in TXN_APPAREL_KEYWORDS)
    b = " OR ".join(f"contains({k}, '{w}')" for w in TXN_B2B_KEYWORDS)
    return f"CASE WHEN coalesce({a}, false) THEN 'apparel' WHEN coalesce({b}, false) THEN 'b2b' ELSE 'retail' END"


def season_shop_sql(ts: str) -> dict[str, str]:
    m, dow = f"month({ts})", f"(isodow({ts}) - 1)"
    wom = f"((day({ts}) - 1) // 7 + 1)"
    peak = f"abs({fd(ts, f'make_timestamp(year({ts}), 12, 15, 0, 0, 0)')})"

    def sc(v, p):
        return f"sin(2 * pi() * {v} / {p})", f"cos(2 * pi() * {v} / {p})"

    ms, mc = sc(m, 12.0)
    ds, dc = sc(dow, 7.0)
    ws, wc = sc(wom, 5.0)
    ps, pc = sc(peak, 365.0)
    return {"month_sin": ms, "month_cos": mc, "day_of_week_sin": ds, "day_of_week_cos": dc,
            "week_of_month_sin": ws, "week_of_month_cos": wc, "days_to_peak": peak,
            "days_to_peak_sin": ps, "days_to_peak_cos": pc,
            "is_peak_month": f"CAST({m} = 12 AS INTEGER)",
            "is_weekend": f"CAST({dow} >= 5 AS INTEGER)",
            "quarter": f"CAST(quarter({ts}) AS INTEGER)"}


def shop_ctes(source: str, txn: bool) -> tuple[str, list[str]]:
    """CTEs so, ix, st, md, sp, W, pw, q, agg, lab for one source."""
    view, so = SO[source]
    filt = "AND st.n_rows >= 45 AND ix.created_at + to_days(14) <= st.last_t" if txn else ""
    ctes = so + f""",
ix AS (SELECT so.*, row_number() OVER w - 1 AS idx, lag(cash_balance) OVER w AS prev_cash,
              lag(inventory_qty) OVER w AS prev_inv, lag(created_at) OVER w AS prev_t
       FROM so WINDOW w AS (PARTITION BY shop_id ORDER BY created_at, {TIE})),
st AS (SELECT shop_id, count(*) AS n_rows, min(created_at) AS first_t, max(created_at) AS last_t
       FROM so GROUP BY shop_id),
md AS (SELECT shop_id, product_type AS mode_type FROM (
         SELECT shop_id, product_type,
                row_number() OVER (PARTITION BY shop_id ORDER BY count(*) DESC, product_type) AS rn
         FROM so WHERE product_type IS NOT NULL GROUP BY shop_id, product_type) WHERE rn = 1),
sp AS (SELECT ix.shop_id, ix.idx, ix.created_at AS as_of FROM ix JOIN st ON st.shop_id = ix.shop_id
       WHERE ix.idx >= 30 AND (ix.idx - 30) % 7 = 0 {filt}),
W AS (SELECT * FROM (VALUES (7), (30), (90)) t(w)),
pw AS (SELECT sp.shop_id, sp.idx, sp.as_of, W.w, r.created_at, r.total_price, r.cancelled_at,
              r.cash_balance, r.inventory_qty, r.prev_cash, r.prev_inv, r.prev_t,
              r.o1, r.o2, r.o3, r.o4, r.o5, r.o6
       FROM sp CROSS JOIN W LEFT JOIN ix r ON r.shop_id = sp.shop_id AND r.created_at < sp.as_of
                                       AND r.created_at >= sp.as_of - to_days(W.w)),
q AS (SELECT shop_id, idx, w, quantile_cont(total_price, 0.75) AS q75 FROM pw GROUP BY shop_id, idx, w),
agg AS (
  SELECT r.shop_id, r.idx, r.w, count(r.created_at) AS order_count,
    count(r.created_at) / CAST(r.w AS DOUBLE) AS order_velocity,
    CAST(coalesce(sum(CAST(r.total_price AS DECIMAL(18,2))), 0) AS DOUBLE) AS revenue_total,
    coalesce(avg(CASE WHEN r.created_at IS NULL THEN NULL WHEN r.cancelled_at IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0) AS cancel_rate,
    coalesce(avg(CASE WHEN r.created_at IS NULL THEN NULL
                      WHEN r.cancelled_at IS NOT NULL AND r.total_price > q.q75 THEN 1.0 ELSE 0.0 END), 0.0) AS blocked_rate,
    CASE WHEN count(r.created_at) > 0 THEN arg_max(r.cash_balance, {KEY}) ELSE 0.0 END AS latest_cash_balance,
    coalesce(avg(CASE WHEN r.prev_t >= r.as_of - to_days(r.w)
                      THEN CAST(round(r.cash_balance * 1000000) AS BIGINT) - CAST(round(r.prev_cash * 1000000) AS BIGINT) END)
             / 1000000.0, 0.0) AS cash_trend,
    coalesce(avg(CASE WHEN r.prev_t >= r.as_of - to_days(r.w) THEN r.inventory_qty - r.prev_inv END), 0.0) AS inventory_trend,
    coalesce(sum(CASE WHEN r.created_at IS NOT NULL THEN 1.0 / greatest({fd('r.as_of', 'r.created_at')}, 1) END), 0.0) AS weighted_order_count
  FROM pw r JOIN q ON q.shop_id = r.shop_id AND q.idx = r.idx AND q.w = r.w
  GROUP BY r.shop_id, r.idx, r.w),
lab AS (
  SELECT sp.shop_id, sp.idx,
    count(*) FILTER (WHERE r.created_at < sp.as_of) AS n_pre,
    count(*) FILTER (WHERE r.created_at >= sp.as_of AND r.created_at < sp.as_of + to_days(14)) AS n_post,
    arg_max(r.cash_balance, {KEY}) FILTER (WHERE r.created_at < sp.as_of) AS pre_cash,
    arg_max(r.inventory_qty, {KEY}) FILTER (WHERE r.created_at < sp.as_of) AS pre_inv,
    arg_max(r.cash_balance, {KEY}) FILTER (WHERE r.created_at >= sp.as_of AND r.created_at < sp.as_of + to_days(14)) AS post_cash,
    arg_max(r.inventory_qty, {KEY}) FILTER (WHERE r.created_at >= sp.as_of AND r.created_at < sp.as_of + to_days(14)) AS post_inv,
    min(r.created_at) AS first_t, any_value(sp.as_of) AS as_of
  FROM sp JOIN so r ON r.shop_id = sp.shop_id GROUP BY sp.shop_id, sp.idx),
labc AS (
  SELECT shop_id, idx,
    CASE WHEN n_pre > 0 AND n_post > 0 THEN post_inv - pre_inv END AS label_inventory_delta,
    CASE WHEN n_pre > 0 AND n_post > 0 THEN post_cash - pre_cash END AS label_cashflow_delta,
    CASE WHEN n_pre > 0 AND n_post > 0 THEN n_post / 14.0 - n_pre / greatest({fd('as_of', 'first_t')}, 1) END
      AS label_order_velocity_delta
  FROM lab)"""
    return ctes, [view]


ROLL13 = ["order_count", "order_velocity", "revenue_total", "revenue_per_day", "cancel_rate",
          "blocked_rate", "restock_count", "price_change_count", "avg_price_change_pct",
          "latest_cash_balance", "cash_trend", "inventory_trend", "weighted_order_count"]


def _roll_expr(w: int, c: str) -> str:
    a = f"a{w}"
    if c == "revenue_per_day":
        return f"{a}.revenue_total / {float(w)}"
    if c in ("restock_count", "price_change_count"):
        return "CAST(0 AS BIGINT)"
    if c == "avg_price_change_pct":
        return "0.0"
    return f"{a}.{c}"


def adapter_sql(source: str) -> str:
    txn = source != "shop"
    ctes, views = shop_ctes(source, txn)
    prefix, bt = ("kaggle", "kaggle_transaction") if txn else ("shopify", "shopify_order")
    cat = infer_category_sql("md.mode_type") if txn else map_category_sql("md.mode_type")
    cols = [f"'{prefix}_' || sp.shop_id || '_' || CAST(sp.idx AS VARCHAR) AS branch_id",
            f"'{prefix}_' || sp.shop_id AS business_id", f"{cat} AS category",
            f"'{bt}' AS branch_type", "sp.as_of AS committed_at"]
    for w in (7, 30, 90):
        cols += [f"{_roll_expr(w, c)} AS w{w}_{c}" for c in ROLL13]
    cols += [f"{v} AS {k}" for k, v in season_shop_sql("sp.as_of").items()]
    cols += ["0.0 AS scenario_magnitude", "0.0 AS deviation_from_norm",
             f"{fd('sp.as_of', 'st.first_t')} AS history_depth_days",
             "CAST(0 AS BIGINT) AS n_past_price_changes", "0.0 AS hist_avg_price_change"]
    cols += [f"CAST(({cat}) = '{c}' AS INTEGER) AS cat_{c}" for c in CATEGORIES]
    cols += [f"0 AS bt_{b}" for b in ALL_BRANCH_TYPES]
    cols += ["l.label_inventory_delta", "l.label_cashflow_delta", "l.label_order_velocity_delta"]
    joins = " ".join(f"JOIN agg a{w} ON a{w}.shop_id = sp.shop_id AND a{w}.idx = sp.idx AND a{w}.w = {w}"
                     for w in (7, 30, 90))
    body = (f"SELECT {', '.join(cols)} FROM sp JOIN st ON st.shop_id = sp.shop_id "
            f"LEFT JOIN md ON md.shop_id = sp.shop_id {joins} "
            f"JOIN labc l ON l.shop_id = sp.shop_id AND l.idx = sp.idx "
            f"WHERE l.label_inventory_delta IS NOT NULL AND l.label_cashflow_delta IS NOT NULL "
            f"AND l.label_order_velocity_delta IS NOT NULL")
    return with_views(views, body, ctes)


def shop_sql(body: str, source: str = "shop", txn: bool | None = None) -> str:
    """Any body over the shop CTEs (so, ix, st, md, sp, pw, q, agg, lab, labc)."""
    ctes, views = shop_ctes(source, source != "shop" if txn is None else txn)
    return with_views(views, body, ctes)


def so_sql(body: str, source: str) -> str:
    view, so = SO[source]
    return with_views([view], body, so)
