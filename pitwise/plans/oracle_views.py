"""The FIXTURES views as DuckDB SQL (for the oracle cross-checks).

Only the driver's base tables exist in the oracle; every oracle query is
``WITH <views needed>, <its own CTEs> SELECT ...``.
"""

from __future__ import annotations

_CAT = "CASE {u} % 3 WHEN 0 THEN 'retail' WHEN 1 THEN 'apparel' ELSE 'b2b' END"

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}

VIEWS["ev"] = "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
DEPS["ev"] = []

VIEWS["commits"] = f"""
SELECT CAST(event_id AS VARCHAR) AS commit_id, event_id AS seq, ts AS "timestamp",
       CAST(user_id AS VARCHAR) AS business_id, {_CAT.format(u='user_id')} AS business_category,
       et AS event_type, CAST(NULL AS VARCHAR) AS branch_id,
       CASE WHEN event_id % 97 = 0 THEN ''
            WHEN event_id % 101 = 0 THEN '{{bad'
            ELSE CASE et
              WHEN 'ORDER_RECEIVED' THEN '{{"quantity": ' || CAST(1 + k % 10 AS VARCHAR) || ', "revenue": ' || CAST(value AS VARCHAR) || '}}'
              WHEN 'ORDER_FULFILLED' THEN '{{"inventory_after": ' || CAST(k - 5 AS VARCHAR) || '}}'
              WHEN 'ORDER_CANCELLED' THEN '{{"quantity": ' || CAST(1 + k % 10 AS VARCHAR) || ', "revenue_reversed": ' || CAST(value AS VARCHAR) || '}}'
              WHEN 'FULFILLMENT_BLOCKED' THEN '{{}}'
              WHEN 'INVENTORY_RESTOCK' THEN '{{"quantity_added": ' || CAST(k AS VARCHAR) || ', "cost": ' || CAST(value AS VARCHAR) || '}}'
              WHEN 'SUPPLIER_PO_CREATED' THEN '{{"quantity": ' || CAST(k AS VARCHAR) || ', "cost": ' || CAST(value AS VARCHAR) || '}}'
              WHEN 'PRICE_CHANGE' THEN '{{"pct_change": ' || CAST(k / 4 - 12 AS VARCHAR) || '}}'
              ELSE '{{"cash_balance": ' || CAST(value * 100 AS VARCHAR) || ', "inventory_units": ' || CAST(k AS VARCHAR) || '}}'
            END END AS payload
FROM (SELECT *, CASE event_type
                  WHEN 'purchase' THEN 'ORDER_RECEIVED'
                  WHEN 'view' THEN 'ORDER_FULFILLED'
                  WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'ORDER_CANCELLED' ELSE 'FULFILLMENT_BLOCKED' END
                  WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'INVENTORY_RESTOCK' WHEN 1 THEN 'SUPPLIER_PO_CREATED'
                                              WHEN 2 THEN 'PRICE_CHANGE' ELSE 'LEDGER_ENTRY' END
                END AS et
      FROM ev WHERE event_type <> 'signup') x
"""
DEPS["commits"] = ["ev"]

VIEWS["branches"] = f"""
SELECT CAST(event_id AS VARCHAR) AS branch_id, event_id AS seq,
       CAST(user_id AS VARCHAR) AS business_id, {_CAT.format(u='user_id')} AS category,
       CASE k % 10 WHEN 0 THEN 'price_increase' WHEN 1 THEN 'price_decrease' WHEN 2 THEN 'bulk_restock'
                   WHEN 3 THEN 'promo_event' WHEN 4 THEN 'new_collection' WHEN 5 THEN 'markdown'
                   WHEN 6 THEN 'contract_change' WHEN 7 THEN 'net_terms_change'
                   WHEN 8 THEN 'volume_discount' ELSE 'supplier_change' END AS branch_type,
       CASE k % 10
         WHEN 0 THEN '{{"pct_change": ' || CAST(5 + k % 20 AS VARCHAR) || '}}'
         WHEN 1 THEN '{{"pct_change": ' || CAST(-5 - k % 15 AS VARCHAR) || '}}'
         WHEN 2 THEN '{{"quantity": ' || CAST(100 + k * 4 AS VARCHAR) || ', "cost_per_unit": ' || CAST(10 + k % 70 AS VARCHAR) || '}}'
         WHEN 3 THEN '{{"discount_pct": ' || CAST(10 + k % 20 AS VARCHAR) || '}}'
         WHEN 4 THEN '{{"new_skus": ' || CAST(5 + k % 25 AS VARCHAR) || '}}'
         WHEN 5 THEN '{{"markdown_pct": ' || CAST(20 + k % 30 AS VARCHAR) || '}}'
         WHEN 6 THEN '{{"contract_value": ' || CAST(5000 + k * 950 AS VARCHAR) || '}}'
         WHEN 7 THEN '{{"new_terms": "' || CASE (k // 10) % 4 WHEN 0 THEN 'NET15' WHEN 1 THEN 'NET45'
                                                         WHEN 2 THEN 'NET60' ELSE 'NET99' END || '"}}'
         WHEN 8 THEN '{{"discount_pct": ' || CAST(5 + k % 10 AS VARCHAR) || '}}'
         ELSE '{{"cost_change_pct": ' || CAST(k % 25 - 15 AS VARCHAR) || '}}'
       END AS branch_params,
       ts AS committed_at,
       CASE WHEN event_id % 10 < 7 THEN 'committed' ELSE 'discarded' END AS status,
       k, value
FROM ev WHERE event_type = 'signup'
"""
DEPS["branches"] = ["ev"]

VIEWS["outcomes"] = f"""
SELECT CAST(event_id AS VARCHAR) AS outcome_id, event_id AS seq, CAST(event_id AS VARCHAR) AS branch_id,
       CAST(user_id AS VARCHAR) AS business_id, {_CAT.format(u='user_id')} AS category,
       ts + INTERVAL 14 DAY AS recorded_at, 14 AS horizon_days,
       CAST(k - 50 AS DOUBLE) AS inventory_delta, value * 10 - 500 AS cashflow_delta,
       CASE WHEN k % 9 = 0 THEN 0.0 ELSE k / 4 - 10 END AS order_velocity_delta
FROM ev WHERE event_type = 'signup' AND event_id % 13 <> 0
"""
DEPS["outcomes"] = ["ev"]

_PTYPE = """CASE p.p_type WHEN 'ECONOMY' THEN 'Home Services' WHEN 'PROMO' THEN 'Fashion Wear'
             WHEN 'SMALL' THEN ' Wholesale ' WHEN 'LARGE' THEN 'Software Consulting'
             WHEN 'MEDIUM' THEN 'Electronics' ELSE 'Misc' END"""

VIEWS["li_typed"] = f"""
SELECT l.*, {_PTYPE} AS product_type FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
"""
DEPS["li_typed"] = []

VIEWS["shop_orders"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS shop_id, l_shipdate AS created_at, l_extendedprice AS total_price,
       CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS cancelled_at, product_type,
       CAST(l_quantity AS INTEGER) AS inventory_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (
            PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cash_balance,
       l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
FROM li_typed
"""
DEPS["shop_orders"] = ["li_typed"]

VIEWS["retail_txn"] = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
       CAST(l_partkey AS VARCHAR) AS customer_id, CAST(l_suppkey AS VARCHAR) AS store_id,
       l_shipdate AS "date", l_quantity AS quantity, l_extendedprice / NULLIF(l_quantity, 0) AS unit_price,
       product_type AS product_category, l_extendedprice AS total_amount, l_linestatus AS payment_method,
       l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate
FROM li_typed
"""
DEPS["retail_txn"] = ["li_typed"]

VIEWS["fashion_sales"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS "Order_ID", CAST(l_suppkey AS VARCHAR) AS "Customer_ID",
       l_shipdate AS "Date", product_type AS "Product_Type", l_quantity AS "Quantity",
       l_extendedprice / NULLIF(l_quantity, 0) AS "Price", l_extendedprice AS "Total_Sales",
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "Returns",
       l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate
FROM li_typed
"""
DEPS["fashion_sales"] = ["li_typed"]

VIEWS["unit_prices"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS shop_id, l_shipdate AS created_at,
       l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
       l_extendedprice / NULLIF(l_quantity, 0) AS price
FROM lineitem
"""
DEPS["unit_prices"] = []

# Commits with their payload fields parsed (invalid JSON -> all NULL).
VIEWS["pc"] = """
SELECT business_id, "timestamp" AS ts, seq, event_type, payload,
       coalesce(json_valid(payload), false) AS ok,
       CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.revenue') AS DOUBLE) END AS f_revenue,
       CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.revenue_reversed') AS DOUBLE) END AS f_revenue_reversed,
       CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.quantity') AS DOUBLE) END AS f_quantity,
       CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.inventory_after') AS DOUBLE) END AS f_inventory_after,
       CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.quantity_added') AS DOUBLE) END AS f_quantity_added,
       CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.cost') AS DOUBLE) END AS f_cost,
       CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.pct_change') AS DOUBLE) END AS f_pct_change,
       CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.cash_balance') AS DOUBLE) END AS f_cash_balance,
       CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract_string(payload, '$.inventory_units') AS DOUBLE) END AS f_inventory_units
FROM commits
"""
DEPS["pc"] = ["commits"]

# Committed scenarios with an outcome (last outcome per branch wins).
VIEWS["sel"] = """
SELECT b.branch_id, b.business_id, b.category, b.branch_type, b.branch_params, b.committed_at,
       o.inventory_delta AS label_inventory_delta, o.cashflow_delta AS label_cashflow_delta,
       o.order_velocity_delta AS label_order_velocity_delta
FROM branches b
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY seq DESC) AS rn
                     FROM outcomes) WHERE rn = 1) o ON o.branch_id = b.branch_id
WHERE b.status = 'committed'
"""
DEPS["sel"] = ["branches", "outcomes"]


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(n):
        if n not in VIEWS:      # a base table of the driver
            return
        for d in DEPS[n]:
            add(d)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def with_views(names: list[str], body: str, extra_ctes: str = "") -> str:
    """``WITH`` the given views (and their dependencies), optional extra CTEs,
    then ``body``."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _closure(names)]
    if extra_ctes.strip():
        ctes.append(extra_ctes.strip().rstrip(","))
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
