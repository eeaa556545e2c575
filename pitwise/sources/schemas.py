"""Fixed input schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S, TS, D, I, L = T.StringType(), T.TimestampNTZType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


COMMITS = _schema(("commit_id", S), ("timestamp", TS), ("business_id", S),
                  ("business_category", S), ("event_type", S), ("branch_id", S),
                  ("payload", S))

BRANCHES = _schema(("branch_id", S), ("business_id", S), ("category", S),
                   ("branch_type", S), ("branch_params", S), ("committed_at", TS),
                   ("status", S))

OUTCOMES = _schema(("outcome_id", S), ("branch_id", S), ("business_id", S),
                   ("category", S), ("recorded_at", TS), ("horizon_days", I),
                   ("inventory_delta", D), ("cashflow_delta", D),
                   ("order_velocity_delta", D))

# Order exports: created_at / cancelled_at stay text so the adapter can apply
# the UTC normalisation (P2) and the lenient parse (P3) itself.
SHOP_ORDERS_RAW = _schema(("shop_id", S), ("created_at", S), ("total_price", D),
                          ("cancelled_at", S), ("product_type", S),
                          ("inventory_qty", I), ("cash_balance", D))

RETAIL_TXN_RAW = _schema(("transaction_id", S), ("customer_id", S), ("store_id", S),
                         ("date", S), ("quantity", S), ("unit_price", S),
                         ("product_category", S), ("total_amount", S),
                         ("payment_method", S))

FASHION_SALES_RAW = _schema(("Order_ID", S), ("Customer_ID", S), ("Date", S),
                            ("Product_Type", S), ("Quantity", S), ("Price", S),
                            ("Total_Sales", S), ("Returns", S))

#: Column in which the readers of exports keep a row's place in its file.
FILE_ORDER = "file_order"

LABELS = ["label_inventory_delta", "label_cashflow_delta", "label_order_velocity_delta"]
ID_COLS = ["branch_id", "business_id", "category", "branch_type", "committed_at"]
