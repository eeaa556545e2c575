"""Queries for the order-export adapters (P7-P10, F5-F9, W1-W4, O1-O2, B*, T2, T3, U1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitwise.functions.encode import map_category
from pitwise.functions.timecols import iso_text
from pitwise.operators import shops as S
from pitwise.operators.scan import segmented_scan
from pitwise.plans.oracle_shops import adapter_sql, fd, map_category_sql, shop_sql, so_sql
from pitwise.plans.oracle_views import with_views
from pitwise.plans.registry import query
from pitwise.sources import views as V

W3 = (7, 30, 90)


def shops(spark, d, sizes=None) -> DataFrame:
    return S.prepare_shop_orders(V.shop_orders(spark, d, sizes))


def _with_pos(df: DataFrame) -> DataFrame:
    # File order of the exports = lineitem order; its numeric prefix
    # (l_orderkey) is the position used to split the running sum.
    return df.withColumn("pos", F.col("row_seq.l_orderkey"))


def retail(spark, d, sizes=None) -> DataFrame:
    return S.normalize_retail(_with_pos(V.retail_txn(spark, d)), pos="pos", order=["row_seq"], sizes=sizes)


def fashion(spark, d, drop: tuple[str, ...] = (), sizes=None) -> DataFrame:
    df = _with_pos(V.fashion_sales(spark, d))
    if drop:
        df = df.drop(*drop)
    return S.normalize_fashion(df, pos="pos", order=["row_seq"], sizes=sizes)


_NORM_COLS = ["shop_id", "created_at", "total_price", "cancelled_at", "product_type",
              "inventory_qty", "cash_balance"]


@query("shop_training_rows", adapter_sql("shop"))
def shop_training_rows(spark, d):
    """Order export -> 77-column training rows."""
    sizes = V.shop_sizes(spark, d)
    return S.shop_training_rows(shops(spark, d, sizes=sizes), sizes=sizes)


@query("txn_training_rows", adapter_sql("retail"))
def txn_training_rows(spark, d):
    """T3 (retail transactions): normalise, >= 45 rows, horizon check, features."""
    sizes = V.shop_sizes(spark, d)
    return S.txn_training_rows(retail(spark, d, sizes=sizes), sizes=sizes)


@query("txn_training_rows_fashion", adapter_sql("fashion"))
def txn_training_rows_fashion(spark, d):
    """T3 (fashion sales): same transform on the fashion normaliser."""
    sizes = V.shop_sizes(spark, d)
    return S.txn_training_rows(fashion(spark, d, sizes=sizes), sizes=sizes)


@query("norm_retail", so_sql(f"SELECT {', '.join(_NORM_COLS)} FROM so", "retail"))
def norm_retail(spark, d):
    """Retail transactions -> shop frame (running revenue as cash proxy)."""
    return retail(spark, d).select(*_NORM_COLS)


@query("norm_fashion", so_sql(f"SELECT {', '.join(_NORM_COLS)} FROM so", "fashion"))
def norm_fashion(spark, d):
    """Fashion sales -> shop frame; returns mark cancellations."""
    return fashion(spark, d).select(*_NORM_COLS)


@query("optional_cols", with_views(["fashion_sales"], """
SELECT "Customer_ID" AS shop_id, "Date" AS created_at,
       coalesce(TRY_CAST("Total_Sales" AS DOUBLE), 0.0) AS total_price,
       CAST(NULL AS TIMESTAMP) AS cancelled_at, 'apparel' AS product_type, 0.0 AS inventory_qty,
       CAST(SUM(CAST(coalesce(TRY_CAST("Total_Sales" AS DOUBLE), 0.0) AS DECIMAL(18,2))) OVER (
            PARTITION BY "Customer_ID" ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
            l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cash_balance
FROM fashion_sales"""))
def optional_cols(spark, d):
    """Returns, Quantity and Product_Type absent -> plan-time defaults."""
    return fashion(spark, d, drop=("Returns", "Quantity", "Product_Type")).select(*_NORM_COLS)


@query("row_ids", shop_sql("""
SELECT 'shopify_' || shop_id || '_' || CAST(idx AS VARCHAR) AS branch_id, 'shopify_' || shop_id AS business_id,
       CASE WHEN epoch_us(as_of) % 1000000 = 0 THEN strftime(as_of, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(as_of, '%Y-%m-%dT%H:%M:%S.%f') END AS committed_at_text
FROM sp"""))
def row_ids(spark, d):
    """P10: adapter id strings and ISO committed_at text of the sampled rows."""
    sp = S.sample_points(S.indexed(shops(spark, d)))
    return sp.select(F.concat(F.lit("shopify_"), "shop_id", F.lit("_"), F.col("idx").cast("string")).alias("branch_id"),
                     F.concat(F.lit("shopify_"), "shop_id").alias("business_id"),
                     iso_text(F.col("as_of")).alias("committed_at_text"))


@query("shop_min_rows", shop_sql("SELECT shop_id, n_rows FROM st WHERE n_rows >= 45", "retail"))
def shop_min_rows(spark, d):
    """transaction shops with at least 45 rows."""
    return S.shop_stats(retail(spark, d)).filter(F.col("n_rows") >= S.MIN_SHOP_ROWS).select("shop_id", "n_rows")


@query("sample_points", shop_sql("SELECT shop_id, idx, as_of FROM sp"))
def sample_points(spark, d):
    """per shop the rows at index 30, 37, 44, ..."""
    return S.sample_points(S.indexed(shops(spark, d))).select("shop_id", "idx", "as_of")


@query("future_horizon", shop_sql("SELECT shop_id, idx, as_of FROM sp", "retail"))
def future_horizon(spark, d):
    """F7 (+F5): sampled points whose as_of + 14 d is not after the shop's last row."""
    r = retail(spark, d)
    return S.sample_points(S.indexed(r), S.shop_stats(r), min_rows=S.MIN_SHOP_ROWS,
                           horizon_days=S.HORIZON_DAYS).select("shop_id", "idx", "as_of")


@query("drop_null_labels", shop_sql("""
SELECT sp.shop_id, count(*) AS n_sampled,
       count(*) FILTER (WHERE l.label_inventory_delta IS NOT NULL AND l.label_cashflow_delta IS NOT NULL
                        AND l.label_order_velocity_delta IS NOT NULL) AS n_kept
FROM sp LEFT JOIN labc l ON l.shop_id = sp.shop_id AND l.idx = sp.idx GROUP BY sp.shop_id"""))
def drop_null_labels(spark, d):
    """F8: sampled rows vs rows kept after dropping NULL labels, per shop."""
    sh = shops(spark, d)
    sp = S.sample_points(S.indexed(sh))
    lab = S.labels(sh)
    kept = F.col("label_inventory_delta").isNotNull() & F.col("label_cashflow_delta").isNotNull() \
        & F.col("label_order_velocity_delta").isNotNull()
    return (sp.join(lab, ["shop_id", "idx"], "left").groupBy("shop_id")
            .agg(F.count(F.lit(1)).alias("n_sampled"), F.count(F.when(kept, 1)).alias("n_kept")))


@query("drop_null_keys", with_views(["retail_txn"], """
SELECT store_id AS shop_id, count(*) AS n_rows FROM retail_txn
WHERE l_orderkey % 11 <> 0 AND store_id IS NOT NULL GROUP BY store_id"""))
def drop_null_keys(spark, d):
    """rows with a NULL date (here every order key divisible by 11) are dropped."""
    r = _with_pos(V.retail_txn(spark, d))
    r = r.withColumn("date", F.when(F.col("row_seq.l_orderkey") % 11 != 0, F.col("date")))
    n = S.normalize_retail(r, pos="pos", order=["row_seq"])
    return n.groupBy("shop_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("running_revenue", so_sql("SELECT shop_id, created_at, total_price, cash_balance FROM so", "retail"))
def running_revenue(spark, d):
    """Per-shop running total of total_price in file order."""
    return retail(spark, d).select("shop_id", "created_at", "total_price", "cash_balance")


@query("row_index", shop_sql("SELECT shop_id, idx, created_at, total_price FROM ix"))
def row_index(spark, d):
    """Per-shop 0-based index after the time sort (ties by tie key)."""
    return S.indexed(shops(spark, d)).select("shop_id", "idx", "created_at", "total_price")


@query("row_diff", shop_sql("SELECT shop_id, idx, inventory_qty - prev_inv AS inventory_diff, "
                            "cash_balance - prev_cash AS cash_diff FROM ix"))
def row_diff(spark, d):
    """Consecutive differences x - lag(x) in shop order."""
    ix = S.indexed(shops(spark, d))
    return ix.select("shop_id", "idx", (F.col("inventory_qty") - F.col("prev.inv")).alias("inventory_diff"),
                     (F.col("cash_balance") - F.col("prev.cash")).alias("cash_diff"))


@query("last_first_value", shop_sql("""
SELECT shop_id, min(created_at) AS first_at, max(created_at) AS last_at,
       arg_min(inventory_qty, {'t': created_at, 'a': o1, 'b': o2, 'c': o3, 'd': o4, 'e': o5, 'f': o6}) AS first_inventory,
       arg_max(inventory_qty, {'t': created_at, 'a': o1, 'b': o2, 'c': o3, 'd': o4, 'e': o5, 'f': o6}) AS last_inventory
FROM so GROUP BY shop_id"""))
def last_first_value(spark, d):
    """First / last values by time per shop (aggregate, pre-combined map-side)."""
    sh = shops(spark, d)
    key = F.struct("pos", "tie")
    return sh.groupBy("shop_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
                                     F.min_by("inventory_qty", key).alias("first_inventory"),
                                     F.max_by("inventory_qty", key).alias("last_inventory"))


@query("sort_points", with_views(["commits"], """
SELECT commit_id, business_id, row_number() OVER (PARTITION BY business_id ORDER BY "timestamp", seq) - 1 AS rank
FROM commits"""))
def sort_points(spark, d):
    """O1: stable order of commits by time; ties keep sequence order."""
    from pitwise.functions.timecols import micros
    c = V.commits(spark, d).select("commit_id", "business_id", "seq",
                                   micros(F.col("timestamp")).alias("t"),
                                   F.lit(1).cast("long").alias("_one"))
    r = segmented_scan(c, "business_id", "t", ["seq"], sums=["_one"], inclusive=False, prefix="b4")
    return r.select("commit_id", "business_id", F.col("b4_one").alias("rank"))


@query("sort_group", shop_sql("SELECT shop_id, idx, created_at, total_price FROM ix", "retail"))
def sort_group(spark, d):
    """O2: shop rows sorted by time, ties by file order (transaction exports)."""
    return S.indexed(retail(spark, d)).select("shop_id", "idx", "created_at", "total_price")


# -- B family: window features of every sampled shop row (before F8) --------

def _bfeat(spark, d, dense: bool) -> DataFrame:
    sizes = V.shop_sizes(spark, d)
    return S.window_features(shops(spark, d, sizes), dense=dense, sizes=sizes)


def _bsql(cols: list[str]) -> str:
    sel = ", ".join(f"a{w}.{c} AS w{w}_{c}" for c in cols for w in W3)
    joins = " ".join(f"JOIN agg a{w} ON a{w}.shop_id = sp.shop_id AND a{w}.idx = sp.idx AND a{w}.w = {w}"
                     for w in W3)
    return shop_sql(f"SELECT sp.shop_id, sp.idx, {sel} FROM sp {joins}")


def _register_b(key: str, cols: list[str], doc: str) -> None:
    def _q(spark, d):
        f = _bfeat(spark, d, cols[0] in S.DENSE)
        return f.select("shop_id", "idx", *[f"w{w}_{c}" for c in cols for w in W3])
    _q.__doc__ = doc
    query(key, _bsql(cols))(_q)


_register_b("shop_order_count", ["order_count"], "B1: rows in the window, cancelled included.")
_register_b("shop_order_velocity", ["order_velocity"], "B2: order count / w.")
_register_b("shop_revenue", ["revenue_total"], "B3: sum of total_price in the window.")
_register_b("shop_cancel_rate", ["cancel_rate"], "B4: share of rows with cancelled_at.")
_register_b("shop_blocked_rate", ["blocked_rate"], "B5: share cancelled and above the window's q75.")
_register_b("shop_latest_cash", ["latest_cash_balance"], "B6: last row's cash in the window.")
_register_b("shop_trends", ["cash_trend", "inventory_trend"], "B7: mean consecutive difference.")
_register_b("shop_recency_weight", ["weighted_order_count"], "B8: sum of 1/max(days ago, 1).")


@query("shop_const_cols", with_views(["shop_orders"], """
SELECT DISTINCT 0 AS w7_restock_count, 0 AS w7_price_change_count, 0.0 AS w7_avg_price_change_pct,
       0.0 AS scenario_magnitude, 0.0 AS deviation_from_norm, 0 AS n_bt_nonzero FROM shop_orders"""))
def shop_const_cols(spark, d):
    """Constant columns of the adapter rows (distinct values over all rows)."""
    c = S.constant_columns()
    rows = S.prepare_shop_orders(V.shop_orders(spark, d))
    return rows.select(c["w7_restock_count"].cast("int").alias("w7_restock_count"), c["w7_price_change_count"].cast("int").alias("w7_price_change_count"),
                       *[c[n].alias(n) for n in ("w7_avg_price_change_pct", "scenario_magnitude", "deviation_from_norm")],
                       sum(c[b] for b in S.BT_COLS).alias("n_bt_nonzero")).distinct()


@query("shop_mode_category", shop_sql(
    f"SELECT st.shop_id, md.mode_type, {map_category_sql('md.mode_type')} AS category "
    f"FROM st LEFT JOIN md ON md.shop_id = st.shop_id"))
def shop_mode_category(spark, d):
    """Modal product type (smallest on a tie) mapped to a category."""
    st = S.shop_stats(shops(spark, d))
    return st.select("shop_id", "mode_type", map_category(F.col("mode_type")).alias("category"))


@query("shop_history_depth", shop_sql(
    f"SELECT sp.shop_id, sp.idx, {fd('sp.as_of', 'st.first_t')} AS history_depth_days "
    f"FROM sp JOIN st ON st.shop_id = sp.shop_id"))
def shop_history_depth(spark, d):
    """Floor days since the shop's first row, per sampled row."""
    from pitwise.functions.timecols import floor_days, micros
    sh = shops(spark, d)
    sp = S.sample_points(S.indexed(sh))
    st = S.shop_stats(sh)
    return sp.join(st, "shop_id").select("shop_id", "idx", floor_days(F.col("a") - F.col("first_t"))
                                         .alias("history_depth_days"))


@query("shop_labels", shop_sql("SELECT shop_id, idx, label_inventory_delta, label_cashflow_delta, "
                               "label_order_velocity_delta FROM labc"))
def shop_labels(spark, d):
    """14-day labels (NULL when the pre or post window is empty)."""
    sizes = V.shop_sizes(spark, d)
    return S.labels(shops(spark, d, sizes), sizes=sizes)


@query("adapter_counts",
       "SELECT (SELECT count(*) FROM (" + adapter_sql("shop") + ")) AS n_rows, "
       "(SELECT count(DISTINCT CAST(l_suppkey AS VARCHAR)) FROM lineitem) AS n_shops")
def adapter_counts(spark, d):
    """Training rows produced and distinct shops in the input."""
    sh = shops(spark, d)
    t2 = S.labels(sh).dropna(subset=S.LABELS)
    n_rows = t2.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_k", F.lit(1))
    n_shops = sh.agg(F.count_distinct("shop_id").alias("n_shops")).withColumn("_k", F.lit(1))
    return n_rows.join(n_shops, "_k").drop("_k")
